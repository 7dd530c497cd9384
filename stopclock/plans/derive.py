"""Batch jobs: derive service days from the archive and backfill what is missing."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopclock.functions.calendar import LOCAL_OFFSET_HOURS
from stopclock.operators.arrivals import derive_arrivals
from stopclock.operators.network import Network, build_network, scheduled_headways, snapshot_for_days
from stopclock.operators.presence import may_meet
from stopclock.operators.segments import GROUP_KEYS, locate_along, segment_weekly, speed_histogram, traversals
from stopclock.operators.stop_metrics import stop_daily, stop_hourly
from stopclock.operators.traces import assign_model, sample_pairs, valid_samples
from stopclock.session import Staging, release_shuffles
from stopclock.sources import archive, tables
from stopclock.sources.publish import Publication, read_published

DERIVED_ARRIVALS = "derived_arrivals"
SPEED_HISTOGRAMS = "segment_speed_daily"
HISTOGRAM = (
    "service_date date, iso_week string, route_id string, direction int, bin_idx long, band string, bucket long, n long, low double, high double"
)


@dataclass(frozen=True)
class Layout:
    """Where things lie."""

    positions: str
    snapshots: str
    tables: str


def located_pairs(samples: DataFrame, network: Network) -> DataFrame:
    """Sample pairs with direction, model and place along the line.

    Cells are many times what the lines take; where they are too many for a broadcast, those that no sample can lie in are left out
    before the join's shuffle.
    """
    placed = assign_model(samples, network.patterns)
    if "cells" in network.large:
        cell = [F.col("model_id"), *[F.floor(F.col(c) / network.cell_deg) for c in ("lon", "lat")]]
        met = may_meet(network.cells, [F.col("model_id"), F.col("cell_x").cast("long"), F.col("cell_y").cast("long")], placed, cell)
        network = replace(network, cells=met)
    located = locate_along(placed, network)
    return sample_pairs(located, extra_keys=["direction", "model_id"], extra_carry=["along_m"])


def pending_days(archived: DataFrame, ledger: DataFrame, today: dt.date) -> DataFrame:
    """Archived days before ``today`` (local) that the ledger does not have."""
    closed = archived.select("service_date").distinct().where(F.col("service_date") < F.lit(today))
    return closed.join(ledger.select(F.col("date").alias("service_date")), "service_date", "left_anti")


def load_network(spark: SparkSession, snapshots: str, days: DataFrame, staging: Staging) -> Network:
    """Models of the given days from the newest snapshot on or before each."""
    dated = staging.stage(snapshot_for_days(days, archive.snapshot_days(spark, snapshots)), "snapshot-days")
    # At most one snapshot per day asked for; only their files are read.
    wanted = [r[0] for r in dated.select("snapshot_date").distinct().collect()]
    if not wanted:
        raise ValueError("no snapshot on or before the given days")
    stops = archive.read_stops(spark, snapshots, wanted)
    routes = archive.read_routes(spark, snapshots, wanted)
    network = build_network(dated, staging.stage(stops, "stops"), staging.stage(routes, "routes"))
    return network.staged(staging)


def day_metrics(files: DataFrame, samples: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Ledger rows: objects read, valid samples, arrivals and matched arrivals per day.

    A day without files has no row.
    """
    per_day = files.groupBy("service_date").agg(F.count_distinct("file_path").alias("files"))
    counted = samples.groupBy("service_date").agg(F.count("*").alias("samples"))
    found = arrivals.groupBy("service_date").agg(
        F.count("*").alias("arrivals"), F.count("delay_s").alias("matched")
    )
    zero = {"samples": 0, "arrivals": 0, "matched": 0}
    return (
        per_day.join(counted, "service_date", "left").join(found, "service_date", "left").fillna(zero)
        .select(
            F.col("service_date").alias("date"), F.current_timestamp().alias("processed_at"),
            "files", "samples", "arrivals", "matched", F.lit(None).cast("string").alias("notes"),
        )
    )


def rejected_samples(samples: DataFrame) -> DataFrame:
    """Per day, how many archive lines were read and how many were not valid samples."""
    ok = valid_samples(samples).groupBy("service_date").agg(F.count("*").alias("valid"))
    return (
        samples.groupBy("service_date").agg(F.count("*").alias("lines")).join(ok, "service_date", "left")
        .fillna({"valid": 0})
        .withColumn("rejected", F.col("lines") - F.col("valid"))
    )


def derive_days(
    spark: SparkSession,
    layout: Layout,
    days: list[dt.date | str],
    weekly_mode: str = "last_day",
    offset_hours: int = LOCAL_OFFSET_HOURS,
    network: Network | None = None,
) -> None:
    """Derives any number of service days in one job and replaces their partitions.

    The network comes from the snapshots unless one is given.

    All tables and the ledger are published in one step at the end: readers see the old results until then, and an
    interrupted run changes nothing and is simply repeated. Arrivals and speed histograms are staged first and
    everything else is built from them.
    """
    present = archive.present_days(spark, layout.positions, days)
    if not present:
        return
    wanted = spark.createDataFrame([(d,) for d in present], "d string").select(F.col("d").cast("date").alias("service_date"))
    with Staging(spark) as staging:
        network = network.staged(staging) if network else load_network(spark, layout.snapshots, wanted, staging)
        _derive(spark, layout, present, network, weekly_mode, offset_hours, staging)


def _derive(
    spark: SparkSession, layout: Layout, days: list[str], network: Network, weekly_mode: str, offset_hours: int,
    staging: Staging,
) -> None:
    # The archive is many small gzip files; one pass turns the valid samples into a columnar table.
    samples = staging.stage(
        valid_samples(archive.read_positions(spark, layout.positions, days)).drop("file_path"), "samples"
    )
    pairs = staging.stage(located_pairs(samples, network), "pairs")

    with Publication(spark, layout.tables) as out:
        # Every output owns the days asked for: a day that has no rows any more is emptied, not left as it was.
        timed = network
        if "timetable" in network.large:
            # Timetables of models without pairs needn't be listed by time spans.
            timed = replace(network, timetable=may_meet(network.timetable, [F.col("model_id")], pairs, [F.col("model_id")]))
        fresh = derive_arrivals(pairs, timed, offset_hours)
        out.stage(fresh, DERIVED_ARRIVALS, "service_date", ["stop_id", "ts_ms"], days)
        arrivals = out.read(DERIVED_ARRIVALS, fresh.schema, names={f"service_date={d}" for d in days})
        release_shuffles(spark)
        out.stage(speed_histogram(traversals(pairs, offset_hours)), SPEED_HISTOGRAMS, "service_date", ["route_id", "bin_idx"], days)

        tables.stage_table(out, stop_daily(arrivals, scheduled_headways(network)), "transit_stop_daily", ["stop_id", "route_id"], days)
        tables.stage_table(out, stop_hourly(arrivals, offset_hours), "transit_stop_hourly", ["stop_id", "route_id"], days)
        _stage_weeks(out, days, weekly_mode)
        archive.stage_arrivals_archive(out, arrivals, days)
        files = archive.archived_files(spark, layout.positions, days)
        tables.stage_ledger(out, day_metrics(files, samples, arrivals))
        out.commit()


def _stage_weeks(out: Publication, days: list[str], mode: str) -> None:
    """The weeks the given days fall in, from every stored day of those weeks; a week may become empty."""
    weeks = {"{}-W{:02d}".format(*dt.date.fromisoformat(d).isocalendar()[:2]) for d in days}
    whole = {dt.date.fromisocalendar(int(w[:4]), int(w[6:]), k) for w in weeks for k in range(1, 8)}
    stored = out.read(SPEED_HISTOGRAMS, HISTOGRAM, names={f"service_date={d}" for d in whole})
    weekly = segment_weekly(stored.select("service_date", *GROUP_KEYS, "bucket", "n", "low", "high"), mode)
    tables.stage_table(out, weekly, "transit_segment_weekly", ["route_id", "direction", "bin_idx"], sorted(weeks))


def write_weeks(spark: SparkSession, layout: Layout, days: list[str], mode: str) -> None:
    """Rebuilds the weeks the given days fall in."""
    with Publication(spark, layout.tables) as out:
        _stage_weeks(out, days, mode)
        out.commit()


def read_histograms(spark: SparkSession, layout: Layout) -> DataFrame:
    return read_published(spark, layout.tables, SPEED_HISTOGRAMS, HISTOGRAM)


def backfill(
    spark: SparkSession, layout: Layout, today: dt.date, weekly_mode: str = "last_day",
    offset_hours: int = LOCAL_OFFSET_HOURS, days_per_job: int = 64,
) -> list[str]:
    """Derives every closed day that is not in the ledger, and returns these days.

    Days go in runs of ``days_per_job``, oldest first. Each run publishes its tables and ledger rows together, so what was
    derived before an interruption is not derived again, and nothing of an interrupted run shows.
    """
    waiting = pending_days(
        archive.archived_days(spark, layout.positions), tables.read_ledger(spark, layout.tables), today
    )
    days = [str(r[0]) for r in waiting.orderBy("service_date").collect()]
    for at in range(0, len(days), days_per_job):
        derive_days(spark, layout, days[at : at + days_per_job], weekly_mode, offset_hours)
    return days
