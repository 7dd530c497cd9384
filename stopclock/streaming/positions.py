"""Positions as a stream: collection, pairing and provisional stop-hour tables.

Stream results are provisional. The batch derivation of a closed day stays the authority.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopclock.functions.calendar import LOCAL_OFFSET_HOURS, from_epoch_ms, local_hour
from stopclock.functions.numbers import half_up
from stopclock.operators.stop_metrics import HOURLY_COLUMNS
from stopclock.operators.traces import MAX_GAP_MS, SAMPLE_ORDER, SLICE_MS, TRACE_KEYS, slices_reached
from stopclock.session import checkpoint_id, hadoop_path
from stopclock.sources import archive, tables
from stopclock.sources.publish import Publication, newest, vacuum

WATERMARK = "10 minutes"


def position_stream(spark: SparkSession, root: str, files_per_batch: int | None = None, days: list[str] | None = None) -> DataFrame:
    """Samples from archive objects as they arrive: of the given days, or of all."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = f"{root}/{{,service_date=}}{{{','.join(days)}}}/{{,cycle=*/}}*.gz" if days else archive.day_paths(root, None)[0]
    return archive.project_positions(archive.position_lines(reader, path))


def follow_positions(
    spark: SparkSession, root: str, handle: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 256, late_days: int = 1,
) -> list[str]:
    """One pass of a stream over the archive's open days: hands on every batch of new samples, and returns the days looked at.

    The archive grows by a folder a day, and listing all of it at every trigger would take longer and longer. A pass lists the folders'
    names once and the files of open days only: those not more than ``late_days`` before the newest day that earlier passes have
    seen. Later files of older days are not followed; the batch derivation has them. Where to begin is kept beside the stream's
    checkpoint and moves on only after a whole pass, so an interrupted pass is repeated, and the checkpoint
    keeps files from being read twice.
    """
    start_file, fs = hadoop_path(spark, f"{checkpoint}-open-from")
    # A file without a line, as a crash may leave it, means all days.
    found = spark.read.text(str(start_file)).first() if fs.exists(start_file) else None
    start = found[0] if found else ""
    days = sorted(str(r[0]) for r in archive.archived_days(spark, root).collect())
    opened = [d for d in days if d >= start]
    if not opened:
        return []
    stream = position_stream(spark, root, files_per_batch, opened)
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    later = max(opened[max(0, len(opened) - 1 - late_days)], start)
    out = fs.create(start_file, True)
    try:
        out.write(bytearray(later.encode()))
    finally:
        out.close()
    return opened


def collect_positions(replies: DataFrame, root: str, checkpoint: str, offset_hours: int = LOCAL_OFFSET_HOURS):
    """Archives a stream of collection replies. A repeated batch replaces its own files only.

    Batches are named by the checkpoint's identity and their number, so a stream started anew keeps what
    an earlier one has collected.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        writer = f"{checkpoint_id(batch.sparkSession, checkpoint)}-{batch_id}"
        archive.write_positions(archive.flatten_replies(batch), root, offset_hours, writer)

    return replies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def pair_stream(samples: DataFrame, slice_ms: int = SLICE_MS, watermark: str = WATERMARK) -> DataFrame:
    """Sample pairs of a stream of valid samples, equal to the batch pairs for all samples that the watermark lets in.

    The stream is joined with itself on trace and time slice, within the greatest gap of a pair; of the earlier samples that a
    sample meets, the last one is its partner. Everything runs in the JVM. A pair comes out once the watermark has
    passed its later sample, so samples may arrive in any order within it, and the last pairs wait for a later sample of any
    vehicle. State is dropped when no sample could pair with it any more.

    Traces are cut into the same overlapping time slices as in the batch: a hot vehicle's state is spread over tasks.
    """
    placed = samples.select(*TRACE_KEYS, *SAMPLE_ORDER, from_epoch_ms(F.col("ts_ms")).alias("at")).withWatermark("at", watermark)
    reached = F.explode(slices_reached(F.col("ts_ms"), MAX_GAP_MS, slice_ms))
    earlier = placed.select(*[F.col(c).alias(f"_{c}") for c in TRACE_KEYS], *[F.col(c).alias(f"a_{c}") for c in SAMPLE_ORDER], F.col("at").alias("a_at"), reached.alias("_slice"))
    own = F.floor(F.col("ts_ms") / slice_ms)
    later = placed.select(*TRACE_KEYS, *[F.col(c).alias(f"b_{c}") for c in SAMPLE_ORDER], F.col("at").alias("b_at"), own.alias("slice"))
    same = F.col("slice") == F.col("_slice")
    for c in TRACE_KEYS:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    # One millisecond more, as instants are cut to it; the exact gap is tested below.
    near = (F.col("a_at") <= F.col("b_at")) & (F.col("b_at") <= F.col("a_at") + F.expr(f"INTERVAL {MAX_GAP_MS + 1} MILLISECOND"))
    a, b = (F.struct(*[F.col(f"{side}_{c}").alias(c) for c in SAMPLE_ORDER]) for side in ("a", "b"))
    met = later.join(earlier, same & near & (a < b))
    gap = F.col("b_ts_ms") - F.col("a.ts_ms")
    last = met.groupBy(*TRACE_KEYS, *[f"b_{c}" for c in SAMPLE_ORDER], "b_at").agg(F.max_by(a, a).alias("a"))
    return last.where((gap > 0) & (gap <= MAX_GAP_MS)).select(
        *TRACE_KEYS, *[F.col(f"a.{c}").alias(f"a_{c}") for c in SAMPLE_ORDER], *[f"b_{c}" for c in SAMPLE_ORDER], gap.alias("dt_ms")
    )


def hourly_counts(arrivals: DataFrame, offset_hours: int = LOCAL_OFFSET_HOURS) -> DataFrame:
    """Running stop-hour counts of an arrival stream with an ``arrived_at`` timestamp.

    Counts only: exact medians need the whole hour and come from :func:`keep_hourly`.
    """
    delay = F.col("delay_s")
    return (
        arrivals.withWatermark("arrived_at", WATERMARK)
        .groupBy(F.window("arrived_at", "1 hour").alias("w"), "service_date", "stop_id", "route_id", "direction")
        .agg(
            F.count("*").alias("n_obs"), F.count(delay).alias("n_matched"),
            F.count_if(delay.between(-60, 300)).alias("on_time"),
            F.count_if(delay > 300).alias("late"), F.count_if(delay < -60).alias("early"),
        )
        .withColumn("hour", F.pmod(F.floor(F.unix_seconds("w.start") / 3600) + offset_hours, F.lit(24)).cast("int"))
        .drop("w")
    )


DELAYS = "stop_hour_delays"
_DELAY_KEYS = ["service_date", "stop_id", "route_id", "direction", "hour", "delay_s"]
_DELAYS = "stop_id string, route_id string, direction int, hour int, delay_s int, n long, service_date date"


def delay_counts(arrivals: DataFrame, offset_hours: int = LOCAL_OFFSET_HOURS) -> DataFrame:
    """How many arrivals of a stop and hour have each delay, to the second; null is a delay of its own."""
    return arrivals.withColumn("hour", local_hour(F.col("ts_ms"), offset_hours)).groupBy(*_DELAY_KEYS).agg(F.count(F.lit(1)).alias("n"))


def hourly_of_counts(counts: DataFrame) -> DataFrame:
    """The stop-hour table from :func:`delay_counts`, the same as from the arrivals themselves."""
    delay, n = F.col("delay_s"), F.col("n")
    those = lambda condition: F.coalesce(F.sum(F.when(condition, n)), F.lit(0))
    return (
        counts.groupBy("service_date", "stop_id", "route_id", "direction", "hour")
        .agg(
            F.sum(n).alias("n_obs"), those(delay.isNotNull()).alias("n_matched"), those(delay.between(-60, 300)).alias("on_time"),
            those(delay > 300).alias("late"), those(delay < -60).alias("early"),
            half_up(F.percentile(delay, 0.5, n)).cast("int").alias("delay_med_s"),
        )
        .withColumnRenamed("service_date", "date")
        .select(*HOURLY_COLUMNS)
    )


def keep_hourly(arrivals: DataFrame, root: str, checkpoint: str, offset_hours: int = LOCAL_OFFSET_HOURS, kept_versions: int = 10, kept_hours: float = 48.0):
    """Keeps the stop-hour table, exact medians included, by increments.

    What is stored of the arrivals is a counter for each delay of a stop and hour. A batch adds its counts to those of the dates it
    touches and rebuilds their stop-hours from the counters: work grows with stops and delays of these dates, not with the arrivals
    there were. Counters, table and the batch's number are published in one step, so a repeated batch changes nothing, and a
    stream started anew adds to what is there.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = checkpoint_id(spark, checkpoint)
        if newest(spark, root).marks.get(stream, -1) >= batch_id:
            return
        fresh = delay_counts(batch, offset_hours).persist()
        try:
            touched = [str(r[0]) for r in fresh.select("service_date").distinct().collect()]
            with Publication(spark, root) as out:
                if touched:
                    names = {f"service_date={d}" for d in touched}
                    columns = [*_DELAY_KEYS, "n"]
                    merged = out.read(DELAYS, _DELAYS, names=names).select(*columns).union(fresh.select(*columns))
                    merged = merged.groupBy(*_DELAY_KEYS).agg(F.sum("n").alias("n"))
                    out.stage(merged, DELAYS, "service_date", ["stop_id", "hour"], touched)
                    counts = out.read(DELAYS, _DELAYS, names=names)
                    tables.stage_table(out, hourly_of_counts(counts), "transit_stop_hourly", ["stop_id", "route_id"], touched)
                out.commit({stream: batch_id})
        finally:
            fresh.unpersist()
        vacuum(spark, root, kept_versions, kept_hours)

    return arrivals.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
