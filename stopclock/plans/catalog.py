"""Registered queries: every operator over the given tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopclock.functions import calendar as cal
from stopclock.functions import sql
from stopclock.functions import text as tx
from stopclock.functions.numbers import half_up
from stopclock.operators import access, history, network, permits, places, records, segments, stop_metrics
from stopclock.operators import subscriptions as subs
from stopclock.operators import usage
from stopclock.operators.arrivals import derive_arrivals
from stopclock.operators.quantiles import histogram, rounded_quantiles
from stopclock.operators.traces import assign_model, sample_pairs, valid_samples
from stopclock.plans import adapters as ad
from stopclock.plans.derive import SPEED_HISTOGRAMS, Layout, backfill, day_metrics, derive_days, located_pairs, pending_days
from stopclock.session import scratch_root
from stopclock.sources import archive, tables
from stopclock.sources.publish import Publication, read_published
from stopclock.streaming import billing, positions
from stopclock.streaming.requests import rate_limit_stream

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries
STOPS = ["S0", "S1"]
SPAN = ("2024-01-03", "2024-01-28")
AS_OF = "2024-01-31T00:00:00Z"


def _ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def _stop_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    arrivals = ad.event_arrivals(spark, sf)
    return (
        stop_metrics.stop_daily(arrivals, ad.hourly_schedule(arrivals)),
        stop_metrics.stop_hourly(arrivals, offset_hours=0),
    )


def _dates_as_text(df: DataFrame) -> DataFrame:
    """Dates leave the registered queries as text, so that any client compares them alike."""
    return df.select(
        *[F.col(n).cast("string").alias(n) if t == "date" else F.col(n) for n, t in df.dtypes]
    )


# Arrivals to stop tables

def stop_daily(spark, sf):
    return _stop_tables(spark, sf)[0]


def stop_hourly(spark, sf):
    return _stop_tables(spark, sf)[1]


def observed_headways(spark, sf):
    found = stop_metrics.observed_headways(ad.event_arrivals(spark, sf))
    return found.select(
        "service_date", "stop_id", "route_id", "direction",
        half_up(F.col("ts_ms") * 1000).alias("at_us"), half_up(F.col("headway_s"), 3).alias("headway_s"),
    )


def excess_wait(spark, sf):
    stats = stop_metrics.headway_stats(stop_metrics.observed_headways(ad.event_arrivals(spark, sf)))
    return stats.select(
        "service_date", "stop_id", "route_id", "direction", "n_headways", "headway_med_s",
        half_up(F.col("wait_s"), 3).alias("wait_s"),
        stop_metrics.excess_wait(F.col("wait_s"), F.lit(3600.0)).alias("ewt_s"),
    )


def bucketed_quantiles(spark, sf):
    """Exact medians of a real-valued column over large groups."""
    rows = ad.load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    keys = ["l_returnflag", "l_linestatus"]
    return rounded_quantiles(histogram(rows, keys, "l_extendedprice", 0), keys, 0, "med", {"p15": 0.15, "p90": 0.9})


# History

def _history(day_type: str | None, band: str | None) -> Query:
    def run(spark, sf):
        daily, hourly = _stop_tables(spark, sf)
        return history.history_stats(daily, hourly, STOPS, *SPAN, day_type, band)

    return run


def history_hourly(spark, sf):
    return history.history_hourly(_stop_tables(spark, sf)[1], STOPS, *SPAN, "weekday")


def history_hourly_area(spark, sf):
    """The stop set given as a table, so as a semi-join."""
    area = ad.load(spark, sf, "supplier").select(
        F.concat(F.lit("S"), (F.col("s_suppkey") % 2).cast("string")).alias("stop_id")
    ).distinct()
    return history.history_hourly(_stop_tables(spark, sf)[1], area, *SPAN)


def history_coverage(spark, sf):
    ledger = ad.event_arrivals(spark, sf).groupBy(F.col("service_date").alias("date")).agg(F.count("*").alias("arrivals"))
    return history.history_coverage(ledger)


def derive_ledger(spark, sf):
    """Ledger figures per day; the hours with events stand for the archive objects."""
    arrivals = ad.event_arrivals(spark, sf)
    hour = F.floor(F.col("ts_ms") / cal.HOUR_MS).cast("string")
    files = arrivals.select("service_date", hour.alias("file_path"))
    return day_metrics(files, arrivals, arrivals).select("date", "files", "samples", "arrivals", "matched")


def _all_stats(spark, sf):
    daily, hourly = _stop_tables(spark, sf)
    return history.history_stats(daily, hourly, ["S0", "S1", "S2"], "2024-01-01", "2024-01-31")


def area_reliability(spark, sf):
    return history.area_reliability(_all_stats(spark, sf)).withColumn("score", half_up(F.col("score"), 6))


def area_medians(spark, sf):
    return history.area_medians(_stop_tables(spark, sf)[0], STOPS, *SPAN)


def stop_measures(spark, sf):
    shown = history.stop_measures(_all_stats(spark, sf))
    return shown.withColumn("on_time_share", half_up(F.col("on_time_share"), 6)).withColumn(
        "late_share", half_up(F.col("late_share"), 6)
    )


def worst_stops(spark, sf):
    return history.worst_stops(_all_stats(spark, sf), 2).withColumn("on_time_share", half_up(F.col("on_time_share"), 6))


def worst_stops_all(spark, sf):
    return history.worst_stops(_all_stats(spark, sf)).withColumn("on_time_share", half_up(F.col("on_time_share"), 6))


def report_routes(spark, sf):
    """The routes of an area's report."""
    daily, hourly = _stop_tables(spark, sf)
    routes = history.area_report(daily, hourly, STOPS, *SPAN)["routes"]
    return routes.withColumns({c: half_up(F.col(c), 6) for c in ("on_time_share", "obs_per_day")})


def _routes(spark, sf):
    return history.route_measures(_stop_tables(spark, sf)[0], STOPS, *SPAN)


def route_measures(spark, sf):
    return _routes(spark, sf).withColumn("on_time_share", half_up(F.col("on_time_share"), 6)).withColumn(
        "obs_per_day", half_up(F.col("obs_per_day"), 6)
    )


def worst_route(spark, sf):
    return history.worst_route(_routes(spark, sf)).select("route_id", half_up(F.col("on_time_share"), 6).alias("on_time_share"))


# Positions to arrivals and speeds

def _line_pairs(spark, sf, days: int = 1):
    return located_pairs(valid_samples(ad.event_positions(spark, sf, days)), ad.line_network(spark, days))


def _plain_pairs(spark, sf):
    net = ad.line_network(spark)
    return net, sample_pairs(
        assign_model(valid_samples(ad.event_positions(spark, sf)), net.patterns), extra_keys=["direction", "model_id"]
    )


def sample_pair_rows(spark, sf):
    return _pair_columns(sample_pairs(valid_samples(ad.event_positions(spark, sf))))


def _pair_columns(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "service_date", "vehicle_id", "pattern_suffix",
        half_up(F.col("a_ts_ms")).alias("a_ms"), half_up(F.col("b_ts_ms")).alias("b_ms"),
        "a_next_stop_id", "b_next_stop_id", half_up(F.col("dt_ms")).alias("dt_ms"),
    )


def _arrivals(spark, sf):
    net, pairs = _plain_pairs(spark, sf)
    return derive_arrivals(pairs, net)


def stop_arrivals(spark, sf):
    return _arrivals(spark, sf).select(
        "service_date", "stop_id", "route_id", "direction", half_up(F.col("ts_ms")).alias("at_ms"), "delay_s"
    )


def arrival_delays(spark, sf):
    """Delays of derived arrivals by stop and local hour."""
    return stop_metrics.stop_hourly(_arrivals(spark, sf))


def derived_stop_daily(spark, sf):
    """Positions all the way to the stop-day table."""
    net, pairs = _plain_pairs(spark, sf)
    return stop_metrics.stop_daily(derive_arrivals(pairs, net), network.scheduled_headways(net))


def segment_speeds(spark, sf):
    found = segments.traversals(_line_pairs(spark, sf))
    return found.groupBy("iso_week", "direction", "bin_idx", "band").agg(
        F.count("*").alias("n"), half_up(F.sum("kmh"), 2).alias("sum_kmh"), half_up(F.max("kmh"), 4).alias("max_kmh")
    )


def _weekly(mode: str) -> Query:
    def run(spark, sf):
        hist = segments.speed_histogram(segments.traversals(_line_pairs(spark, sf, days=3)))
        return segments.segment_weekly(hist, mode)

    return run


def snapshot_asof(spark, sf):
    """Newest order date divisible by five days as the snapshot of every event day."""
    days = ad.event_arrivals(spark, sf).select("service_date").distinct()
    snaps = ad.event_arrivals(spark, sf).where(F.dayofmonth("service_date") % 5 == 0).select(F.col("service_date").alias("snapshot_date")).distinct()
    return network.snapshot_for_days(days, snaps)


def pending(spark, sf):
    days = ad.event_arrivals(spark, sf).select("service_date")
    ledger = days.where(F.dayofmonth("service_date") % 3 == 0).select(F.col("service_date").alias("date")).distinct()
    return pending_days(days, ledger, dt.date(2024, 1, 25))


# Network models

def _customer_network(spark, sf):
    days = network.snapshot_for_days(ad.route_days(spark), ad.route_snapshots(spark))
    return network.build_network(days, ad.customer_stops(spark, sf), ad.customer_routes(spark, sf))


def network_patterns(spark, sf):
    return _customer_network(spark, sf).patterns


def network_sequences(spark, sf):
    stops = _customer_network(spark, sf).sequences.select("model_id", F.posexplode("stops").alias("idx", "stop"))
    return stops.select(
        "model_id", "idx", F.col("stop.stop_id").alias("stop_id"),
        half_up(F.col("stop.lat"), 6).alias("lat"), half_up(F.col("stop.lon"), 6).alias("lon"),
    )


def network_headways(spark, sf):
    return network.scheduled_headways(_customer_network(spark, sf))


def network_vertices(spark, sf):
    return _customer_network(spark, sf).vertices.select(
        "model_id", "idx", half_up(F.col("lat") * 1e5).alias("lat_e5"), half_up(F.col("lon") * 1e5).alias("lon_e5"),
        half_up(F.col("cum_m"), 3).alias("cum_m"),
    )


def routes_with_patterns(spark, sf):
    k = F.col("c_custkey")
    names = F.filter(F.array(F.when(k % 2 == 0, "0:01").otherwise(""), F.when(k % 3 == 0, "1:01")), lambda s: s.isNotNull())
    catalog = ad.load(spark, sf, "customer").select(k.alias("id"), F.col("c_name").alias("short_name"), names.alias("suffixes"))
    return archive.routes_with_patterns(catalog).withColumn("suffixes", F.array_join("suffixes", ","))


# Files and tables: written to the shared folder and read back

def _fresh(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/stopclock/{name}-{uuid.uuid4().hex}"


def flattened_replies(spark, sf):
    lines = archive.flatten_replies(ad.order_replies(spark, sf))
    return lines.groupBy("r", "n", "p", "v.nextStopId").agg(
        F.count("*").alias("vehicles"), F.min("t").alias("first_t"), F.count_distinct("v.vehicleId").alias("distinct_vehicles")
    )


def collected_positions(spark, sf):
    """Replies archived as gzipped lines by local day, and read back as samples."""
    root = _fresh(spark, "collected")
    archive.write_positions(archive.flatten_replies(ad.order_replies(spark, sf)), root, whole_days=True)
    return _collected(spark, root)


def collected_twice(spark, sf):
    """The replies in two streams with checkpoints of their own on one archive, by local day and minute; none replaces the other's."""
    root, replies = _fresh(spark, "collected"), _fresh(spark, "replies")
    # A collection cycle every ten minutes, as every minute is a folder.
    hourly = _cycles(spark, sf)
    for half in range(2):
        path = f"{replies}/{half}"
        hourly.where(F.length("route_id") % 2 == half).write.parquet(path)
        writer = positions.collect_positions(spark.readStream.schema(hourly.schema).parquet(path), root, _fresh(spark, "collected-checkpoint"))
        writer.trigger(availableNow=True).start().awaitTermination()
    return _collected(spark, root)


def _cycles(spark, sf) -> DataFrame:
    """The replies in collection cycles of ten minutes."""
    return ad.order_replies(spark, sf).withColumn("sampled_at", F.timestamp_seconds(F.floor(F.unix_seconds("sampled_at") / 600) * 600))


def compacted_positions(spark, sf):
    """Replies archived by local day and minute, and every day compacted to few files."""
    root = _fresh(spark, "collected")
    archive.write_positions(archive.flatten_replies(_cycles(spark, sf)), root)
    archive.compact_days(spark, root, [r[0] for r in archive.archived_days(spark, root).collect()])
    return _collected(spark, root)


def _collected(spark: SparkSession, root: str) -> DataFrame:
    samples = valid_samples(archive.read_collected_positions(spark, root))
    return samples.groupBy("service_date", "pattern_suffix").agg(
        F.count("*").alias("samples"), F.min("ts_ms").cast("long").alias("first_ms"), F.max("ts_ms").cast("long").alias("last_ms"),
        F.count_distinct("vehicle_id").alias("vehicles"),
    )


def arrivals_archive(spark, sf):
    root = _fresh(spark, "arrivals")
    with Publication(spark, root) as out:
        archive.stage_arrivals_archive(out, ad.event_arrivals(spark, sf))
        out.commit()
    return archive.read_arrivals_archive(spark, root)


def stored_history(spark, sf):
    """History over the stored stop-day table."""
    root = _fresh(spark, "tables")
    daily, hourly = _stop_tables(spark, sf)
    tables.write_table(daily, root, "transit_stop_daily", ["stop_id", "route_id"])
    return history.history_stats(tables.read_table(spark, root, "transit_stop_daily"), hourly, STOPS, *SPAN)


def stored_hourly(spark, sf):
    root = _fresh(spark, "tables")
    tables.write_table(_stop_tables(spark, sf)[1], root, "transit_stop_hourly", ["stop_id", "route_id"])
    profile = history.history_hourly(tables.read_table(spark, root, "transit_stop_hourly"), STOPS, *SPAN)
    return profile.withColumn("hour", F.col("hour").cast("int"))


def stored_weekly(spark, sf):
    """Daily speed histograms stored, the week rebuilt from the stored days."""
    root = _fresh(spark, "speeds")
    hist = segments.speed_histogram(segments.traversals(_line_pairs(spark, sf, days=3)))
    with Publication(spark, root) as out:
        out.stage(hist, SPEED_HISTOGRAMS, "service_date", ["route_id", "bin_idx"])
        out.commit()
    weekly = segments.segment_weekly(read_published(spark, root, SPEED_HISTOGRAMS, hist.schema), "merge")
    tables.write_table(weekly, root, "transit_segment_weekly", ["route_id", "direction", "bin_idx"])
    stored = tables.read_table(spark, root, "transit_segment_weekly")
    return stored.select("iso_week", F.col("direction").cast("int"), "bin_idx", "band", F.col("n").cast("long"), *[
        half_up(F.col(c).cast("double"), 1).alias(c) for c in ("speed_med_kmh", "speed_p15_kmh")
    ])


def stored_ledger(spark, sf):
    """Every third day processed twice; the later figures count."""
    root = _fresh(spark, "ledger")
    figures = derive_ledger(spark, sf)
    for run in (1, 2):
        done = figures if run == 1 else figures.where(F.dayofmonth("date") % 3 == 0).withColumn("files", F.col("files") + 100)
        tables.append_ledger(done.withColumns({"processed_at": F.timestamp_seconds(F.lit(run)), "notes": F.lit(None).cast("string")}), root)
    return tables.read_ledger(spark, root).select(
        "date", *[F.col(c).cast("long") for c in ("files", "samples", "arrivals", "matched")]
    )


def _derive_job(spark, sf, weekly_mode: str) -> Layout:
    """Positions archived as files, then the whole derivation job over them."""
    layout = Layout(_fresh(spark, "positions"), _fresh(spark, "snapshots"), _fresh(spark, "derived"))
    archive.write_positions(ad.position_lines(ad.event_positions(spark, sf, days=3)), layout.positions, whole_days=True)
    days = [r[0] for r in archive.archived_days(spark, layout.positions).collect()]
    derive_days(spark, layout, days, weekly_mode, network=ad.line_network(spark, days=3))
    return layout


def derive_job_daily(spark, sf):
    daily = tables.read_table(spark, _derive_job(spark, sf, "last_day").tables, "transit_stop_daily")
    return daily.withColumn("direction", F.col("direction").cast("int"))


def derive_job_ledger(spark, sf):
    layout = _derive_job(spark, sf, "merge")
    weekly = tables.read_table(spark, layout.tables, "transit_segment_weekly").agg(F.sum("n").alias("traversals"))
    ledger = tables.read_ledger(spark, layout.tables).agg(
        F.count("*").alias("days"), F.sum("samples").alias("samples"), F.sum("arrivals").alias("arrivals"), F.sum("matched").alias("matched")
    )
    return ledger.select("*", weekly.scalar().alias("traversals"))


def derive_job_rerun(spark, sf):
    """The job run again over days it has derived: its tables stay as they were."""
    layout = _derive_job(spark, sf, "last_day")
    days = [r[0] for r in archive.archived_days(spark, layout.positions).collect()]
    derive_days(spark, layout, days, "last_day", network=ad.line_network(spark, days=3))
    return tables.read_table(spark, layout.tables, "transit_stop_daily").withColumn("direction", F.col("direction").cast("int"))


def _write_snapshots(spark, sf, root: str) -> None:
    """Customers' routes as a snapshot of both generations, the line of the positions as its last route, and the stops of both."""
    day = min(ad.SNAPSHOT_DAYS)
    routes = ad.customer_routes(spark, sf).where(F.col("snapshot_date") == F.lit(day)).drop("snapshot_date")
    routes = ad.route_entries(routes.unionByName(ad.line_route(spark)))
    stops = ad.customer_stops(spark, sf).where(F.col("snapshot_date") == F.lit(day)).drop("snapshot_date")
    archive.write_snapshot(stops.unionByName(ad.line_stops(spark)).withColumn("name", F.col("id")), root, day, "stops")
    archive.write_snapshot(routes, root, day, "routes")


def snapshot_routes(spark, sf):
    """Routes written as snapshot files and read back from both generations, with the faults of their timetables."""
    root = _fresh(spark, "snapshots")
    _write_snapshots(spark, sf, root)
    routes = archive.read_routes(spark, root)
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)
    shapes = routes.select("snapshot_date", "pos", "id", *[size(c).alias(f"n_{c}") for c in ("patterns", "sched_fwd", "sched_rev")], F.length("poly_fwd").alias("n_poly"))
    faults = archive.timetable_faults(routes)
    return shapes.groupBy("snapshot_date", "id").agg(*[F.max_by(c, "pos").alias(c) for c in shapes.columns if c.startswith("n_")]).join(faults, ["snapshot_date", "id"])


def backfill_daily(spark, sf):
    """Positions and snapshots as files, and every closed day backfilled from them."""
    layout = Layout(_fresh(spark, "positions"), _fresh(spark, "snapshots"), _fresh(spark, "derived"))
    archive.write_positions(ad.position_lines(ad.event_positions(spark, sf, days=3)), layout.positions, whole_days=True)
    _write_snapshots(spark, sf, layout.snapshots)
    backfill(spark, layout, dt.date(2024, 2, 1))
    return tables.read_table(spark, layout.tables, "transit_stop_daily").withColumn("direction", F.col("direction").cast("int"))


def document_files(spark, sf):
    """Permit documents as one file each, read back and searched for their decisions."""
    root = _fresh(spark, "documents")
    tables.write_documents(ad.page_documents(spark, sf), root)
    return permits.permit_decisions(tables.read_documents(spark, f"{root}/*"))


def exported_features(spark, sf):
    """Stop results as GeoJSON lines, written, read back and taken apart."""
    root = _fresh(spark, "export")
    stops = ad.load(spark, sf, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("stop_id"),
        F.lit(41.7).alias("lat"), (F.col("s_suppkey") + 44.5).alias("lon"),
    )
    tables.export_geojson(_all_stats(spark, sf), stops, root)
    lines = spark.read.text(root)

    def part(path: str, kind: str = "string") -> Column:
        return F.get_json_object("value", path).cast(kind)

    return lines.select(
        part("$.type").alias("type"), part("$.geometry.type").alias("shape"), part("$.geometry.coordinates[0]", "double").alias("lon"),
        part("$.properties.stop_id").alias("stop_id"), part("$.properties.n_obs", "bigint").alias("n_obs"),
    )


def exported_csv(spark, sf):
    root = _fresh(spark, "export")
    stats = _all_stats(spark, sf)
    tables.export_csv(stats, root)
    return spark.read.schema(stats.schema).option("header", True).csv(root)


def history_sql(spark, sf):
    """The SQL functions: the daily and the hourly branch of the statistics together."""
    daily, hourly = _stop_tables(spark, sf)
    ledger = ad.event_arrivals(spark, sf).select(F.col("service_date").alias("date")).distinct()
    sql.register(spark, daily, hourly, ledger)
    span = "array('S0', 'S1'), DATE'2024-01-03', DATE'2024-01-28'"
    return spark.sql(f"""
        SELECT 'all' AS band, * FROM transit_history_stats({span}, 'weekday')
        UNION ALL SELECT 'pm_peak' AS band, * FROM transit_history_stats({span}, 'all', 'pm_peak')
        UNION ALL SELECT CAST(days AS STRING), CAST(first_date AS STRING), 0, 0, 0, 0, 0, NULL, NULL, NULL, NULL FROM transit_history_coverage()
    """)


def history_sql_hourly(spark, sf):
    """The hourly SQL function."""
    daily, hourly = _stop_tables(spark, sf)
    sql.register(spark, daily, hourly, ad.event_arrivals(spark, sf).select(F.col("service_date").alias("date")).distinct())
    return spark.sql("SELECT * FROM transit_history_hourly(array('S0', 'S1'), DATE'2024-01-03', DATE'2024-01-28', 'weekday')")


def billing_files(spark, sf):
    """Billing events written as JSON lines, read back and folded."""
    root = _fresh(spark, "billing")
    ad.billing_events(spark, sf).write.option("ignoreNullFields", "false").json(root)
    return _state_columns(subs.fold_events(tables.read_billing_events(spark.read, root), None, "server"))


# Streams: the whole input in the files available now

def _streamed(spark, sf, table: str) -> DataFrame:
    schema = ad.load(spark, sf, table).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf)


def _run(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over what is there and reads back what it wrote."""
    spark = stream.sparkSession
    out, checkpoint = _fresh(spark, name), _fresh(spark, f"{name}-checkpoint")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def stream_rate_limit(spark, sf):
    asked = _streamed(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("client"), ad.utc_timestamp(F.col("ts")).alias("ts")
    )
    found = _run(rate_limit_stream(asked, (1, "15 minutes")), "complete", "limits")
    return found.select("client", F.unix_seconds("window_start").alias("window_s"), "n", "rejected")


def stream_sample_pairs(spark, sf):
    """All pairs of the stream; a heartbeat long after the last sample moves the watermark past it."""
    samples = valid_samples(ad.positions_of(_streamed(spark, sf, "events")))
    beat = spark.range(1).select(*[(F.lit("heartbeat") if f.name == "vehicle_id" else F.lit(4e12) if f.name == "ts_ms" else F.lit(None)).cast(f.dataType).alias(f.name) for f in samples.schema])
    path = _fresh(spark, "heartbeat")
    beat.write.parquet(path)
    whole = samples.unionByName(spark.readStream.schema(beat.schema).parquet(path))
    return _pair_columns(_run(positions.pair_stream(whole), "append", "pairs"))


def stream_positions(spark, sf):
    """Archive files as a stream, followed in three passes as days are archived; only open days are listed."""
    root, out, checkpoint = _fresh(spark, "positions"), _fresh(spark, "followed"), _fresh(spark, "follow-checkpoint")
    lines = ad.position_lines(ad.event_positions(spark, sf, days=3))
    for day in range(3):
        own = F.floor(F.col("ts_ms") / cal.DAY_MS) % 3 == day
        archive.write_positions(lines.where(own), root, writer=f"w{day}", whole_days=True)

        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        positions.follow_positions(spark, root, keep, checkpoint)
    samples = valid_samples(spark.read.parquet(out))
    return samples.groupBy("service_date", "pattern_suffix").agg(
        F.count("*").alias("samples"), F.min("ts_ms").cast("long").alias("first_ms"), F.max("ts_ms").cast("long").alias("last_ms"), F.count_distinct("vehicle_id").alias("vehicles")
    )


def stream_hourly_counts(spark, sf):
    arrivals = ad.arrivals_of(_streamed(spark, sf, "events")).withColumn("arrived_at", cal.from_epoch_ms(F.col("ts_ms")))
    found = _run(positions.hourly_counts(arrivals, offset_hours=0), "complete", "hourly")
    return found.withColumnRenamed("service_date", "date")


def stream_state_resumed(spark, sf):
    """Earlier and later events through two checkpoints: the second stream goes on from the first one's state."""
    root = _fresh(spark, "state")
    events = ad.billing_of(_streamed(spark, sf, "events"))
    halfway = F.lit("2024-01-16T00:00:00Z").cast("timestamp")
    for part in (events.where(F.col("received_at") < halfway), events.where(F.col("received_at") >= halfway)):
        writer = billing.keep_state(part, root, _fresh(spark, "state-checkpoint"))
        writer.trigger(availableNow=True).start().awaitTermination()
    return _state_columns(billing.read_state(spark, root))


def stream_hourly_medians(spark, sf):
    """The stop-hour table with exact medians, kept up from a stream of arrivals."""
    root = _fresh(spark, "hourly")
    arrivals = ad.arrivals_of(_streamed(spark, sf, "events"))
    writer = positions.keep_hourly(arrivals, root, _fresh(spark, "hourly-checkpoint"), offset_hours=0)
    writer.trigger(availableNow=True).start().awaitTermination()
    table = tables.read_table(spark, root, "transit_stop_hourly")
    return table.select(*[F.col(n).cast("int").alias(n) if t == "smallint" else F.col(n) for n, t in table.dtypes])


def stream_subscription_state(spark, sf):
    root = _fresh(spark, "state")
    writer = billing.keep_state(ad.billing_of(_streamed(spark, sf, "events")), root, _fresh(spark, "state-checkpoint"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return _state_columns(billing.read_state(spark, root))


# Subscriptions

def _state(policy: str, with_current: bool = False) -> Query:
    def run(spark, sf):
        current = None
        if with_current:
            current = ad.customer_subscriptions(spark, sf).where(F.col("status") != "past_due")
        state = subs.fold_events(ad.billing_events(spark, sf), current, policy)
        return _state_columns(state)

    return run


def _state_columns(state: DataFrame) -> DataFrame:
    return state.select(
        "user_id", "plan", "status", "paddle_subscription_id", "billing_interval",
        _ms(F.col("current_period_end")).alias("period_end_ms"), "paddle_customer_id",
        _ms(F.col("subscription_started_at")).alias("started_ms"), _ms(F.col("updated_at")).alias("updated_ms"),
    )


def marketing_consent(spark, sf):
    return subs.marketing_consents(ad.billing_events(spark, sf))


def trial_maintenance(spark, sf):
    kept = subs.trial_maintenance(ad.customer_subscriptions(spark, sf), AS_OF)
    return kept.select("user_id", "plan", "status", "trial_active", _ms(F.col("trial_ends_at")).alias("trial_ends_ms"))


def maintenance_counts(spark, sf):
    return subs.maintenance_counts(ad.customer_subscriptions(spark, sf), AS_OF).withColumnRenamed("count", "rows_touched")


def trial_reminders(spark, sf):
    found = subs.trial_reminders(ad.customer_subscriptions(spark, sf), ad.customer_users(spark, sf), AS_OF)
    return found.select("user_id", "email", "reminder", _ms(F.col("trial_ends_at")).alias("trial_ends_ms"))


def _cancellation(policy: str) -> Query:
    def run(spark, sf):
        found = subs.cancellation_decisions(ad.customer_subscriptions(spark, sf), AS_OF, policy)
        return found.withColumn("days_until_end", half_up(F.col("days_until_end"), 4))

    return run


def account_view(spark, sf):
    view = subs.account_view(
        ad.customer_users(spark, sf), ad.customer_profiles(spark, sf), ad.customer_subscriptions(spark, sf).where(
            F.col("status") != "canceled")
    )
    return view.withColumn("period_end", _ms(F.col("period_end"))).withColumnRenamed("period_end", "period_end_ms")


# Access and records

def _visible(uid: str, table: str) -> Query:
    def run(spark, sf):
        return access.visible_rows(
            ad.order_usage(spark, sf), table, access.Caller(uid),
            profiles=ad.customer_profiles(spark, sf), subscriptions=ad.customer_subscriptions(spark, sf),
        )

    return run


def entitled_users(spark, sf):
    return access.entitled_users(ad.customer_subscriptions(spark, sf))


def checked_writes(spark, sf):
    return access.checked_writes(
        ad.customer_profiles(spark, sf).select("id", "full_name", "is_admin"), "profiles", "update", access.Caller("7")
    )


def deletion_requests(spark, sf):
    requests = ad.order_usage(spark, sf).withColumn("completed_at", F.lit(None).cast("timestamp"))
    done = ad.order_usage(spark, sf).where(F.col("status") == "F").select("id")
    marked = access.complete_requests(requests, done, AS_OF)
    return marked.select("id", "user_id", "status", _ms(F.col("completed_at")).alias("completed_ms"))


def purged_users(spark, sf):
    gone = ad.customer_users(spark, sf).where(F.col("email").isNull())
    return access.purge_users(ad.order_usage(spark, sf), gone)


def _stored_parcels(spark, sf):
    return ad.load(spark, sf, "customer").select(
        F.col("c_custkey").alias("cadastral"), F.col("c_name").alias("owner"), F.col("c_acctbal").alias("area"),
        F.col("c_mktsegment").alias("zone"),
    )


def merge_records(spark, sf):
    """Order rows upserted into customer records; the latest order of a key applies last."""
    incoming = ad.load(spark, sf, "orders").select(
        (F.col("o_custkey") + 50).alias("cadastral"), F.col("o_orderkey").alias("seq"),
        F.col("o_orderpriority").alias("zone"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("area"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("zone"), F.lit("area"))).otherwise(F.array(F.lit("area"))).alias("given"),
    )
    return records.merge_records(_stored_parcels(spark, sf), incoming, "cadastral", "seq", "given")


def replace_groups(spark, sf):
    """Orders of a customer replaced as a group by that customer's line-item rows."""
    existing = ad.load(spark, sf, "orders").select(
        F.col("o_custkey").alias("cadastral"), F.col("o_orderkey").alias("owner_id"), F.col("o_orderstatus").alias("owner_type")
    )
    incoming = ad.load(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("cadastral"), F.col("l_orderkey").alias("owner_id"), F.col("l_returnflag").alias("owner_type")
    )
    return records.replace_groups(existing, incoming, "cadastral")


def emptied_groups(spark, sf):
    """Customers of a segment replaced by that segment's rows above a balance; named segments become empty."""
    customers = ad.load(spark, sf, "customer").select(F.col("c_mktsegment").alias("cadastral"), F.col("c_custkey").alias("owner_id"), "c_acctbal")
    incoming = customers.where((F.col("cadastral") == "BUILDING") & (F.col("c_acctbal") > 5000))
    gone = customers.where(F.col("cadastral") == "MACHINERY").select("cadastral").distinct()
    return records.replace_groups(customers, incoming, "cadastral", gone).select("cadastral", "owner_id")


def consented_profiles(spark, sf):
    """Profiles with the consents of billing events applied."""
    profiles = ad.customer_profiles(spark, sf)
    return subs.apply_consents(profiles, subs.marketing_consents(ad.billing_events(spark, sf))).select("id", "marketing_consent")


def owner_batches(spark, sf):
    """Turns of conversations as batches: one full row, some malformed on purpose, then up to 119 short ones."""
    first = (
        F.when(F.col("turn") % 5 == 4, F.to_json(F.struct(F.col("conv_id").alias("cadastral"))))
        .when(F.length("text") % 11 == 0, F.to_json(F.struct(F.col("role").alias("cadastral"), F.col("turn").alias("extra"))))
        .otherwise(F.to_json(F.struct(F.col("role").alias("cadastral"), F.col("text").alias("owner_name"))))
    )
    more = F.array_repeat(F.to_json(F.struct(F.col("role").alias("cadastral"))), (F.col("conv_id") * 7 + F.col("turn") * 13).cast("int") % 120)
    turns = ad.load(spark, sf, "conversations")
    bodies = turns.select(
        F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("batch_id"),
        F.concat(F.lit("["), F.array_join(F.concat(F.array(first), more), ","), F.lit("]")).alias("body"),
    )
    return records.check_owner_batches(bodies)


def parcel_checks(spark, sf):
    """Events' JSON properties as parcel bodies, a text key added to some."""
    body = F.when(F.col("event_id") % 3 == 0, F.replace("props", F.lit("{"), F.lit('{"cadastral": "c", '))).when(
        F.col("event_id") % 3 == 1, F.replace("props", F.lit('"k"'), F.lit('"cadastral"'))
    ).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    rows = ad.load(spark, sf, "events").select("event_id", body.alias("body"))
    return records.check_parcels(rows).select("event_id", "accepted")


# Documents

def page_text(spark, sf):
    return ad.load(spark, sf, "pages").select("page_id", tx.trim_space(tx.plain_text(F.col("html"))).alias("plain"))


def page_items(spark, sf):
    """Text of the list items of each page."""
    items = tx.list_items(F.col("html"))
    return ad.load(spark, sf, "pages").select(
        "page_id", F.size(items).alias("items"), F.array_join(items, " | ").alias("joined")
    )


def code_extract(spark, sf):
    """Property codes written into page texts at two places, with a repeat."""
    key = F.col("page_id")
    code = F.format_string("%02d.%02d.%02d.%03d.%03d", key % 97, key % 13, key % 7, key % 501, key % 333)
    other = F.format_string("%02d.%02d.%02d.%03d.%03d", key % 89, key % 17, key % 5, key % 401, key % 777)
    body = F.concat(code, F.lit(" "), F.col("html"), F.lit(" "), other, F.lit(" "), code)
    return ad.load(spark, sf, "pages").select("page_id", F.array_join(tx.property_codes(body), ",").alias("codes"))


def permit_decisions(spark, sf):
    return permits.permit_decisions(ad.page_documents(spark, sf))


def permit_details(spark, sf):
    found = permits.permit_details(ad.page_replies(spark, sf))
    return found.withColumn("cadastral", F.array_join("cadastral", ","))


# Usage and places

def rate_limit_audit(spark, sf):
    """Clients with more than two requests in 15 minutes."""
    found = usage.rate_limit_audit(ad.event_requests(spark, sf), (1, "15 minutes"))
    return found.select("client", F.unix_seconds("window_start").alias("window_s"), "n", "rejected")


def monthly_activity(spark, sf):
    return usage.monthly_activity(ad.event_usage(spark, sf))


def quota_status(spark, sf):
    overrides = ad.load(spark, sf, "customer").where(F.col("c_custkey") % 4 == 1).select(
        F.col("c_custkey").cast("string").alias("user_id"), (F.col("c_custkey") % 60 + 20).alias("monthly_limit")
    )
    return usage.quota_status(
        usage.monthly_activity(ad.event_usage(spark, sf)), ad.customer_subscriptions(spark, sf), overrides
    )


def diversity_index(spark, sf):
    return places.diversity_index(ad.event_amenities(spark, sf)).withColumn("shannon", half_up(F.col("shannon"), 6))


def relief_summary(spark, sf):
    found = places.relief_summary(ad.part_cells(spark, sf))
    return found.withColumn("height_mean", half_up(F.col("height_mean"), 4)).withColumn(
        "solar_share", half_up(F.col("solar_share"), 6)
    )


def relief_classes(spark, sf):
    return places.relief_classes(ad.part_cells(spark, sf))


def tile_boxes(spark, sf):
    box = places.tile_boxes(ad.part_tiles(spark, sf))
    return box.select("z", "x", "y", *[half_up(F.col(c), 3).alias(c) for c in ("west", "south", "east", "north")])


def service_hours(spark, sf):
    """Requests inside service hours, by local hour and archive key."""
    requests = ad.event_requests(spark, sf).withColumn("ms", cal.epoch_ms(F.col("ts")))
    day, hhmm = cal.local_key_parts(F.col("ms"))
    hour = cal.local_hour(F.col("ms"))
    return (
        requests.where(cal.in_service_hours(hour))
        .groupBy(day.alias("folder"), hhmm.alias("stem"), cal.hour_band(hour).alias("band"), cal.iso_week(day).alias("iso_week"))
        .agg(F.count("*").alias("n"))
    )


QUERIES: dict[str, Query] = {
    "stop_daily": stop_daily,
    "stop_hourly": stop_hourly,
    "observed_headways": observed_headways,
    "excess_wait": excess_wait,
    "bucketed_quantiles": bucketed_quantiles,
    "history_stats_all": _history("all", "all"),
    "history_stats_weekday": _history("weekday", "all"),
    "history_stats_v1": _history(None, "all"),
    "history_stats_am_peak": _history("all", "am_peak"),
    "history_stats_midday_sat": _history("sat", "midday"),
    "history_stats_pm_peak": _history("weekday", "pm_peak"),
    "history_stats_evening_sun": _history("sun", "evening"),
    "history_stats_unknown_band": _history("all", "night"),
    "history_stats_null_band": _history("all", None),
    "history_hourly": history_hourly,
    "history_hourly_area": history_hourly_area,
    "history_coverage": history_coverage,
    "derive_ledger": derive_ledger,
    "area_reliability": area_reliability,
    "area_medians": area_medians,
    "stop_measures": stop_measures,
    "worst_stops": worst_stops,
    "worst_stops_all": worst_stops_all,
    "report_routes": report_routes,
    "route_measures": route_measures,
    "worst_route": worst_route,
    "sample_pairs": sample_pair_rows,
    "stop_arrivals": stop_arrivals,
    "arrival_delays": arrival_delays,
    "derived_stop_daily": derived_stop_daily,
    "segment_speeds": segment_speeds,
    "segment_weekly_merge": _weekly("merge"),
    "segment_weekly_last_day": _weekly("last_day"),
    "network_patterns": network_patterns,
    "network_sequences": network_sequences,
    "network_headways": network_headways,
    "network_vertices": network_vertices,
    "routes_with_patterns": routes_with_patterns,
    "flattened_replies": flattened_replies,
    "collected_positions": collected_positions,
    "collected_twice": collected_twice,
    "compacted_positions": compacted_positions,
    "arrivals_archive": arrivals_archive,
    "stored_history": stored_history,
    "stored_hourly": stored_hourly,
    "stored_weekly": stored_weekly,
    "stored_ledger": stored_ledger,
    "derive_job_daily": derive_job_daily,
    "derive_job_ledger": derive_job_ledger,
    "derive_job_rerun": derive_job_rerun,
    "snapshot_routes": snapshot_routes,
    "backfill_daily": backfill_daily,
    "document_files": document_files,
    "stream_positions": stream_positions,
    "exported_features": exported_features,
    "exported_csv": exported_csv,
    "history_sql": history_sql,
    "history_sql_hourly": history_sql_hourly,
    "billing_files": billing_files,
    "stream_rate_limit": stream_rate_limit,
    "stream_sample_pairs": stream_sample_pairs,
    "stream_hourly_counts": stream_hourly_counts,
    "stream_subscription_state": stream_subscription_state,
    "stream_state_resumed": stream_state_resumed,
    "stream_hourly_medians": stream_hourly_medians,
    "snapshot_asof": snapshot_asof,
    "pending_days": pending,
    "subscription_state": _state("server"),
    "subscription_state_edge": _state("edge"),
    "subscription_state_on_current": _state("server", with_current=True),
    "marketing_consent": marketing_consent,
    "trial_maintenance": trial_maintenance,
    "maintenance_counts": maintenance_counts,
    "trial_reminders": trial_reminders,
    "cancellation_policy": _cancellation("server"),
    "cancellation_policy_edge": _cancellation("edge"),
    "account_view": account_view,
    "visible_rows": _visible("7", "feature_usage"),
    "visible_rows_admin": _visible("11", "feature_usage"),
    "entitled_rows": _visible("6", "analysis_results"),
    "entitled_rows_denied": _visible("8", "analysis_results"),
    "entitled_users": entitled_users,
    "checked_writes": checked_writes,
    "deletion_requests": deletion_requests,
    "purged_users": purged_users,
    "merge_records": merge_records,
    "replace_groups": replace_groups,
    "emptied_groups": emptied_groups,
    "consented_profiles": consented_profiles,
    "owner_batches": owner_batches,
    "parcel_checks": parcel_checks,
    "page_text": page_text,
    "page_items": page_items,
    "code_extract": code_extract,
    "permit_decisions": permit_decisions,
    "permit_details": permit_details,
    "rate_limit_audit": rate_limit_audit,
    "monthly_activity": monthly_activity,
    "quota_status": quota_status,
    "diversity_index": diversity_index,
    "relief_summary": relief_summary,
    "relief_classes": relief_classes,
    "tile_boxes": tile_boxes,
    "service_hours": service_hours,
}


def queries() -> dict[str, Query]:
    def plain(run: Query) -> Query:
        return lambda spark, sf: _dates_as_text(run(spark, sf))

    return {name: plain(run) for name, run in QUERIES.items()}
