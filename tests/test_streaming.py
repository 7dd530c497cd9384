"""Streams give what the batch gives on in-order input."""

from __future__ import annotations

import pytest
from conftest import TESTDATA, rows
from pyspark.sql import functions as F

from stopclock.operators import subscriptions as subs
from stopclock.operators.stop_metrics import stop_hourly
from stopclock.operators.traces import TRACE_KEYS, sample_pairs, valid_samples
from stopclock.operators.usage import rate_limit_audit
from stopclock.plans import adapters as ad
from stopclock.sources import archive, publish, tables
from stopclock.streaming import billing, positions, requests

SF = str(TESTDATA / "sf0.001")
pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="no test data")


def replay(spark, df, order, path, pieces=3):
    """The rows as a stream of files in time order."""
    edges = df.approxQuantile(order, [i / pieces for i in range(1, pieces)], 0.0)
    rest = df
    for i, edge in enumerate([*edges, None]):
        part = rest if edge is None else rest.where(F.col(order) <= edge)
        part.coalesce(1).write.mode("append").parquet(f"{path}/piece={i}")
        rest = rest if edge is None else rest.where(F.col(order) > edge)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def finish(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert not query.isActive and query.exception() is None


COLUMNS = [*TRACE_KEYS, "a_ts_ms", "b_ts_ms", "a_next_stop_id", "b_next_stop_id", "dt_ms"]


def paired(spark, stream, tmp_path, **settings):
    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={batch_id}"))

    finish(positions.pair_stream(stream, **settings).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")))
    return spark.read.parquet(str(tmp_path / "out")).select(*COLUMNS)


def with_heartbeat(spark, samples, after_ms=3_600_000):
    """A sample of no vehicle later than all others, which moves the watermark past them."""
    last = samples.agg(F.max("ts_ms")).first()[0]
    names = samples.columns
    beat = samples.limit(1).withColumns({"vehicle_id": F.lit("heartbeat"), "ts_ms": F.lit(last + after_ms)})
    return samples.unionByName(beat.select(*names))


@pytest.mark.parametrize("slice_ms", [3_600_000, 120_000])
def test_pairs(spark, tmp_path, slice_ms):
    samples = valid_samples(ad.event_positions(spark, SF)).where(F.col("vehicle_id") < "2")
    stream = replay(spark, with_heartbeat(spark, samples), "ts_ms", tmp_path / "in")
    got = paired(spark, stream, tmp_path, slice_ms=slice_ms)
    assert rows(got) == rows(sample_pairs(samples).select(*COLUMNS))
    assert got.count() > 100


def test_pairs_of_ties_and_late_samples(spark, tmp_path):
    """Equal instants, repeated samples and a sample that comes a batch late but before the watermark; then one that is too late."""
    start = 1_783_900_800_000.0
    names = "service_date string, vehicle_id string, route_id string, pattern_suffix string, ts_ms double, lat double, lon double, next_stop_id string"

    def sample(second, lat=1.0, stop="A", vehicle="v", suffix="0"):
        return ("2026-07-13", vehicle, "R", suffix, start + 1000 * second, lat, 2.0, stop)

    first = [sample(0), sample(0), sample(0, 2.0), sample(60), sample(60, stop=None), sample(200), sample(700), sample(0, vehicle="w", suffix=None), sample(10, vehicle="w", suffix=None)]
    second = [sample(130), sample(900), sample(260, vehicle="heartbeat")]
    late = [sample(3, vehicle="late"), sample(4, vehicle="late"), sample(90_000, vehicle="heartbeat")]
    for i, part in enumerate((first, second, [sample(7200, vehicle="heartbeat")], late)):
        frame = spark.createDataFrame(part, names).withColumn("service_date", F.col("service_date").cast("date"))
        frame.coalesce(1).write.parquet(str(tmp_path / f"in/piece={i}"))
    schema = frame.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = paired(spark, stream, tmp_path)
    whole = spark.createDataFrame(first + second, names).withColumn("service_date", F.col("service_date").cast("date"))
    assert rows(got) == rows(sample_pairs(whole).select(*COLUMNS))


def test_state_of_pairs_expires(spark, tmp_path):
    """Samples that nothing can pair with any more leave the state."""
    samples = valid_samples(ad.event_positions(spark, SF)).where(F.col("vehicle_id") < "2")
    stream = replay(spark, with_heartbeat(spark, samples, 30 * 86_400_000), "ts_ms", tmp_path / "in")
    found = positions.pair_stream(stream).writeStream.foreachBatch(lambda batch, _: batch.write.format("noop").mode("overwrite").save())
    query = found.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    left = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]
    assert max(left) > 100 and left[-1] <= 3


def test_subscription_state(spark, tmp_path):
    events = ad.billing_events(spark, SF)
    stream = replay(spark, events.withColumn("s", F.unix_seconds("received_at").cast("double")), "s", tmp_path / "in", 4)
    finish(billing.keep_state(stream, str(tmp_path / "state"), str(tmp_path / "cp"), kept_versions=2, kept_hours=0))
    assert sorted(p.name for p in (tmp_path / "state/_published").glob("0*.json")) == ["000000000003.json", "000000000004.json"]
    assert rows(billing.read_state(spark, str(tmp_path / "state"))) == rows(subs.fold_events(events))


def test_subscription_state_goes_on_with_a_new_checkpoint(spark, tmp_path):
    """Each half of the events through a checkpoint of its own; a batch that is repeated changes nothing."""
    events = ad.billing_events(spark, SF)
    marked = events.withColumn("s", F.unix_seconds("received_at").cast("double"))
    halfway = marked.approxQuantile("s", [0.5], 0.0)[0]
    for i, part in enumerate((marked.where(F.col("s") <= halfway), marked.where(F.col("s") > halfway))):
        finish(billing.keep_state(replay(spark, part, "s", tmp_path / f"in{i}", 2), str(tmp_path / "state"), str(tmp_path / f"cp{i}")))
    expected = rows(subs.fold_events(events))
    assert rows(billing.read_state(spark, str(tmp_path / "state"))) == expected
    names = sorted(map(str, (tmp_path / "state").rglob("*")))
    commits = sorted((tmp_path / "cp1" / "commits").glob("[0-9]*"))
    for path in [*commits[-1:], *(tmp_path / "cp1" / "commits").glob(f".{commits[-1].name}.crc")]:
        path.unlink()
    again = spark.readStream.schema(marked.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in1"))
    finish(billing.keep_state(again, str(tmp_path / "state"), str(tmp_path / "cp1")))
    assert sorted(map(str, (tmp_path / "state").rglob("*"))) == names
    assert rows(billing.read_state(spark, str(tmp_path / "state"))) == expected


def test_only_touched_buckets_of_the_state_are_written(spark, tmp_path):
    events = ad.billing_events(spark, SF)
    root = tmp_path / "state"
    some = [r[0] for r in events.select("data.custom_data.user_id").where("user_id is not null").distinct().orderBy("user_id").limit(3).collect()]
    few = events.where(F.col("data.custom_data.user_id").isin(some))
    for i, part in enumerate((events, few)):
        part.coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        before = {str(p) for p in root.rglob("*.parquet")}
        versions = publish.newest(spark, str(root)).partitions(billing.STATE)
        stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / f"in{i}"))
        finish(billing.keep_state(stream, str(root), str(tmp_path / f"cp{i}"), buckets=16))
    after = publish.newest(spark, str(root)).partitions(billing.STATE)
    changed = {n for n in after if after[n] != versions[n]}
    assert len(after) > 5 and 1 <= len(changed) <= 3
    # Files of other buckets are those of the batch before, untouched.
    fresh = {str(p) for p in root.rglob("*.parquet")} - before
    assert fresh and {p.split("/")[-2] for p in fresh} == changed
    whole = subs.fold_events(events)
    assert rows(billing.read_state(spark, str(root)).where(~F.col("user_id").isin(some))) == rows(whole.where(~F.col("user_id").isin(some)))
    with pytest.raises(Exception, match="buckets"):
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in0"))
        finish(billing.keep_state(stream, str(root), str(tmp_path / "cp9"), buckets=8))


def test_a_batch_that_fails_before_its_commit_is_repeated_once(spark, tmp_path, monkeypatch):
    events = ad.billing_events(spark, SF)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    commit, calls = publish.Publication.commit, []

    def failing(self, marks=None):
        calls.append(marks)
        if len(calls) == 1:
            raise RuntimeError("lost")
        commit(self, marks)

    monkeypatch.setattr(publish.Publication, "commit", failing)
    for attempt in range(2):
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        query = billing.keep_state(stream, str(tmp_path / "state"), str(tmp_path / "cp")).trigger(availableNow=True).start()
        if attempt == 0:
            with pytest.raises(Exception, match="lost"):
                query.awaitTermination(100)
            assert billing.read_state(spark, str(tmp_path / "state")).count() == 0
        else:
            query.awaitTermination(100)
    assert rows(billing.read_state(spark, str(tmp_path / "state"))) == rows(subs.fold_events(events))


def test_hourly_table_goes_on_with_a_new_checkpoint(spark, tmp_path):
    arrivals = ad.event_arrivals(spark, SF)
    for i in range(2):
        stream = replay(spark, arrivals.where(F.floor("ts_ms") % 2 == i), "ts_ms", tmp_path / f"in{i}")
        finish(positions.keep_hourly(stream, str(tmp_path / "t"), str(tmp_path / f"cp{i}"), offset_hours=0))
    expected = tables.conform(stop_hourly(arrivals, 0), tables.SCHEMAS["transit_stop_hourly"][0])
    assert rows(tables.read_table(spark, str(tmp_path / "t"), "transit_stop_hourly")) == rows(expected)


def test_hourly_table(spark, tmp_path):
    arrivals = ad.event_arrivals(spark, SF)
    stream = replay(spark, arrivals, "ts_ms", tmp_path / "in")
    finish(positions.keep_hourly(stream, str(tmp_path / "t"), str(tmp_path / "cp"), offset_hours=0))
    expected = tables.conform(stop_hourly(arrivals, 0), tables.SCHEMAS["transit_stop_hourly"][0])
    assert rows(tables.read_table(spark, str(tmp_path / "t"), "transit_stop_hourly")) == rows(expected)


def test_hourly_counts(spark, tmp_path):
    arrivals = ad.event_arrivals(spark, SF).withColumn("arrived_at", F.timestamp_millis(F.floor("ts_ms").cast("long")))
    stream = replay(spark, arrivals, "ts_ms", tmp_path / "in")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(str(tmp_path / "out"))

    counts = positions.hourly_counts(stream, offset_hours=0)
    finish(counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")))
    columns = ["service_date", "stop_id", "route_id", "direction", "hour", "n_obs", "n_matched", "on_time", "late", "early"]
    expected = stop_hourly(arrivals, 0).withColumnRenamed("date", "service_date").select(*columns)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select(*columns)) == rows(expected)


def test_request_limits(spark, tmp_path):
    asked = ad.event_requests(spark, SF)
    stream = replay(spark, asked.withColumn("s", F.unix_micros("ts").cast("double")), "s", tmp_path / "in").drop("s")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(str(tmp_path / "out"))

    found = requests.rate_limit_stream(stream, (1, "15 minutes"))
    finish(found.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(rate_limit_audit(asked, (1, "15 minutes")))


def test_collection(spark, tmp_path):
    schema = "route_id string, short_name string, sampled_at timestamp, reply map<string,array<struct<vehicleId:string,lat:double,lon:double,nextStopId:string>>>"
    one = spark.createDataFrame([(1,)], "x int").select(
        F.lit("R1").alias("route_id"), F.lit("1").alias("short_name"), F.lit("2026-07-13T05:00:00Z").cast("timestamp").alias("sampled_at"),
        F.create_map(F.lit("0:01"), F.array(F.struct(F.lit("v").alias("vehicleId"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit("A").alias("nextStopId")))).alias("reply"))
    one.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    finish(positions.collect_positions(stream, str(tmp_path / "p"), str(tmp_path / "cp")))
    assert sorted(p.name for p in (tmp_path / "p").glob("service_date=2026-07-13/cycle=*-0/*.gz"))


def test_collection_with_two_checkpoints_keeps_all_samples(spark, tmp_path):
    schema = "route_id string, short_name string, sampled_at timestamp, reply map<string,array<struct<vehicleId:string,lat:double,lon:double,nextStopId:string>>>"
    at = F.lit("2026-07-13T05:00:00Z").cast("timestamp")
    for vehicle in ("a", "b"):
        found = F.create_map(F.lit("0:01"), F.array(F.struct(F.lit(vehicle).alias("vehicleId"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit("A").alias("nextStopId"))))
        spark.range(1).select(F.lit("R1").alias("route_id"), F.lit("1").alias("short_name"), at.alias("sampled_at"), found.alias("reply")).write.parquet(str(tmp_path / f"in-{vehicle}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"in-{vehicle}"))
        finish(positions.collect_positions(stream, str(tmp_path / "p"), str(tmp_path / f"cp-{vehicle}")))
    assert sorted(r.vehicle_id for r in archive.read_positions(spark, str(tmp_path / "p")).collect()) == ["a", "b"]
    assert sorted(r.vehicle_id for r in archive.read_collected_positions(spark, str(tmp_path / "p")).collect()) == ["a", "b"]


def test_archive_as_a_stream(spark, tmp_path):
    import gzip

    folder = tmp_path / "positions" / "2026-07-13"
    folder.mkdir(parents=True)
    line = '{"t":"2026-07-13T04:00:00Z","r":"R","p":"0","v":{"vehicleId":"v","lat":1.0,"lon":2.0,"nextStopId":"A"}}'
    (folder / "0800.ndjson.gz").write_bytes(gzip.compress((line + "\n\n{bad\n" + line).encode()))

    def keep(batch, batch_id):
        batch.write.mode("append").parquet(str(tmp_path / "out"))

    stream = valid_samples(positions.position_stream(spark, str(tmp_path / "positions")))
    finish(stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(str(r.service_date), r.vehicle_id, r.ts_ms) for r in got] == [("2026-07-13", "v", 1783915200000.0)] * 2
