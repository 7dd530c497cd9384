"""Operators whose work must not grow with a whole timetable, line or ranking in one task."""

from __future__ import annotations

import datetime as dt
import random
import time

from conftest import TESTDATA, rows
from pyspark.sql import functions as F

from stopclock.operators import arrivals, history, network
from stopclock.operators.presence import may_meet
from stopclock.operators.traces import valid_samples
from stopclock.plans import adapters as ad
from stopclock.plans import derive
from stopclock.session import Staging

SF = str(TESTDATA / "sf0.001")
DAY = dt.date(2026, 7, 13)


def test_schedule_of_two_thousand_entries(spark):
    """Against the whole list, with repeated times, ties on both sides, and times around and after midnight."""
    rng = random.Random(6)
    times = [rng.randrange(0, 100_000) for _ in range(1500)] + [rng.randrange(30_000, 31_000) for _ in range(498)] + [43_200, 43_400]
    rng.shuffle(times)
    sparse = [7000, 9400, 9399]
    # Local midnight is 20:00 UTC of the day before.
    zero = dt.datetime(2026, 7, 12, 20, tzinfo=dt.UTC).timestamp()
    asked = [("m", "A", rng.uniform(0, 86_400)) for _ in range(300)] + [("m", "A", 43_300.0), ("m", "A", 0.0), ("m", "A", 86_399.9)]
    asked += [("m", "B", float(s)) for s in (5799, 5800, 8200, 8199.5, 10_599, 10_600, 10_601, 20_000)] + [("m", "C", 100.0), ("n", "A", 100.0)]
    table = spark.createDataFrame([("m", "A", times), ("m", "B", sparse), ("m", "C", [])], "model_id string, stop_id string, times array<int>")
    found = arrivals.match_schedule(
        spark.createDataFrame([(DAY, "R", 1, m, s, (zero + at) * 1000) for m, s, at in asked], "service_date date, route_id string, direction int, model_id string, stop_id string, ts_ms double"), table
    )
    lists = {("m", "A"): times, ("m", "B"): sparse}
    expected = []
    for m, s, at in asked:
        at = ((zero + at) * 1000) / 1000 - zero
        best = min(((abs(at - t), i, t) for i, t in enumerate(lists.get((m, s), []))), default=None)
        delay = int((at - best[2] + 0.5) // 1) if best and best[0] <= 1200 else None
        expected.append((s, delay))
    assert sorted(((r.stop_id, r.delay_s) for r in found.collect()), key=repr) == sorted(expected, key=repr)


def test_entries_looked_at_are_few(spark):
    table = spark.createDataFrame([("m", "A", list(range(0, 86_400, 60)))], "model_id string, stop_id string, times array<int>")
    reach = arrivals._within_reach(table).selectExpr("max(size(entries)) as most", "sum(size(entries)) as total").first()
    assert reach.most == 60 and reach.total == 3 * 1440


def test_ranks_without_one_task(spark):
    data = [(f"s{i}", 100, (i * 7919 % 1000) / 1000) for i in range(5000)] + [("n", 50, None), ("m", 50, None)]
    table = spark.createDataFrame(data, "stop_id string, n_matched long, on_time_share double").repartition(6)
    found = history.global_rank(table, ["on_time_share", "stop_id"], "rank")
    order = sorted(data, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    assert rows(found) == sorted(((*r, k) for k, r in enumerate(order, 1)), key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    assert history.global_rank(table.limit(0), ["on_time_share", "stop_id"], "rank").count() == 0


def vertices_of(spark, lines):
    data = [(m, i, float(lat), float(lon), float(i)) for m, line in lines.items() for i, (lat, lon) in enumerate(line)]
    return spark.createDataFrame(data, "model_id string, idx int, lat double, lon double, cum_m double")


def test_cells_hold_every_nearest_vertex(spark):
    """Random points in and near the cells of lines with short and long edges, loops and repeated vertices."""
    from stopclock.operators import network

    rng = random.Random(5)
    walk, lat, lon = [], 41.7, 44.7
    for k in range(300):
        step = rng.choice([1e-5, 2e-4, 3e-3, 4e-2]) if k % 40 else 0.0
        lat, lon = lat + rng.uniform(-1, 1) * step, lon + rng.uniform(-1, 1) * step
        walk.append((lat, lon))
    lines = {"walk": walk, "loop": [(41.7 + 0.01 * (k % 2), 44.7) for k in range(9)], "one": [(41.7, 44.7)], "far": [(41.7, 44.7), (42.3, 44.7), (42.3, 44.701)]}
    size = network.CELL_DEG
    for r in network.lookup_cells(vertices_of(spark, lines)).sample(0.05, seed=2).collect():
        listed = {v.idx for v in r.near}
        for _ in range(4):
            y, x = (r.cell_y + rng.random()) * size, (r.cell_x + rng.random()) * size
            best = min((((a - y) ** 2 + (b - x) ** 2), i) for i, (a, b) in enumerate(lines[r.model_id]))
            assert best[1] in listed
        assert [v.idx for v in r.near] == sorted(listed)


def test_cells_of_a_long_line_meet_few_vertices(spark):
    from stopclock.operators import network

    line = [(41.0 + k * 2e-4, 44.0 + (k % 50) * 1e-5) for k in range(20_000)]
    found = network.lookup_cells(vertices_of(spark, {"long": line})).selectExpr("count(*) as n", "max(size(near)) as most", "sum(size(near)) as total").first()
    assert found.n > 20_000 and found.most <= 20 and found.total < 20 * found.n
    # What a cell meets before the distances are compared is bounded as well.
    touched = network._touched_cells(vertices_of(spark, {"long": line}), network.CELL_DEG)
    assert touched.selectExpr("max(bound) as b").first().b < 2e-4


def test_rows_with_timetables_are_neither_collected_nor_sorted(spark):
    """A route's timetables take many times the room of its row in a file, so no plan may broadcast them for a file's size."""
    days = network.snapshot_for_days(ad.route_days(spark), ad.route_snapshots(spark))
    built = network.build_network(days, ad.customer_stops(spark, SF), ad.customer_routes(spark, SF))
    plan = built.vertices._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "entry" in line]
    assert len(joins) == 2 and all("ShuffledHashJoin" in line for line in joins)
    assert "partial_max_by(entry" not in plan
    # The cells around a line meet its vertices and levels without a broadcast.
    plan = built.cells._jdf.queryExecution().sparkPlan().toString()
    met = [line for line in plan.splitlines() if "Join" in line and "_model" in line or "_sx" in line and "Join" in line]
    assert len(met) == 2 and all("SortMergeJoin" in line for line in met)


def test_small_files_of_large_rows_are_not_broadcast(spark):
    """A table whose repeated values take little room in files, but more than the broadcast limit in memory."""
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    text = F.repeat(F.lit("timetable "), 100)
    wide = spark.range(limit // 500).select("id", F.array(F.struct(text.alias("a"))).alias("stops"))
    narrow = spark.range(10).select("id", F.lit("x").alias("b"))
    with Staging(spark) as staging:
        plans = [spark.range(1 << 20).join(staging.stage_sized(t, "t"), "id")._jdf.queryExecution().sparkPlan().toString() for t in (wide, narrow)]
        assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" in plans[1]
        assert staging.stage_sized(wide, "t").count() == limit // 500


def test_timetable_rows_of_one_stop_are_taken_together(spark):
    """Rows that repeat a stop, nulls and repeated times; every time once, with its first place in any row, after one shuffle."""
    data = [("m", "A", [25_000, None, 1200, 25_000, 2399]), ("m", "A", [2399, 90]), ("m", "A", None), ("m", "B", []), (None, "A", [5, 5]), ("m", None, [1])]
    found = arrivals._within_reach(spark.createDataFrame(data, "model_id string, stop_id string, times array<int>"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    expected = {}
    for m, s, times in data:
        for pos, t in enumerate(times or []):
            for span in range(t // 1200 - 1, t // 1200 + 2) if t is not None else ():
                best = expected.setdefault((m, s, span), {})
                best[t] = min(pos, best.get(t, pos))
    assert {(r.model_id, r.stop_id, r.span): sorted(map(tuple, r.entries)) for r in found.collect()} == {k: sorted(v.items()) for k, v in expected.items()}


class Watched(Staging):
    """Notes how each table is made."""

    plans: dict[str, str] = {}

    def stage(self, df, label):
        self.plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return super().stage(df, label)


def test_cells_are_joined_where_their_models_lie(spark):
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    days = network.snapshot_for_days(ad.route_days(spark), ad.route_snapshots(spark))
    built = network.build_network(days, ad.customer_stops(spark, SF), ad.customer_routes(spark, SF))
    with Watched(spark) as staging:
        staged = built.staged(staging)
        shuffles = [line for line in staging.plans["cells"].splitlines() if "Exchange hashpartitioning" in line]
        assert shuffles and not any("sx#" in line or "cell_x#" in line or "x#" in line for line in shuffles)
        near = F.to_json("near").alias("near")
        assert rows(staged.cells.select("model_id", "cell_x", "cell_y", near)) == rows(built.cells.select("model_id", "cell_x", "cell_y", near))
    assert spark.conf.get(name) == "true"


def test_cells_without_samples_are_not_shuffled(spark, monkeypatch):
    """Of a network that is too large for a broadcast, cells that no sample lies in stay out of the join; rows are the same."""
    samples = valid_samples(ad.event_positions(spark, SF)).withColumn("lat", F.expr("if(pmod(hash(vehicle_id, ts_ms), 5) = 0, lat + 0.3, lat)"))
    plain = derive.located_pairs(samples, ad.line_network(spark))
    limit = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, "1000")
    try:
        with Staging(spark) as staging:
            net = ad.line_network(spark).staged(staging)
            assert {"cells", "timetable"} <= net.large
            kept = []
            monkeypatch.setattr(derive, "may_meet", lambda *a: kept.append(may_meet(*a)) or kept[-1])
            found = derive.located_pairs(samples, net)
            assert rows(found) == rows(plain)
            assert 0 < kept[0].count() < net.cells.count() / 2
            keys = ["model_id", "cell_x", "cell_y"]
            assert net.cells.join(kept[0], keys, "left_anti").join(kept[0], keys).count() == 0
            joins = [line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line and "cell_x" in line]
            assert len(joins) == 2 and all("SortMergeJoin" in line for line in joins)
    finally:
        spark.conf.unset(limit)


def test_shuffle_files_go_with_their_step(spark):
    """No shuffle of a staged table stays until the driver is short of memory."""
    limit, jvm = "spark.sql.autoBroadcastJoinThreshold", spark.sparkContext._jvm
    statuses = jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    joined = spark.range(1000).selectExpr("id % 7 as k").join(spark.range(7).withColumnRenamed("id", "k"), "k").groupBy("k").count()
    for _ in range(3):
        jvm.System.gc()
        time.sleep(0.5)
    before = statuses.size()
    spark.conf.set(limit, "-1")
    try:
        with Staging(spark) as staging:
            counted = staging.stage(joined, "t")
            for _ in range(50):
                if (left := statuses.size()) <= before:
                    break
                time.sleep(0.1)
            assert left <= before and counted.count() == 7
    finally:
        spark.conf.unset(limit)
