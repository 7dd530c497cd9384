"""A small archive derived from files to tables, with values worked out by hand."""

from __future__ import annotations

import datetime as dt
import gzip
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from stopclock.operators import network
from stopclock.operators.quantiles import merge_histograms
from stopclock.plans import derive
from stopclock.session import Staging
from stopclock.sources import archive, tables

DAY = dt.date(2026, 7, 13)
NEXT = dt.date(2026, 7, 14)
LONS = {"A": 44.782, "B": 44.785, "C": 44.788, "D": 44.792}


def encode(points):
    """Points as an encoded polyline."""
    out, previous = "", (0, 0)
    for lat, lon in points:
        now = (round(lat * 1e5), round(lon * 1e5))
        for value, before in zip(now, previous, strict=True):
            number = (value - before) << 1
            number = ~number if value < before else number
            while number >= 32:
                out += chr((32 | (number & 31)) + 63)
                number >>= 5
            out += chr(number + 63)
        previous = now
    return out


LINE = encode([(41.7, 44.780 + i / 1000) for i in range(14)])


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode()))


def line(t, vehicle, lon, nxt, route="R1", suffix="0:01", lat=41.7):
    return json.dumps({"t": t, "r": route, "n": "1", "p": suffix, "v": {"vehicleId": vehicle, "lat": lat, "lon": lon, "nextStopId": nxt, "extra": 1}})


def stop_times(order, times):
    return [{"id": s, "arrivalTimes": times.get(s, "")} for s in order]


def run(day, hour, minute, vehicle):
    """One vehicle passing A, B and C in two minutes."""
    start = dt.datetime(day.year, day.month, day.day, hour, minute)
    later = start + dt.timedelta(minutes=2)
    stamp = "%Y-%m-%dT%H:%M:%S.000Z"
    return [line(start.strftime(stamp), vehicle, 44.780, "A"), line(later.strftime(stamp), vehicle, 44.790, "D")]


@pytest.fixture(scope="module")
def layout(tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")
    stops = [{"id": "A", "lat": 0.0, "lon": 0.0, "name": "old"}] + [
        {"id": s, "lat": 41.7, "lon": lon, "name": s} for s, lon in LONS.items()
    ]
    planned = {"A": "08:00,08:20,08:40", "B": "08:05", "C": "24:10"}
    forward = [
        {"serviceDates": ["2026-07-11"], "stops": stop_times("DCBA", {})},
        {"serviceDates": [str(DAY), str(NEXT)], "stops": stop_times("ABCD", planned)},
    ]
    reverse = [{"serviceDates": [], "stops": stop_times("DCBA", {"D": "09:00"})}, {"serviceDates": [], "stops": []}]
    patterns = [
        {"patternSuffix": "0:01", "firstStop": {"id": "A"}, "lastStop": {"id": "D"}},
        {"patternSuffix": "1:01", "firstStop": {"id": "D"}, "lastStop": {"id": "A"}},
        {"patternSuffix": "0:09", "firstStop": {"id": "Z"}, "lastStop": {"id": "D"}},
        {"patternSuffix": "9:99", "firstStop": {"id": "Y"}, "lastStop": {"id": "Y"}},
        {"patternSuffix": "9:98"},
    ]
    routes = [
        {"id": "R1", "detail": {"patterns": patterns}, "polyline": {"fwd": {"encodedValue": LINE}, "rev": None},
         "schedule": {"fwd": {"weekdaySchedules": forward}, "rev": {"weekdaySchedules": reverse}}},
        {"id": "R2", "detail": {"patterns": patterns[:1]}, "polyline": {"encodedValue": LINE}, "schedule": {"weekdaySchedules": forward}},
        {"id": "R3", "detail": None, "polyline": None, "schedule": None},
    ]
    for snapshot in ("2026-07-10", "2026-07-14"):
        put(root / "snapshots" / snapshot / "stops.json.gz", json.dumps(stops))
        put(root / "snapshots" / snapshot / "routes.json.gz", json.dumps(routes if snapshot < "2026-07-14" else routes[:1]))

    noise = ["", "{not json", json.dumps({"t": "2026-07-13T04:00:00Z", "r": "R1", "p": "0:01", "v": {"lat": 1, "lon": 1}}),
             line("2026-07-13T04:00:00Z", "n", 1.0, "A", lat=None), line("2026-07-13T04:00:00Z", "n", None, "A"),
             line("never", "n", 44.78, "A")]
    strangers = [line("2026-07-13T04:00:00Z", "u", 44.78, "A", suffix="9:99"), line("2026-07-13T04:00:00Z", "w", 44.78, "A", route="R3")]
    first = [x for minute, v in ((0, "v1"), (10, "v2"), (30, "v3"), (50, "v4")) for x in run(DAY, 4, minute, v)]
    put(root / "positions" / str(DAY) / "0800.ndjson.gz", "\n".join(first[:4] + noise))
    put(root / "positions" / str(DAY) / "0830.ndjson.gz", "\n".join(first[4:] + strangers))
    put(root / "positions" / str(NEXT) / "0800.ndjson.gz", "\n".join(x for m in (0, 5, 9) for x in run(NEXT, 4, m, "v1")))
    return derive.Layout(str(root / "positions"), str(root / "snapshots"), str(root / "tables"))


def test_positions(spark, layout):
    samples = archive.read_positions(spark, layout.positions, [DAY])
    assert {r.service_date for r in samples.collect()} == {DAY}
    figures = derive.rejected_samples(samples).first()
    assert figures.valid == 10 and figures.lines - figures.valid == figures.rejected >= 4


def test_days_and_files(spark, layout):
    assert rows(archive.archived_days(spark, layout.positions)) == [(DAY,), (NEXT,)]
    assert archive.archived_files(spark, layout.positions).count() == 3


def test_network(spark, layout):
    days = spark.createDataFrame([(DAY,), (NEXT,)], "service_date date")
    with Staging(spark) as staging:
        check_network(derive.load_network(spark, layout.snapshots, days, staging))


def check_network(net):
    matched = {(r.service_date, r.route_id, r.pattern_suffix): r.direction for r in net.patterns.collect()}
    assert matched == {
        (DAY, "R1", "0:01"): 1, (DAY, "R1", "1:01"): 0, (DAY, "R1", "0:09"): 1, (DAY, "R2", "0:01"): 1,
        (NEXT, "R1", "0:01"): 1, (NEXT, "R1", "1:01"): 0, (NEXT, "R1", "0:09"): 1,
    }
    order = {r.model_id: [(s.stop_id, s.lon) for s in r.stops] for r in net.sequences.collect()}
    assert order["2026-07-10|R1|1|1"] == list(LONS.items())
    assert [s for s, _ in order["2026-07-10|R1|0|0"]] == list("DCBA")
    listed = {r.stop_id: (r.times, r.headway_sched_s) for r in net.timetable.where(F.col("model_id") == "2026-07-10|R1|1|1").collect()}
    assert listed == {"A": ([28800, 30000, 31200], 1200.0), "B": ([29100], None), "C": ([87000], None), "D": ([], None)}
    assert net.vertices.where(F.col("model_id") == "2026-07-10|R1|1|1").count() == 14
    assert net.vertices.where(F.col("model_id") == "2026-07-10|R1|0|0").count() == 0
    planned = network.scheduled_headways(net).where(F.col("service_date") == F.lit(DAY)).collect()
    assert {(r.route_id, r.direction, r.stop_id, r.headway_sched_s) for r in planned} == {("R1", 1, "A", 1200.0), ("R2", 1, "A", 1200.0)}


def test_backfill(spark, layout):
    assert derive.backfill(spark, layout, NEXT) == [str(DAY)]
    daily = {r.stop_id: r for r in tables.read_table(spark, layout.tables, "transit_stop_daily").collect()}
    assert sorted(daily) == ["A", "B", "C"]
    a, b, c = daily["A"], daily["B"], daily["C"]
    # Passing A 24 s, B 60 s and C 96 s after 08:00, 08:10, 08:30 and 08:50, so A's delays
    # against 08:00, 08:20 and 08:40 are 24, -576, -576 and 624 and B's against 08:05 -240 and 360.
    assert (a.n_obs, a.n_matched, a.on_time, a.late, a.early) == (4, 4, 1, 1, 2)
    assert (a.delay_med_s, a.delay_p90_s) == (-276, 624)
    assert (a.headway_med_s, a.headway_sched_s, a.ewt_s) == (1200, 1200, 0)
    assert (b.n_obs, b.n_matched, b.delay_med_s, b.headway_sched_s, b.ewt_s) == (4, 2, 60, None, None)
    assert (c.n_obs, c.n_matched, c.delay_med_s) == (4, 0, None)
    hours = {(r.stop_id, r.hour): r.n_obs for r in tables.read_table(spark, layout.tables, "transit_stop_hourly").collect()}
    assert hours == {("A", 8): 4, ("B", 8): 4, ("C", 8): 4}
    week = tables.read_table(spark, layout.tables, "transit_segment_weekly").collect()
    assert {(r.iso_week, r.band, r.n) for r in week} == {("2026-W29", "am_peak", 4)}
    assert sorted(r.bin_idx for r in week) == [0, 1, 2, 3, 4, 5]
    assert {round(r.speed_med_kmh, 1) for r in week} == {24.9}
    log = tables.read_ledger(spark, layout.tables).first()
    assert (log.date, log.files, log.samples, log.arrivals, log.matched) == (DAY, 2, 10, 12, 6)


def test_next_day_and_weekly_modes(spark, layout):
    assert derive.backfill(spark, layout, dt.date(2026, 7, 20)) == [str(NEXT)]
    assert derive.backfill(spark, layout, dt.date(2026, 7, 20)) == []
    assert {r.n for r in tables.read_table(spark, layout.tables, "transit_segment_weekly").collect()} == {3}
    derive.write_weeks(spark, layout, [str(DAY)], "merge")
    assert {r.n for r in tables.read_table(spark, layout.tables, "transit_segment_weekly").collect()} == {7}
    stored = derive.read_histograms(spark, layout)
    assert merge_histograms(stored, ["bin_idx"]).agg(F.sum("n")).first()[0] == 7 * 6


def test_rerun_changes_nothing_and_leaves_no_stale_keys(spark, layout):
    daily = tables.read_table(spark, layout.tables, "transit_stop_daily")
    before = rows(daily)
    stale = daily.where(F.col("date") == F.lit(DAY)).limit(1).withColumn("stop_id", F.lit("GONE"))
    tables.write_table(daily.union(stale), layout.tables, "transit_stop_daily", ["stop_id"])
    assert len(rows(tables.read_table(spark, layout.tables, "transit_stop_daily"))) == len(before) + 1
    derive.derive_days(spark, layout, [DAY])
    assert rows(tables.read_table(spark, layout.tables, "transit_stop_daily")) == before
    assert tables.read_ledger(spark, layout.tables).count() == 2


def test_stored_tables_are_consistent(spark, layout):
    keys = ["date", "stop_id", "route_id", "direction"]
    daily = tables.read_table(spark, layout.tables, "transit_stop_daily")
    hourly = tables.read_table(spark, layout.tables, "transit_stop_hourly")
    assert daily.where("on_time + late + early <> n_matched or n_matched > n_obs").count() == 0
    assert rows(hourly.groupBy(*keys).agg(F.sum("n_obs"))) == rows(daily.select(*keys, F.col("n_obs").cast("long")))


def test_arrivals_archive(spark, layout):
    found = archive.read_arrivals_archive(spark, layout.tables).where(F.col("service_date") == F.lit(DAY))
    first = found.orderBy("ts").first()
    assert (first.stop, first.route, first.dir, first.delay) == ("A", "R1", 1, 24)
    assert first.ts.startswith("2026-07-13T04:00:2") and first.ts.endswith("Z")


def test_a_day_without_files_leaves_no_ledger_row(spark, layout):
    derive.derive_days(spark, layout, [dt.date(2026, 1, 1)])
    assert tables.read_ledger(spark, layout.tables).count() == 2


def test_a_rerun_without_arrivals_empties_the_day(spark, layout, tmp_path):
    """The snapshot was wrong and is corrected: no stop is where it was, so the day has no arrivals any more."""
    own = derive.Layout(layout.positions, str(tmp_path / "snapshots"), str(tmp_path / "tables"))
    derive.derive_days(spark, derive.Layout(layout.positions, layout.snapshots, own.tables), [DAY, NEXT])
    names = ["transit_stop_daily", "transit_stop_hourly", "transit_segment_weekly"]
    assert all(tables.read_table(spark, own.tables, n).count() for n in names)
    put(tmp_path / "snapshots" / "2026-07-10" / "stops.json.gz", json.dumps([{"id": "A", "lat": 1.0, "lon": 1.0, "name": "A"}]))
    empty = [{"id": "R9", "detail": {"patterns": [{"patternSuffix": "0:01", "firstStop": {"id": "A"}}]}, "polyline": {"encodedValue": LINE},
              "schedule": {"weekdaySchedules": [{"serviceDates": [], "stops": stop_times("AB", {})}]}}]
    put(tmp_path / "snapshots" / "2026-07-10" / "routes.json.gz", json.dumps(empty))
    derive.derive_days(spark, own, [DAY])
    daily = tables.read_table(spark, own.tables, "transit_stop_daily")
    assert {r.date for r in daily.select("date").distinct().collect()} == {NEXT}
    assert {r.service_date for r in archive.read_arrivals_archive(spark, own.tables).collect()} == {NEXT}
    log = {r.date: r.arrivals for r in tables.read_ledger(spark, own.tables).collect()}
    assert log[DAY] == 0 and log[NEXT] > 0
    derive.derive_days(spark, own, [DAY, NEXT])
    assert not any(tables.read_table(spark, own.tables, n).count() for n in names)
    # A first run that finds nothing completes as well.
    fresh = derive.Layout(layout.positions, own.snapshots, str(tmp_path / "fresh"))
    derive.derive_days(spark, fresh, [DAY])
    assert not any(tables.read_table(spark, fresh.tables, n).count() for n in names)


def test_backfill_in_runs_goes_on_where_it_stopped(spark, layout, tmp_path, monkeypatch):
    whole = derive.Layout(layout.positions, layout.snapshots, str(tmp_path / "whole"))
    parts = derive.Layout(layout.positions, layout.snapshots, str(tmp_path / "parts"))
    later = dt.date(2026, 7, 20)
    assert derive.backfill(spark, whole, later, "merge") == [str(DAY), str(NEXT)]
    once, runs = derive.derive_days, []

    def failing(spark, layout, days, *rest):
        runs.append(days)
        if len(runs) == 2:
            raise RuntimeError("lost")
        once(spark, layout, days, *rest)

    monkeypatch.setattr(derive, "derive_days", failing)
    with pytest.raises(RuntimeError, match="lost"):
        derive.backfill(spark, parts, later, "merge", days_per_job=1)
    assert derive.backfill(spark, parts, later, "merge", days_per_job=1) == [str(NEXT)]
    assert runs == [[str(DAY)], [str(NEXT)], [str(NEXT)]]
    for name in ("transit_stop_daily", "transit_stop_hourly", "transit_segment_weekly"):
        assert rows(tables.read_table(spark, parts.tables, name)) == rows(tables.read_table(spark, whole.tables, name))


def test_a_route_listed_twice_is_its_last_entry_with_a_match(spark):
    stop = "struct('A' as id, '' as arrivalTimes)"
    row = "'2026-07-10' as snapshot_date, {pos} as pos, 'R' as id, array(struct('0:01' as patternSuffix, struct('{first}' as id) as firstStop, struct('Q' as id) as lastStop)) as patterns, " \
          "array(struct(array('x') as serviceDates, array({stop}) as stops)) as sched_fwd, null as sched_rev, '{poly}' as poly_fwd, null as poly_rev"
    text = " union all ".join("select " + row.format(pos=p, first=f, stop=stop, poly=poly) for p, f, poly in ((0, "A", "a"), (1, "A", LINE.replace("'", "")), (2, "Z", "b")))
    routes = spark.sql(text.replace("null as sched_rev", "cast(null as array<struct<serviceDates:array<string>,stops:array<struct<id:string,arrivalTimes:string>>>>) as sched_rev").replace("null as poly_rev", "cast(null as string) as poly_rev"))
    routes = routes.withColumn("snapshot_date", F.col("snapshot_date").cast("date"))
    days = spark.createDataFrame([(DAY, dt.date(2026, 7, 10))], "service_date date, snapshot_date date")
    stops = spark.createDataFrame([(dt.date(2026, 7, 10), 0, "A", 41.7, 44.7)], "snapshot_date date, pos int, id string, lat double, lon double")
    net = network.build_network(days, stops, routes)
    assert [(r.pattern_suffix, r.direction) for r in net.patterns.collect()] == [("0:01", 1)]
    assert net.vertices.count() == 14  # the line of the second entry


def test_collected_cycle(spark, tmp_path):
    vehicle = {"vehicleId": "v", "lat": 41.7, "lon": 44.78, "nextStopId": "A"}
    data = [("R1", "1", dt.datetime(2026, 7, 12, 20, 30, tzinfo=dt.UTC), {"0:01": [vehicle, vehicle], "1:01": []}),
            ("R1", "1", dt.datetime(2026, 7, 12, 22, 30, tzinfo=dt.UTC), {"0:01": [vehicle]})]
    replies = spark.createDataFrame(
        data, "route_id string, short_name string, sampled_at timestamp, "
        "reply map<string,array<struct<vehicleId:string,lat:double,lon:double,nextStopId:string>>>")
    archive.write_positions(archive.flatten_replies(replies), str(tmp_path / "p"))
    got = archive.read_collected_positions(spark, str(tmp_path / "p"))
    assert [(r.service_date, r.vehicle_id, r.ts_ms) for r in got.collect()] == [(dt.date(2026, 7, 13), "v", 1783888200000.0)] * 2


def test_routes_with_patterns(spark):
    catalog = spark.createDataFrame([("a", "1", ["0:01", ""]), ("b", "2", [""]), ("c", "3", [])], "id string, short_name string, suffixes array<string>")
    assert [(r.id, r.suffixes) for r in archive.routes_with_patterns(catalog).collect()] == [("a", ["0:01"])]


def test_exports(spark, tmp_path):
    stats = spark.createDataFrame([("A", 4, None), ("Q", 1, 2.0)], "stop_id string, n_obs int, ewt_s double")
    stops = spark.createDataFrame([("A", 41.7, 44.78)], "stop_id string, lat double, lon double")
    tables.export_csv(stats, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    tables.export_geojson(stats, stops, str(tmp_path / "geo"))
    features = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "geo")).collect()]
    assert features == [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [44.78, 41.7]},
                         "properties": {"stop_id": "A", "n_obs": 4, "ewt_s": None}}]
