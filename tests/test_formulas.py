"""Hand-computed cases of each formula and boundary."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import replace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from stopclock.functions import calendar as cal
from stopclock.functions import geo, numbers
from stopclock.functions import text as tx
from stopclock.operators import arrivals, history, network, places, quantiles, segments, stop_metrics, usage
from stopclock.operators.traces import sample_pairs, valid_samples, with_previous


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_half_up(spark):
    got = one(spark, *[numbers.half_up(F.lit(x)).alias(f"x{i}") for i, x in enumerate((-2.5, 2.5, -2.51))])
    assert tuple(got) == (-2, 3, -3)


@pytest.mark.parametrize(
    ("values", "p", "expected"),
    [(list(range(1, 11)), 0.9, 10), ([7], 0.9, 7), ([], 0.9, None), (list(range(20)), 0.15, 3), ([5, 5, 9], 0.9, 9)],
)
def test_index_percentile(spark, values, p, expected):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    assert df.agg(numbers.index_percentile("v", p).alias("x")).first().x == expected


@pytest.mark.parametrize("p", [0.15, 0.9, 0.5, 0.01, 0.99])
def test_index_percentile_every_size(spark, p):
    df = spark.range(1, 121).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.col("id") - 1)).alias("v"))
    got = {r.n: r.x for r in df.groupBy("n").agg(numbers.index_percentile("v", p).alias("x")).collect()}
    assert got == {n: min(n - 1, math.floor(p * n)) for n in range(1, 121)}


def test_median(spark):
    df = spark.createDataFrame([(1,), (2,), (9,), (10,), (None,)], "v int")
    assert df.agg(numbers.median("v").alias("m")).first().m == 5.5


def test_iso_week(spark):
    days = ["2026-07-12", "2027-01-01", "2024-12-30"]
    got = one(spark, *[cal.iso_week(F.lit(d).cast("date")).alias(d) for d in days])
    assert tuple(got) == ("2026-W28", "2026-W53", "2025-W01")


@pytest.mark.parametrize(
    ("clock", "band"),
    [("02:59", "evening"), ("03:00", "am_peak"), ("05:59", "am_peak"), ("06:00", "midday"), ("16:00", "evening")],
)
def test_band_of_utc_time(spark, clock, band):
    ms = cal.epoch_ms(F.lit(f"2026-07-12T{clock}:00Z").cast("timestamp"))
    assert one(spark, cal.hour_band(cal.local_hour(ms)).alias("b")).b == band


def test_service_hours_and_keys(spark):
    def at(text):
        return cal.epoch_ms(F.lit(text).cast("timestamp"))

    day, stem = cal.local_key_parts(at("2026-07-12T20:30:00Z"))
    got = one(
        spark, day.alias("d"), stem.alias("s"),
        cal.in_service_hours(cal.local_hour(at("2026-07-12T20:30:00Z"))).alias("half_past_midnight"),
        cal.in_service_hours(cal.local_hour(at("2026-07-12T21:00:00Z"))).alias("one"),
    )
    assert tuple(got) == (dt.date(2026, 7, 13), "0030", True, False)


def test_clock_list(spark):
    got = one(spark, cal.clock_list_seconds(F.lit("06:10,,24:10")).alias("a"), cal.clock_list_seconds(F.lit(None).cast("string")).alias("b"))
    assert got.a == [22200, 87000] and got.b == []


def test_polyline_decodes_the_published_example(spark):
    df = spark.createDataFrame([("m", "_p~iF~ps|U_ulLnnqC_mqNvxq`@")], "model_id string, e string")
    got = geo.polyline_vertices(df, ["model_id"], "e").orderBy("idx").collect()
    assert [(r.lat, r.lon) for r in got] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    assert got[0].cum_m == 0 and got[2].cum_m > got[1].cum_m > 0


def test_tile_zero_is_the_world(spark):
    got = one(spark, *geo.tile_bounds(F.lit(0), F.lit(0), F.lit(0)))
    edge = math.pi * 6378137
    assert [round(v, 3) for v in got] == [round(v, 3) for v in (-edge, -edge, edge, edge)]


def test_slope_and_aspect(spark):
    slopes = [geo.slope_class(F.lit(s)).alias(f"s{i}") for i, s in enumerate((2.9, 3.0, 15.0, 30.0))]
    aspects = [geo.aspect_sector(F.lit(a)).alias(f"a{i}") for i, a in enumerate((0.0, 22.5, 337.4, 337.5))]
    assert tuple(one(spark, *slopes, *aspects)) == ("flat", "gentle", "steep", "very_steep", "N", "NE", "NW", "N")


def arrivals_at(spark, seconds, delays=None):
    delays = delays or [None] * len(seconds)
    data = [(dt.date(2024, 1, 15), "S", "R", 1, s * 1000.0, d) for s, d in zip(seconds, delays, strict=True)]
    return spark.createDataFrame(data, "service_date date, stop_id string, route_id string, direction int, ts_ms double, delay_s int")


def plan(spark, seconds):
    return spark.createDataFrame(
        [(dt.date(2024, 1, 15), "R", 1, "S", seconds)],
        "service_date date, route_id string, direction int, stop_id string, headway_sched_s double",
    )


def from_gaps(gaps, start=1_705_300_000):
    out = [start]
    for g in gaps:
        out.append(out[-1] + g)
    return out


@pytest.mark.parametrize(
    ("gaps", "expected"), [([300, 900, 600], 50), ([600, 600, 600], 0), ([300, 900], None)]
)
def test_excess_wait(spark, gaps, expected):
    row = stop_metrics.stop_daily(arrivals_at(spark, from_gaps(gaps)), plan(spark, 600.0)).first()
    assert row.ewt_s == expected


def test_excess_wait_needs_a_schedule(spark):
    row = stop_metrics.stop_daily(arrivals_at(spark, from_gaps([300, 900, 600])), plan(spark, 600.0).where("false")).first()
    assert row.ewt_s is None and row.headway_sched_s is None and row.headway_med_s == 600


def test_counts(spark):
    row = stop_metrics.stop_daily(arrivals_at(spark, [1, 2, 3, 4, 5], [-61, -60, 300, 301, None]), plan(spark, 1.0)).first()
    assert (row.early, row.on_time, row.late, row.n_obs, row.n_matched) == (1, 2, 1, 5, 4)


def test_headway_range(spark):
    found = stop_metrics.observed_headways(arrivals_at(spark, from_gaps([60, 61, 3599, 3600])))
    assert sorted(r.headway_s for r in found.collect()) == [61, 3599]


def test_headways_are_found_across_every_slice_boundary(spark):
    start = 1_705_300_000
    seconds = [start + 977 * i for i in range(200)]
    found = stop_metrics.observed_headways(arrivals_at(spark, seconds))
    assert found.count() == 199 and found.where("headway_s <> 977").count() == 0


@pytest.mark.parametrize("slice_ms", [360_000, 1_000_000, 3_600_000])
def test_slices_do_not_change_pairs(spark, slice_ms):
    df = spark.range(2000).select(
        F.lit(dt.date(2024, 1, 15)).alias("service_date"), (F.col("id") % 3).cast("string").alias("vehicle_id"),
        F.lit("R").alias("route_id"), F.lit("0").alias("pattern_suffix"),
        (F.pmod(F.hash("id"), F.lit(20_000_000)) * 1.0 + 1.7e12).alias("ts_ms"),
        F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit("S1").alias("next_stop_id"),
    )
    assert rows(sample_pairs(df, slice_ms=slice_ms)) == rows(sample_pairs(df, slice_ms=10**13))


def test_gap_limits(spark):
    times = [0.0, 360_000.0, 721_000.0, 721_000.0, 721_001.0]
    data = [(dt.date(2024, 1, 15), "v", "R", "0", t, float(i), 0.0, "S1") for i, t in enumerate(times)]
    df = spark.createDataFrame(data, "service_date date, vehicle_id string, route_id string, pattern_suffix string, ts_ms double, lat double, lon double, next_stop_id string")
    assert sorted(r.dt_ms for r in sample_pairs(df).collect()) == [1.0, 360_000.0]


def test_valid_samples(spark):
    data = [("v", 1.0, 1.0, 1.0, ""), ("", 1.0, 1.0, 1.0, "S"), (None, 1.0, 1.0, 1.0, "S"), ("v", None, 1.0, 1.0, "S"),
            ("v", 1.0, None, 1.0, "S"), ("v", 1.0, 1.0, None, "S")]
    df = spark.createDataFrame(data, "vehicle_id string, lat double, lon double, ts_ms double, next_stop_id string")
    assert [r.next_stop_id for r in valid_samples(df).collect()] == [None]


def test_bins_covered(spark):
    data = [(dt.date(2024, 1, 15), "v", "R", "0", 1, 0.0, 41.7, 44.78, "S", 140.0, 120_000.0, 41.7, 44.782, "S", 310.0, 120_000.0)]
    df = spark.createDataFrame(
        data,
        "service_date date, vehicle_id string, route_id string, pattern_suffix string, direction int, a_ts_ms double, a_lat double, a_lon double, "
        "a_next_stop_id string, a_along_m double, b_ts_ms double, b_lat double, b_lon double, b_next_stop_id string, b_along_m double, dt_ms double",
    )
    assert sorted(r.bin_idx for r in segments.traversals(df).collect()) == [0, 1, 2]


@pytest.mark.parametrize(("entry_times", "at_s", "delay"), [([100, 300], 200, 100), ([0], 1200, 1200), ([0], 1201, None), ([], 5, None)])
def test_schedule_match(spark, entry_times, at_s, delay):
    day = dt.date(2024, 1, 15)
    midnight_ms = 1_705_276_800_000.0 - 4 * 3_600_000
    found = spark.createDataFrame([(day, "R", 1, "m", "S", midnight_ms + at_s * 1000.0)],
                                  "service_date date, route_id string, direction int, model_id string, stop_id string, ts_ms double")
    table = spark.createDataFrame([("m", "S", entry_times)], "model_id string, stop_id string, times array<int>")
    assert arrivals.match_schedule(found, table).first().delay_s == delay


def sequence(spark, stops):
    return spark.createDataFrame([("m", stops)], "model_id string, stops array<struct<stop_id:string,lat:double,lon:double>>")


def pair(spark, a_next, b_next):
    return spark.createDataFrame(
        [(dt.date(2024, 1, 15), "R", 1, "m", 0.0, 41.7, 44.780, a_next, 120_000.0, 41.7, 44.790, b_next, 120_000.0)],
        "service_date date, route_id string, direction int, model_id string, a_ts_ms double, a_lat double, a_lon double, a_next_stop_id string, "
        "b_ts_ms double, b_lat double, b_lon double, b_next_stop_id string, dt_ms double",
    )


def test_passed_stops_include_the_old_next_stop_only(spark):
    seq = sequence(spark, [("A", 41.7, 44.782), ("B", 41.7, 44.785), ("C", 41.7, 44.788), ("D", 41.7, 44.792)])
    found = arrivals.interpolate_arrivals(arrivals.stop_changes(pair(spark, "A", "C"), seq)).orderBy("ts_ms").collect()
    assert [r.stop_id for r in found] == ["A", "B"]
    assert found[0].ts_ms == pytest.approx(24_000, rel=1e-6) and found[1].ts_ms == pytest.approx(60_000, rel=1e-6)


@pytest.mark.parametrize(("a", "b"), [("C", "A"), ("A", "A"), ("A", "X"), (None, "B")])
def test_no_arrivals_off_sequence(spark, a, b):
    seq = sequence(spark, [("A", 41.7, 44.782), ("B", 41.7, 44.785), ("C", 41.7, 44.788)])
    assert arrivals.stop_changes(pair(spark, a, b), seq).count() == 0


def test_missing_stop_weighs_one_and_keeps_the_last_point(spark):
    seq = sequence(spark, [("A", 41.7, 44.785), ("B", None, None), ("C", 41.7, 44.790), ("D", 41.7, 44.791)])
    found = {r.stop_id: r.ts_ms for r in arrivals.interpolate_arrivals(arrivals.stop_changes(pair(spark, "A", "C"), seq)).collect()}
    metre = geo.haversine_m(F.lit(41.7), F.lit(44.780), F.lit(41.7), F.lit(44.785))
    leg = one(spark, metre.alias("m")).m
    total = leg + 1 + leg
    assert found["A"] == pytest.approx(120_000 * leg / total, rel=1e-6)
    assert found["B"] == pytest.approx(120_000 * (leg + 1) / total, rel=1e-6)


def test_repeated_stop_uses_its_last_place(spark):
    seq = sequence(spark, [("A", 41.7, 44.782), ("B", 41.7, 44.783), ("A", 41.7, 44.785), ("C", 41.7, 44.788)])
    found = arrivals.interpolate_arrivals(arrivals.stop_changes(pair(spark, "A", "C"), seq)).collect()
    assert [r.stop_id for r in found] == ["A"]
    assert arrivals.stop_changes(pair(spark, "A", "B"), seq).count() == 0


@pytest.mark.parametrize("cell", [0.0005, 0.003, 0.05])
def test_nearest_vertex_by_cells_equals_full_search(spark, cell):
    corners = spark.range(60).select(
        F.lit("m").alias("model_id"), F.col("id").cast("int").alias("idx"),
        (41.7 + F.sin(F.col("id") / 7.0) / 100).alias("lat"), (44.78 + F.cos(F.col("id") / 11.0) / 100).alias("lon"),
    )
    vertices = geo.with_running_length(corners, ["model_id"])
    net = network.Network(None, None, None, vertices, network.lookup_cells(vertices, cell))
    samples = spark.range(800).select(
        "id", F.lit("m").alias("model_id"),
        (41.7 + F.pmod(F.hash("id"), F.lit(4001)) / 100_000 - 0.02).alias("lat"),
        (44.78 + F.pmod(F.hash(F.col("id") + 7), F.lit(4001)) / 100_000 - 0.02).alias("lon"),
    )
    got = {r.id: r.along_m for r in segments.locate_along(samples, replace(net, cell_deg=cell)).collect()}
    line = sorted((r.idx, r.lat, r.lon, r.cum_m) for r in vertices.collect())
    for r in samples.collect():
        best = min(line, key=lambda v: ((v[1] - r.lat) * (v[1] - r.lat) + (v[2] - r.lon) * (v[2] - r.lon), v[0]))
        assert got[r.id] == best[3]


def test_bucketed_quantiles_equal_sorting(spark):
    df = spark.range(5000).select(
        (F.col("id") % 37).alias("k"), (F.pmod(F.hash("id"), F.lit(65_000)) / 1000.0).alias("v")
    ).where("k < 30 or v > 60")
    hist = quantiles.histogram(df, ["k"], "v", 1)
    halves = [quantiles.histogram(df.where(F.col("v") % 2 < 1), ["k"], "v", 1), quantiles.histogram(df.where(F.col("v") % 2 >= 1), ["k"], "v", 1)]
    merged = quantiles.merge_histograms(halves[0].unionByName(halves[1]), ["k"])
    values = {}
    for r in df.collect():
        values.setdefault(r.k, []).append(r.v)

    def tenth(x):
        return math.floor(x * 10 + 0.5) / 10

    expected = []
    for k, vs in values.items():
        vs.sort()
        n = len(vs)
        middle = vs[n // 2] if n % 2 else (vs[n // 2 - 1] + vs[n // 2]) / 2
        expected.append((k, n, tenth(middle), tenth(vs[min(n - 1, math.floor(0.15 * n))])))
    for h in (hist, merged):
        assert rows(quantiles.rounded_quantiles(h, ["k"], 1, "m", {"p": 0.15})) == sorted(expected, key=repr)


def daily(spark, data):
    return spark.createDataFrame(
        [(dt.date(2024, 1, d), "S", "R", 1, n, n, n, 0, 0, 5, 9, 600, 600, e) for d, n, e in data],
        "date date, stop_id string, route_id string, direction int, n_obs int, n_matched int, on_time int, late int, early int, "
        "delay_med_s int, delay_p90_s int, headway_med_s int, headway_sched_s int, ewt_s int",
    )


def hourly(spark, hours):
    return spark.createDataFrame(
        [(dt.date(2024, 1, 1), "S", "R", 1, h, 1, 1, 1, 0, 0, h) for h in hours],
        "date date, stop_id string, route_id string, direction int, hour int, n_obs int, n_matched int, on_time int, late int, early int, delay_med_s int",
    )


def test_weighted_excess_wait(spark):
    table = daily(spark, [(1, 10, 60), (2, 90, None), (3, 30, 120)])
    got = history.history_stats(table, hourly(spark, [1]), ["S"], "2024-01-01", "2024-01-31").first()
    assert got.ewt_s == 105 and got.n_obs == 130


@pytest.mark.parametrize(
    ("band", "hours"),
    [("evening", [*range(7), *range(20, 24)]), ("am_peak", [7, 8, 9]), ("foo", list(range(24))), (None, [])],
)
def test_bands_of_history(spark, band, hours):
    table = hourly(spark, range(24))
    got = history.history_stats(daily(spark, [(1, 1, 1)]), table, ["S"], "2024-01-01", "2024-01-31", "all", band).collect()
    assert [r.n_obs for r in got] == ([len(hours)] if hours else [])


def test_empty_stop_list_and_null_day_type(spark):
    table = daily(spark, [(6, 1, 1), (7, 1, 1)])
    args = (table, hourly(spark, [1]))
    assert history.history_stats(*args, [], "2024-01-01", "2024-01-31").count() == 0
    assert history.history_stats(*args, ["S"], "2024-01-01", "2024-01-31", None).first().n_obs == 2
    assert history.history_stats(*args, ["S"], "2024-01-01", "2024-01-31", "sat").first().n_obs == 1


def test_coverage_of_an_empty_ledger(spark):
    got = history.history_coverage(spark.createDataFrame([], "date date"))
    assert [tuple(r) for r in got.collect()] == [(None, None, 0)]


@pytest.mark.parametrize(("score", "mark"), [(0.8, "A"), (0.799, "B"), (0.6, "C"), (0.5, "D"), (0.4, "E"), (0.39, "F")])
def test_grades(spark, score, mark):
    assert one(spark, history.grade(F.lit(score)).alias("g")).g == mark


def test_shannon(spark):
    df = spark.createDataFrame([(1, c) for c in ("food", "health", "parks", "retail", "office")], "site_id int, category string")
    assert places.diversity_index(df).first().shannon == pytest.approx(math.log(4))


def test_quota_limits(spark):
    activity = spark.createDataFrame([("u", dt.date(2024, 1, 1), "f", 45)], "user_id string, month date, feature string, uses int")
    nobody = spark.createDataFrame([], "user_id string, plan string, status string")
    none = spark.createDataFrame([], "user_id string, monthly_limit int")
    got = usage.quota_status(activity, nobody, none).first()
    assert (got.monthly_limit, got.remaining, got.warn, got.exceeded) == (50, 5, True, False)


def test_snapshot_for_days(spark):
    def dates(name, *values):
        return spark.createDataFrame([(dt.date.fromisoformat(v),) for v in values], f"{name} date")

    got = network.snapshot_for_days(
        dates("service_date", "2024-01-01", "2024-01-05", "2024-03-09"), dates("snapshot_date", "2024-01-05", "2024-02-01", "2024-04-01")
    )
    assert rows(got) == [(dt.date(2024, 1, 5), dt.date(2024, 1, 5)), (dt.date(2024, 3, 9), dt.date(2024, 2, 1))]


def test_previous_row_is_found_up_to_the_horizon(spark):
    df = spark.createDataFrame([("k", 0.0), ("k", 100.0), ("k", 201.0)], "k string, t double")
    got = with_previous(df, ["k"], ["t"], ["t"], horizon_ms=100, slice_ms=100)
    assert {r.t: r.prev.t for r in got.collect() if r.prev and r.t - r.prev.t <= 100} == {100.0: 0.0}


def test_text_fields(spark):
    nbsp, line_sep = chr(0xA0), chr(0x2028)
    got = one(
        spark,
        tx.plain_text(F.lit(f"<b>a</b>&NBSP;{nbsp}{line_sep}b<br>c")).alias("plain"),
        tx.digits_only(F.lit("doc-12/3")).alias("digits"),
        tx.property_codes(F.lit("01.02.03.004.005 9 01.02.03.004.006 01.02.03.004.005")).alias("codes"),
        tx.labelled_date(F.lit(f"{tx.LABEL_ISSUED}: no.5 1.2.2024"), tx.LABEL_ISSUED).alias("far"),
        tx.labelled_date(F.lit(f"{tx.LABEL_ISSUED} : 11.2.2024"), tx.LABEL_ISSUED).alias("near"),
    )
    assert got.plain == " a b c"
    assert got.digits == "123"
    assert got.codes == ["01.02.03.004.005", "01.02.03.004.006"]
    assert got.far == "" and got.near == "11/2/2024"


def test_hours_are_elapsed_time_in_any_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        start = F.lit("2024-03-01T12:00:00Z").cast("timestamp")
        got = one(spark, (F.unix_seconds(cal.add_hours(start, 30 * 24)) - F.unix_seconds(start)).alias("s"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got.s == 30 * 86_400


@pytest.mark.parametrize("slice_ms", [1_000, 60_000, 120_000, 360_000, 3_600_000, 86_400_000])
def test_pairs_for_every_slice_length(spark, slice_ms):
    samples = spark.range(20).select(
        F.lit(dt.date(2026, 7, 13)).alias("service_date"), F.lit("v").alias("vehicle_id"), F.lit("r").alias("route_id"), F.lit("p").alias("pattern_suffix"),
        (F.col("id") * 300_000.0).alias("ts_ms"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit("A").alias("next_stop_id"),
    )
    assert sample_pairs(samples, slice_ms=slice_ms).count() == 19


def test_polylines_with_long_and_negative_numbers(spark):
    def encoded(numbers):
        out = ""
        for n in numbers:
            n = ~(n << 1) if n < 0 else n << 1
            while n >= 32:
                out += chr((32 | (n & 31)) + 63)
                n >>= 5
            out += chr(n + 63)
        return out

    numbers = [(4_170_000, 4_478_000), (-250, 300), (123_456_789_012, -98_765_432_109), (-123_456_789_012, 98_765_432_109), (1, -1)]
    text = encoded([x for p in numbers for x in p])
    lines = spark.createDataFrame([("m", text), ("bad", text[:6] + "!" + text[6:]), ("none", None)], "model_id string, encoded string")
    got = geo.polyline_vertices(lines, ["model_id"], "encoded").orderBy("idx").collect()
    lat = lon = 0
    for r, (a, b) in zip(got, numbers, strict=True):
        lat, lon = lat + a, lon + b
        assert r.model_id == "m" and (r.lat, r.lon) == (lat / 1e5, lon / 1e5)


def test_one_misplaced_vertex_makes_few_cells(spark):
    line = spark.createDataFrame([("m", 0, 41.7, 44.78, 0.0), ("m", 1, 0.0, 0.0, 1.0), ("m", 2, 41.701, 44.781, 2.0)], "model_id string, idx int, lat double, lon double, cum_m double")
    cells = network.lookup_cells(line)
    assert cells.count() < 60
    net = network.Network(None, None, None, line, cells)
    off = spark.createDataFrame([("m", 20.0, 22.0), ("m", 41.7, 44.78), ("none", 1.0, 1.0)], "model_id string, lat double, lon double")
    assert sorted((r.lat, r.along_m) for r in segments.locate_along(off, net).collect()) == [(1.0, None), (20.0, 1.0), (41.7, 0.0)]


def test_samples_on_a_cell_are_not_joined_with_lines(spark):
    """No exchange on a key that is null for most samples, whatever the sizes."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        line = spark.range(5).selectExpr("'m' as model_id", "cast(id as int) as idx", "41.7 as lat", "44.78 + id / 1000 as lon", "double(id) as cum_m").selectExpr("model_id", "idx", "double(lat) as lat", "double(lon) as lon", "cum_m")
        net = network.Network(None, None, None, line, network.lookup_cells(line))
        plan = segments.locate_along(line.select("model_id", "lat", "lon"), net)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "stray" not in plan and "LeftAnti" in plan


def test_timetable_text_with_bad_entries(spark):
    texts = ["06:10,x", "06:10,7", "24:05,,06:1a,08:00", None, ""]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", cal.clock_list_seconds(F.col("t")).alias("s"), cal.bad_clock_entries(F.col("t")).alias("bad")
    ).orderBy("i").collect()
    assert [(list(r.s), r.bad) for r in found] == [([22200], 1), ([22200], 1), ([86700, 28800], 1), ([], 0), ([], 0)]


def test_all_stops_are_ranked(spark):
    stats = spark.createDataFrame([("A", 40, 40, 30, 5), ("B", 50, 50, 10, 5), ("C", 5, 5, 1, 1)], "stop_id string, n_obs int, n_matched int, on_time int, late int")
    stats = stats.withColumns({"delay_med_s": F.lit(1.0), "headway_med_s": F.lit(1.0)})
    every, one_of_them = history.worst_stops(stats), history.worst_stops(stats, 1)
    assert every.schema == one_of_them.schema
    assert [(r.stop_id, r.rank) for r in every.collect()] == [("B", 1), ("A", 2)]
    assert [(r.stop_id, r.rank) for r in one_of_them.collect()] == [("B", 1)]


def test_scratch_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from stopclock.session import scratch_root

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_root(cluster)
