"""A key holding a third of all rows is spread over tasks and gives the same results."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from stopclock.operators import stop_metrics
from stopclock.operators.carry import carry_forward
from stopclock.operators.quantiles import histogram, rounded_quantiles
from stopclock.operators.traces import TRACE_KEYS, sample_pairs

DAY = dt.date(2024, 1, 15)
N = 30_000


@pytest.fixture(scope="module")
def samples(spark):
    """A day of samples; vehicle ``hot`` has every third one."""
    i = F.col("id")
    return spark.range(N).select(
        F.lit(DAY).alias("service_date"),
        F.when(i % 3 == 0, "hot").otherwise((F.pmod(F.hash("id"), F.lit(500))).cast("string")).alias("vehicle_id"),
        F.lit("R").alias("route_id"), F.lit("0").alias("pattern_suffix"),
        (1.7053e12 + F.pmod(F.hash(i + 11), F.lit(86_400_000))).alias("ts_ms"),
        (41.0 + i / 1e6).alias("lat"), F.lit(44.0).alias("lon"), (F.pmod(i, F.lit(9))).cast("string").alias("next_stop_id"),
    ).cache()


def test_pairs_of_a_hot_vehicle(spark, samples):
    pdf = samples.toPandas().sort_values([*TRACE_KEYS, "ts_ms", "lat"])
    before = pdf.groupby("vehicle_id")["ts_ms"].shift(1)
    gap = pdf["ts_ms"] - before
    expected = sorted(zip(pdf["vehicle_id"], gap, strict=True), key=repr)
    expected = [(v, g) for v, g in expected if pd.notna(g) and 0 < g <= 360_000]
    got = rows(sample_pairs(samples).select("vehicle_id", "dt_ms"))
    assert got == sorted(expected, key=repr)


def test_no_window_holds_the_hot_key(spark, samples):
    plan = sample_pairs(samples)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert shuffles and all("slice" in line for line in shuffles)
    per_slice = samples.groupBy("vehicle_id", F.floor(F.col("ts_ms") / 3_600_000)).count().agg(F.max("count")).first()[0]
    assert per_slice < N / 3 / 20


def test_headways_of_a_hot_stop(spark, samples):
    arrivals = samples.select(
        "service_date", F.col("vehicle_id").alias("stop_id"), "route_id", F.lit(1).alias("direction"), "ts_ms",
    )
    pdf = arrivals.toPandas().sort_values(["stop_id", "ts_ms"])
    pdf["h"] = pdf.groupby("stop_id")["ts_ms"].diff() / 1000.0
    kept = pdf[(pdf["h"] > 60) & (pdf["h"] < 3600)]
    stats = {r.stop_id: (r.n_headways, r.headway_med_s) for r in stop_metrics.headway_stats(stop_metrics.observed_headways(arrivals)).collect()}
    expected = {k: (len(g), int((g["h"].median() + 0.5) // 1)) for k, g in kept.groupby("stop_id")}
    assert stats == expected


def test_quantile_rows_are_bounded_by_the_value_range(samples):
    values = samples.withColumn("v", F.pmod(F.hash("ts_ms"), F.lit(6500)) / 100.0)
    hist = histogram(values, ["vehicle_id"], "v", 0)
    assert hist.where("vehicle_id = 'hot'").count() <= 66
    hot = values.where("vehicle_id = 'hot'").toPandas()["v"]
    got = rounded_quantiles(hist, ["vehicle_id"], 0, "m").where("vehicle_id = 'hot'").first()
    assert (got.n, got.m) == (len(hot), (hot.median() + 0.5) // 1)


def test_carried_values_of_a_hot_key(samples):
    marked = samples.select("vehicle_id", "ts_ms", "lat", F.when(F.pmod(F.hash("lat"), F.lit(40)) == 0, F.col("lat")).alias("mark"))
    carried = carry_forward(marked, ["vehicle_id"], ["ts_ms", "lat"], F.floor(F.col("ts_ms") / 3_600_000), {"last_mark": F.col("mark")})
    pdf = marked.toPandas().sort_values(["vehicle_id", "ts_ms", "lat"])
    pdf["expected"] = pdf.groupby("vehicle_id")["mark"].transform(lambda s: s.ffill().shift(1))
    both = carried.toPandas().merge(pdf[["vehicle_id", "ts_ms", "lat", "expected"]], on=["vehicle_id", "ts_ms", "lat"])
    assert len(both) == N
    assert both["last_mark"].fillna(-1).equals(both["expected"].fillna(-1))
