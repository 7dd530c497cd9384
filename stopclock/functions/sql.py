"""The history queries as SQL functions, for use from ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stopclock.functions.calendar import BANDS, DAY_TYPES
from stopclock.operators.history import COVERAGE, DAILY_MEASURES, HOURLY_MEASURES, PROFILE_MEASURES

DAILY_VIEW, HOURLY_VIEW, LEDGER_VIEW = "transit_stop_daily", "transit_stop_hourly", "transit_derive_log"



def _case(subject: str, choices: dict[str, str]) -> str:
    """A choice by name; any other name, null included, is true."""
    return f"CASE {subject} " + " ".join(f"WHEN '{name}' THEN {condition}" for name, condition in choices.items()) + " ELSE true END"


def _selected(measures: dict[str, str]) -> str:
    return ", ".join(f"{value} AS {name}" for name, value in measures.items())


def _function(name: str, parameters: str, returns: str, body: str) -> str:
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}"


def _statements() -> list[str]:
    """The functions' texts, made from the same hours, days and measures as the Python functions."""
    days = {name: f"weekday(d) BETWEEN {first} AND {last}" for name, (first, last) in DAY_TYPES.items()}
    hours = {name: " OR ".join(f"h BETWEEN {first} AND {last}" for first, last in ranges) for name, ranges in BANDS.items()}
    span = "stops ARRAY<STRING>, from_day DATE, to_day DATE, day_type STRING DEFAULT 'all'"
    picked = "array_contains(stops, stop_id) AND date BETWEEN from_day AND to_day AND day_type_matches(date, day_type)"
    branches = [
        (DAILY_VIEW, DAILY_MEASURES, "band = 'all'"),
        (HOURLY_VIEW, HOURLY_MEASURES, "band <> 'all' AND hour_in_band(hour, band)"),
    ]
    stats = " UNION ALL ".join(f"SELECT stop_id, {_selected(measures)} FROM {view} WHERE {only} AND {picked} GROUP BY stop_id" for view, measures, only in branches)
    kinds = {name: "BIGINT" if value.startswith(("sum(", "count(")) else "DOUBLE" for name, value in DAILY_MEASURES.items()}
    table = lambda first, names: f"TABLE ({first}, " + ", ".join(f"{n} {kinds[n]}" for n in names) + ")"
    return [
        _function("day_type_matches", "d DATE, day_type STRING", "BOOLEAN", _case("day_type", days)),
        _function("hour_in_band", "h INT, band STRING", "BOOLEAN", _case("band", hours)),
        _function("transit_history_stats", f"{span}, band STRING DEFAULT 'all'", table("stop_id STRING", DAILY_MEASURES), stats),
        _function(
            "transit_history_hourly", span, table("hour INT", PROFILE_MEASURES),
            f"SELECT hour, {_selected(PROFILE_MEASURES)} FROM {HOURLY_VIEW} WHERE {picked} GROUP BY hour",
        ),
        _function("transit_history_coverage", "", "TABLE (first_date DATE, last_date DATE, days BIGINT)", f"SELECT {_selected(COVERAGE)} FROM {LEDGER_VIEW}"),
    ]


def register(spark: SparkSession, daily: DataFrame, hourly: DataFrame, ledger: DataFrame) -> None:
    """Makes the tables available as views and the functions over them callable from SQL.

    The function bodies are inlined into the calling query, so date filters reach the scans and the branch
    that the band rules out is dropped. The stop set is one array and filters rows after the scan; the Python
    functions push it down.
    """
    daily.createOrReplaceTempView(DAILY_VIEW)
    hourly.createOrReplaceTempView(HOURLY_VIEW)
    ledger.createOrReplaceTempView(LEDGER_VIEW)
    for statement in _statements():
        spark.sql(statement)
