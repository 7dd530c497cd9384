"""Service-day calendar: local hours, time bands, day types, ISO weeks.

Instants are epoch milliseconds held as doubles, so nothing here depends on the
session time zone. Local time is a fixed offset from UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
LOCAL_OFFSET_HOURS = 4
HOUR_MS = 3_600_000
DAY_MS = 86_400_000
AM_PEAK = (7, 9)
MIDDAY = (10, 16)
PM_PEAK = (17, 19)
EVENING_FROM = 20
EVENING_TO = 6
DAY_TYPES = {"weekday": (0, 4), "sat": (5, 5), "sun": (6, 6)}  # first and last day, Monday is 0
SERVICE_FIRST_HOUR = 6
SERVICE_END_HOUR = 1


def epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds (double) of a zoned timestamp."""
    return F.unix_micros(ts) / F.lit(1000.0)


def from_epoch_ms(ms: Column) -> Column:
    """Timestamp truncated to whole milliseconds."""
    return F.timestamp_millis(F.floor(ms).cast("long"))


def iso_text(ts: Column) -> Column:
    """``2026-07-13T04:00:00.000Z``, whatever the session zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def add_hours(ts: Column, hours: Column | int) -> Column:
    """A timestamp moved by elapsed hours.

    Adding an interval would add its whole days on the session zone's calendar instead.
    """
    micros = (F.lit(hours) if isinstance(hours, int) else hours).cast("long") * F.lit(3_600_000_000)
    return F.timestamp_micros(F.unix_micros(ts) + micros)


def local_hour(ms: Column, offset_hours: int = LOCAL_OFFSET_HOURS) -> Column:
    return F.pmod(F.floor(ms / HOUR_MS) + offset_hours, F.lit(24)).cast("int")


def local_date(ms: Column, offset_hours: int = LOCAL_OFFSET_HOURS) -> Column:
    return F.date_from_unix_date(
        F.floor((ms + offset_hours * HOUR_MS) / DAY_MS).cast("int")
    )


def hour_band(hour: Column) -> Column:
    return (
        F.when(hour.between(*AM_PEAK), "am_peak")
        .when(hour.between(*MIDDAY), "midday")
        .when(hour.between(*PM_PEAK), "pm_peak")
        .otherwise("evening")
    )


#: Hour ranges of the bands; the evening goes over midnight.
BANDS = {"am_peak": [AM_PEAK], "midday": [MIDDAY], "pm_peak": [PM_PEAK], "evening": [(EVENING_FROM, 23), (0, EVENING_TO)]}


def in_band(hour: Column, band: str) -> Column:
    """Hour filter of one band; any unknown band keeps every hour."""
    kept = F.lit(band not in BANDS)
    for first, last in BANDS.get(band, []):
        kept |= hour.between(first, last)
    return kept


def matches_day_type(date: Column, day_type: str | None) -> Column:
    """``weekday``, ``sat`` or ``sun``; anything else, null included, keeps every day."""
    return F.weekday(date).between(*DAY_TYPES[day_type]) if day_type in DAY_TYPES else F.lit(True)


def in_service_hours(hour: Column) -> Column:
    """06:00 to 00:59 local."""
    return (hour >= SERVICE_FIRST_HOUR) | (hour < SERVICE_END_HOUR)


def iso_week(date: Column) -> Column:
    """``2026-W28``: ISO year and week."""
    year = F.extract(F.lit("YEAROFWEEK"), date).cast("string")
    return F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def day_start_ms(date: Column, offset_hours: int = LOCAL_OFFSET_HOURS) -> Column:
    """Local midnight of a service day, in epoch milliseconds."""
    return F.unix_date(date).cast("double") * DAY_MS - offset_hours * HOUR_MS


def service_seconds(ms: Column, date: Column, offset_hours: int = LOCAL_OFFSET_HOURS) -> Column:
    return (ms - day_start_ms(date, offset_hours)) / F.lit(1000.0)


def clock_list_seconds(text: Column) -> Column:
    """``"06:10,24:05"`` to seconds of the service day; hours may pass 23.

    Blanks and entries that aren't two numbers are dropped: they match nothing.
    """
    return F.filter(F.transform(_clock_entries(text), _clock_seconds), lambda s: s.isNotNull())


def bad_clock_entries(text: Column) -> Column:
    """How many entries of a timetable text are neither blank nor a time."""
    return F.size(F.filter(_clock_entries(text), lambda e: _clock_seconds(e).isNull()))


def _clock_entries(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda e: e != "")


def _clock_seconds(entry: Column) -> Column:
    parts = F.split(entry, ":")
    return F.try_element_at(parts, F.lit(1)).try_cast("int") * 3600 + F.try_element_at(parts, F.lit(2)).try_cast("int") * 60


def local_key_parts(ms: Column, offset_hours: int = LOCAL_OFFSET_HOURS) -> tuple[Column, Column]:
    """The archive folder (local date) and file stem (``HHMM``) of an instant."""
    shifted = F.floor((ms + offset_hours * HOUR_MS) / 60_000)
    minute_of_day = F.pmod(shifted, F.lit(1440))
    hhmm = F.concat(
        F.lpad(F.floor(minute_of_day / 60).cast("string"), 2, "0"),
        F.lpad(F.pmod(minute_of_day, F.lit(60)).cast("string"), 2, "0"),
    )
    return local_date(ms, offset_hours), hhmm
