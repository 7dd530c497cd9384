"""Schemas of the files this library reads. Nothing is inferred."""

from __future__ import annotations

POSITION_LINE = (
    "t string, r string, n string, p string, "
    "v struct<vehicleId:string,lat:double,lon:double,nextStopId:string>"
)

STOP = "id string, lat double, lon double, name string"

_STOP_TIMES = "array<struct<id:string,arrivalTimes:string>>"
_BLOCKS = f"array<struct<serviceDates:array<string>,stops:{_STOP_TIMES}>>"
_PATTERNS = "array<struct<patternSuffix:string,firstStop:struct<id:string>,lastStop:struct<id:string>>>"

# Both generations of the route snapshot: one object per direction, or a single forward one.
ROUTE = (
    f"id string, detail struct<patterns:{_PATTERNS}>, "
    "polyline struct<fwd:struct<encodedValue:string>,rev:struct<encodedValue:string>,encodedValue:string>, "
    f"schedule struct<fwd:struct<weekdaySchedules:{_BLOCKS}>,rev:struct<weekdaySchedules:{_BLOCKS}>,"
    f"weekdaySchedules:{_BLOCKS}>"
)

VEHICLE_REPLY = (
    "route_id string, short_name string, sampled_at timestamp, "
    "reply map<string,array<struct<vehicleId:string,lat:double,lon:double,nextStopId:string>>>"
)

ARRIVAL_LINE = "stop string, route string, dir int, ts string, delay int"

_PERIOD = "struct<ends_at:timestamp>"
BILLING_DATA = (
    "struct<id:string,subscription_id:string,status:string,customer_id:string,"
    "started_at:timestamp,created_at:timestamp,canceled_at:timestamp,next_billed_at:timestamp,"
    f"billing_period:{_PERIOD},current_billing_period:{_PERIOD},"
    "items:array<struct<price:struct<billing_cycle:struct<interval:string>>>>,"
    "custom_data:struct<user_id:string,marketing_consent:boolean>>"
)
BILLING_EVENT = f"event_id string, received_at timestamp, event_type string, data {BILLING_DATA}"

LEDGER = (
    "date date, processed_at timestamp, files int, samples int, arrivals int, matched int, notes string"
)
STOP_DAILY = (
    "date date, stop_id string, route_id string, direction smallint, n_obs int, n_matched int, on_time int, "
    "late int, early int, delay_med_s int, delay_p90_s int, headway_med_s int, headway_sched_s int, ewt_s int"
)
STOP_HOURLY = (
    "date date, stop_id string, route_id string, direction smallint, hour smallint, n_obs int, n_matched int, "
    "on_time int, late int, early int, delay_med_s int"
)
SEGMENT_WEEKLY = (
    "iso_week string, route_id string, direction smallint, bin_idx int, band string, n int, "
    "speed_med_kmh float, speed_p15_kmh float"
)
