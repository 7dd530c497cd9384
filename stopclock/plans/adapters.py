"""Deterministic projections of the test tables to the shapes the operators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopclock.functions import text as tx
from stopclock.functions.calendar import DAY_MS, add_hours, from_epoch_ms, iso_text
from stopclock.functions.geo import with_running_length
from stopclock.functions.numbers import half_up
from stopclock.operators.network import Network, lookup_cells, timetable_headways

# Fixed values of the projections
EVENTS_START_MS = 1_704_067_200_000
TRACE_START_MS = 1_705_287_600_000
TIME_SQUEEZE = 120
ROUTE_LENGTH_M = 9000
STOP_SPACING_M = 400
STOP_COUNT = 24
VERTEX_SPACING_M = 50
LINE_LAT = 41.7
LINE_LON = 44.78
METRES_PER_DEGREE = 83000
TRACE_DAY = "2024-01-15"
FIRST_DEPARTURE_S, LAST_DEPARTURE_S, HEADWAY_S = 25200, 46800, 3600


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def wall_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a wall-clock timestamp, whatever the session zone."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    within = seconds * F.lit(1_000_000).cast("long") + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return F.unix_date(F.to_date(ts)) * F.lit(DAY_MS * 1000).cast("long") + within


def utc_timestamp(ts: Column) -> Column:
    return F.timestamp_micros(wall_micros(ts))


def event_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals_of(load(spark, sf_dir, "events"))


def arrivals_of(events: DataFrame) -> DataFrame:
    """Events as stop arrivals with a signed delay."""
    raw = F.col("value") * 10 - 200
    return events.select(
        F.to_date("ts").alias("service_date"),
        F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias("stop_id"),
        F.when(F.col("event_type").isin("click", "view"), "R1").otherwise("R2").alias("route_id"),
        (F.col("event_id") % 2).cast("int").alias("direction"),
        (wall_micros(F.col("ts")) / 1000.0).alias("ts_ms"),
        F.when(raw <= 1200, half_up(raw).cast("int")).alias("delay_s"),
    )


def hourly_schedule(arrivals: DataFrame) -> DataFrame:
    """A scheduled headway of one hour for every stop-day that has arrivals."""
    keys = ["service_date", "route_id", "direction", "stop_id"]
    return arrivals.select(*keys).distinct().withColumn("headway_sched_s", F.lit(3600.0))


def event_positions(spark: SparkSession, sf_dir: str, days: int = 1) -> DataFrame:
    return positions_of(load(spark, sf_dir, "events"), days)


def positions_of(events: DataFrame, days: int = 1) -> DataFrame:
    """Events as vehicle samples on a straight line; with ``days`` > 1 users fall on different days."""
    micros = wall_micros(F.col("ts")) - F.lit(EVENTS_START_MS * 1000)
    along = F.pmod(4.0 * micros / (1e6 * TIME_SQUEEZE) + F.col("value"), F.lit(float(ROUTE_LENGTH_M)))
    shift = (F.col("user_id") % days).cast("int")
    rows = events.select(
        F.date_add(F.lit(TRACE_DAY).cast("date"), shift).alias("service_date"),
        F.col("user_id").cast("string").alias("vehicle_id"),
        F.lit("R1").alias("route_id"),
        F.concat((F.col("user_id") % 2).cast("string"), F.lit(":01")).alias("pattern_suffix"),
        (F.lit(float(TRACE_START_MS)) + micros / (1000.0 * TIME_SQUEEZE) + shift * float(DAY_MS)).alias("ts_ms"),
        along.alias("d"),
    )
    return rows.select(
        "service_date", "vehicle_id", "route_id", "pattern_suffix", "ts_ms",
        F.lit(LINE_LAT).alias("lat"),
        (LINE_LON + F.col("d") / METRES_PER_DEGREE).alias("lon"),
        F.concat(F.lit("S"), (F.floor(F.col("d") / STOP_SPACING_M) + 1).cast("string")).alias("next_stop_id"),
    )


def position_lines(samples: DataFrame) -> DataFrame:
    """Samples as archive lines."""
    point = F.struct(
        F.col("vehicle_id").alias("vehicleId"), F.col("lat"), F.col("lon"), F.col("next_stop_id").alias("nextStopId")
    )
    return samples.select(
        iso_text(from_epoch_ms(F.col("ts_ms"))).alias("t"), F.col("route_id").alias("r"), F.lit("1").alias("n"),
        F.col("pattern_suffix").alias("p"), point.alias("v"), "ts_ms",
    )


def line_network(spark: SparkSession, days: int = 1) -> Network:
    """Stops, timetable and polyline of that line; both suffixes follow the same order."""
    models = spark.range(2).select(
        F.col("id").cast("int").alias("direction"),
        F.concat(F.lit("line"), F.col("id").cast("string")).alias("model_id"),
    )
    first_day = F.lit(TRACE_DAY).cast("date")
    patterns = models.select(
        F.explode(F.sequence(first_day, F.date_add(first_day, days - 1))).alias("service_date"),
        F.lit("R1").alias("route_id"),
        F.concat(((F.col("direction") + 1) % 2).cast("string"), F.lit(":01")).alias("pattern_suffix"),
        "direction", "model_id",
    )
    numbers = F.sequence(F.lit(0), F.lit(STOP_COUNT - 1))
    stops = F.transform(
        numbers,
        lambda i: F.struct(
            F.concat(F.lit("S"), i.cast("string")).alias("stop_id"),
            F.lit(LINE_LAT).alias("lat"),
            (LINE_LON + i * float(STOP_SPACING_M) / METRES_PER_DEGREE).alias("lon"),
        ),
    )
    timetable = models.select(
        "model_id",
        F.explode(F.transform(numbers, lambda i: F.concat(F.lit("S"), i.cast("string")))).alias("stop_id"),
        F.sequence(F.lit(FIRST_DEPARTURE_S), F.lit(LAST_DEPARTURE_S), F.lit(HEADWAY_S)).alias("times"),
    )
    corners = models.select(
        "model_id", F.explode(F.sequence(F.lit(0), F.lit(ROUTE_LENGTH_M // VERTEX_SPACING_M))).alias("idx")
    ).select(
        "model_id", "idx", F.lit(LINE_LAT).alias("lat"),
        (LINE_LON + F.col("idx") * float(VERTEX_SPACING_M) / METRES_PER_DEGREE).alias("lon"),
    )
    vertices = with_running_length(corners, ["model_id"])
    return Network(
        patterns=patterns,
        sequences=models.select("model_id", stops.alias("stops")),
        timetable=timetable_headways(timetable),
        vertices=vertices,
        cells=lookup_cells(vertices),
    )


def billing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing_of(load(spark, sf_dir, "events"))


def billing_of(events: DataFrame) -> DataFrame:
    """Events as billing events."""
    user = F.col("user_id").cast("string")
    eid = F.col("event_id")
    at = F.col("at")
    kind = (
        F.when(F.col("event_type") == "signup", "subscription.activated")
        .when(F.col("event_type") == "purchase", "transaction.completed")
        .when(F.col("event_type") == "view", "subscription.updated")
        .when(F.col("event_type") == "click", "subscription.past_due")
        .when(F.col("event_type") == "error", F.when(eid % 2 == 0, "subscription.canceled").otherwise("subscription.paused"))
    )
    ends = add_hours(at, (F.floor("value") - 35) * 24)
    started = add_hours(at, -(eid % 60) * 24)
    sub = F.when(eid % 5 != 0, F.concat(F.lit("sub_"), user))
    nothing = F.lit(None)
    data = F.struct(
        F.concat(F.lit("obj_"), eid.cast("string")).alias("id"),
        sub.alias("subscription_id"),
        F.when(kind == "subscription.updated", F.when(eid % 2 == 0, "canceled").otherwise("active")).alias("status"),
        F.concat(F.lit("cus_"), user).alias("customer_id"),
        started.alias("started_at"),
        nothing.cast("timestamp").alias("created_at"),
        nothing.cast("timestamp").alias("canceled_at"),
        nothing.cast("timestamp").alias("next_billed_at"),
        F.struct(ends.alias("ends_at")).alias("billing_period"),
        F.struct(ends.alias("ends_at")).alias("current_billing_period"),
        F.array(F.struct(F.struct(F.struct(
            F.when(F.col("user_id") % 3 == 0, "year").otherwise("month").alias("interval")
        ).alias("billing_cycle")).alias("price"))).alias("items"),
        F.struct(user.alias("user_id"), (eid % 7 == 0).alias("marketing_consent")).alias("custom_data"),
    )
    return events.withColumn("at", utc_timestamp(F.col("ts"))).select(
        eid.alias("event_id"), at.alias("received_at"), kind.alias("event_type"), data.alias("data")
    )


def customer_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as subscription rows in every state, around 2024-01-31."""
    key = F.col("c_custkey")
    base = F.lit("2024-01-31T00:00:00Z").cast("timestamp")
    states = F.array(*[F.lit(s) for s in ("trialing", "active", "canceling", "canceled", "past_due")])
    return load(spark, sf_dir, "customer").select(
        key.cast("string").alias("user_id"),
        F.when(key % 4 == 0, "free").otherwise("pro").alias("plan"),
        F.element_at(states, (key % 5 + 1).cast("int")).alias("status"),
        F.when(key % 11 != 0, F.concat(F.lit("sub_"), key.cast("string"))).alias("paddle_subscription_id"),
        F.when(key % 3 == 0, "year").otherwise("month").alias("billing_interval"),
        F.when(key % 13 != 0, add_hours(base, (key % 400 - 20) * 24)).alias("current_period_end"),
        F.concat(F.lit("cus_"), key.cast("string")).alias("paddle_customer_id"),
        add_hours(base, -(key % 90) * 24).alias("subscription_started_at"),
        base.alias("updated_at"),
        (key % 5 == 0).alias("trial_active"),
        add_hours(base, key % 240 - 60).alias("trial_ends_at"),
    )


def customer_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users; every seventh has no address."""
    key = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(
        key.cast("string").alias("user_id"),
        F.when(key % 7 != 0, F.concat("c_name", F.lit("@example.org"))).alias("email"),
    )


def customer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(
        key.cast("string").alias("id"),
        F.when(key % 5 != 0, F.col("c_name")).alias("full_name"),
        F.when(key % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("a/"), key.cast("string"))).alias("avatar_url"),
        (key % 10 == 1).alias("is_admin"),
        (key % 2 == 0).alias("marketing_consent"),
    )


def order_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows owned by a user."""
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_orderstatus").alias("status"),
    )


def event_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feature uses."""
    return load(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.when(F.col("event_type") == "click", "map_click")
        .when(F.col("event_type") == "view", "free_analysis")
        .when(F.col("event_type") == "purchase", "pro_analysis")
        .when(F.col("event_type") == "signup", "pdf_export")
        .otherwise("other").alias("feature"),
        F.col("ts"),
    )


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests, one client per user."""
    return load(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("client"), utc_timestamp(F.col("ts")).alias("ts")
    )


def event_amenities(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in ("food", "health", "parks", "retail", "culture", "office")])
    pick = (F.floor(F.col("value")).cast("int") + F.length("event_type")) % 6 + 1
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("site_id"), F.element_at(names, pick).alias("category")
    )


def part_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as terrain cells."""
    key = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(
        F.col("p_brand").alias("area_id"),
        F.col("p_retailprice").alias("height"),
        ((key * 7 % 450) / 10.0).alias("slope"),
        ((key * 13 % 3600) / 10.0).alias("aspect"),
    )


def part_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tile keys at zoom levels 0 to 18."""
    key = F.col("p_partkey")
    z = (key % 19).cast("int")
    n = F.pow(F.lit(2.0), z).cast("long")
    return load(spark, sf_dir, "part").select(
        z.alias("z"), (key * 7919 % n).alias("x"), (key * 104729 % n).alias("y")
    )


# Customers as routes: two snapshots, two timetable blocks forward, a reverse side for two routes in three.
SNAPSHOT_DAYS = ("2024-01-01", "2024-01-16")
ROUTE_DAYS = ("2024-01-15", "2024-01-17")
ROUTE_STOPS = 5
LINE_POINTS = 12


def _dates(spark: SparkSession, name: str, values: tuple[str, ...]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(v).cast("date") for v in values])).alias(name))


def route_days(spark: SparkSession) -> DataFrame:
    return _dates(spark, "service_date", ROUTE_DAYS)


def route_snapshots(spark: SparkSession) -> DataFrame:
    return _dates(spark, "snapshot_date", SNAPSHOT_DAYS)


def _stop_name(n: Column) -> Column:
    return F.concat(F.lit("S"), n.cast("string"))


def customer_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    base = k % 40
    places = F.sequence(F.lit(0), F.lit(ROUTE_STOPS - 1))

    def block(dates: list[str], times: Column, backwards: bool = False) -> Column:
        stops = F.transform(
            places,
            lambda i: F.struct(_stop_name(base + (ROUTE_STOPS - 1 - i if backwards else i)).alias("id"), times.alias("arrivalTimes")),
        )
        listed = F.array(*[F.lit(d) for d in dates]) if dates else F.array().cast("array<string>")
        return F.struct(listed.alias("serviceDates"), stops.alias("stops"))

    def patterns(*listed: tuple[str, Column, Column]) -> Column:
        plain = F.array(*[F.array(F.lit(suffix), first, last) for suffix, first, last in listed])
        return F.transform(
            plain,
            lambda p: F.struct(
                p[0].alias("patternSuffix"), F.struct(p[1].alias("id")).alias("firstStop"), F.struct(p[2].alias("id")).alias("lastStop")
            ),
        )

    first, last, nowhere = _stop_name(base), _stop_name(base + ROUTE_STOPS - 1), F.lit("Z")
    usual = F.format_string("06:00,06:20,%02d:%02d", F.lit(7), k % 10)
    dense = F.format_string("06:00,06:10,06:20,%02d:%02d", F.lit(6), 25 + k % 7)
    encoded = F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.lit(LINE_POINTS - 1)),
            lambda i: F.concat(F.char(63 + 2 * ((k + i) % 16)), F.char(63 + 2 * ((k * 3 + i) % 16))),
        ),
        "",
    )
    # Routes are many times larger than customers: all tasks build them, not only those that read the file.
    routes = load(spark, sf_dir, "customer").select(k).repartition(k).select(
        k.alias("pos"),
        F.concat(F.lit("R"), k.cast("string")).alias("id"),
        patterns(("0:01", first, last), ("1:01", last, first), ("0:02", nowhere, last), ("9:99", nowhere, nowhere)).alias("patterns"),
        F.array(block([], usual), block([ROUTE_DAYS[1]], dense)).alias("sched_fwd"),
        F.when(k % 3 != 0, F.array(block([], F.lit("08:00"), backwards=True))).alias("sched_rev"),
        encoded.alias("poly_fwd"),
        F.lit(None).cast("string").alias("poly_rev"),
    )
    return routes.select(F.explode(F.array(*[F.lit(d).cast("date") for d in SNAPSHOT_DAYS])).alias("snapshot_date"), "*")


def line_route(spark: SparkSession) -> DataFrame:
    """The line of ``line_network`` as a snapshot's route; the reverse direction has one stop more in front, by which its pattern is told."""
    names = F.transform(F.sequence(F.lit(0), F.lit(STOP_COUNT - 1)), lambda i: _stop_name(i))
    times = ",".join(f"{s // 3600:02d}:{s % 3600 // 60:02d}" for s in range(FIRST_DEPARTURE_S, LAST_DEPARTURE_S + 1, HEADWAY_S))

    def stops(ids: Column) -> Column:
        # The stop in front has a timetable without a clock time.
        listed = F.transform(ids, lambda s: F.struct(s.alias("id"), F.when(s == "T", "soon,7").otherwise(times).alias("arrivalTimes")))
        return F.array(F.struct(F.array().cast("array<string>").alias("serviceDates"), listed.alias("stops")))

    def pattern(suffix: str, first: str) -> Column:
        last = F.lit(f"S{STOP_COUNT - 1}")
        return F.struct(F.lit(suffix).alias("patternSuffix"), F.struct(F.lit(first).alias("id")).alias("firstStop"), F.struct(last.alias("id")).alias("lastStop"))

    return spark.range(1).select(
        F.lit(1 << 40).alias("pos"), F.lit("R1").alias("id"), F.array(pattern("0:01", "S0"), pattern("1:01", "T")).alias("patterns"),
        stops(names).alias("sched_fwd"), stops(F.concat(F.array(F.lit("T")), names)).alias("sched_rev"),
        F.lit(None).cast("string").alias("poly_fwd"), F.lit(None).cast("string").alias("poly_rev"),
    )


def line_stops(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(STOP_COUNT).select(
        (F.lit(1 << 40) + i).alias("pos"), _stop_name(i).alias("id"), F.lit(LINE_LAT).alias("lat"),
        (LINE_LON + i * float(STOP_SPACING_M) / METRES_PER_DEGREE).alias("lon"),
    )


def route_entries(routes: DataFrame) -> DataFrame:
    """Routes as entries of a snapshot: with a reverse direction in the newer form, without one in the older."""
    newer = F.col("sched_rev").isNotNull()
    lists = lambda name: F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("weekdaySchedules")))
    line = lambda name: F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("encodedValue")))
    return routes.select(
        "pos", "id", F.struct("patterns").alias("detail"),
        F.struct(F.when(newer, line("poly_fwd")).alias("fwd"), F.when(newer, line("poly_rev")).alias("rev"), F.when(~newer, F.col("poly_fwd")).alias("encodedValue")).alias("polyline"),
        F.struct(
            F.when(newer, lists("sched_fwd")).alias("fwd"), F.when(newer, lists("sched_rev")).alias("rev"), F.when(~newer, F.col("sched_fwd")).alias("weekdaySchedules")
        ).alias("schedule"),
    )


def customer_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop points named many times over; the last customer of a name places it. ``S43`` has none."""
    k = F.col("c_custkey")
    rows = load(spark, sf_dir, "customer").select(
        k.alias("pos"), _stop_name(k % 43).alias("id"), (41.0 + k / 10_000.0).alias("lat"), (44.0 + k / 20_000.0).alias("lon")
    )
    return rows.select(F.explode(F.array(*[F.lit(d).cast("date") for d in SNAPSHOT_DAYS])).alias("snapshot_date"), "*")


def order_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as collection replies: two suffixes, one of them empty for some."""
    vehicle = F.struct(
        F.col("o_custkey").cast("string").alias("vehicleId"), (F.col("o_totalprice") / 1e4).alias("lat"),
        (F.col("o_totalprice") / 2e4).alias("lon"), _stop_name(F.col("o_orderkey") % 9).alias("nextStopId"),
    )
    empty = F.slice(F.array(vehicle), 1, 0)
    return load(spark, sf_dir, "orders").select(
        F.concat(F.lit("R"), (F.col("o_orderkey") % 17).cast("string")).alias("route_id"),
        (F.col("o_orderkey") % 17).cast("string").alias("short_name"),
        F.timestamp_seconds(
            F.lit(TRACE_START_MS // 1000) + F.col("o_orderkey") % 7 * 86_400 + F.col("o_orderkey") % 1440 * 60
        ).alias("sampled_at"),
        F.create_map(
            F.lit("0:01"), F.array(vehicle, vehicle),
            F.lit("1:01"), F.when(F.col("o_orderkey") % 2 == 0, F.array(vehicle)).otherwise(empty),
        ).alias("reply"),
    )


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as permit replies: labelled fields appended, every sixth one a PDF by its signature."""
    key = F.col("page_id")
    when = F.format_string("%d.%d.%d", key % 28 + 1, key % 12 + 1, key % 30 + 1990)
    page = F.concat(
        F.col("html"), F.lit(f"<b>{tx.LABEL_REGISTERED}</b>:&nbsp;"), when,
        F.lit(f"<td>{tx.LABEL_RESULT} : "), F.when(key % 2 == 0, "დადებითი").otherwise("უარყოფითი"), F.lit("</td>"),
    )
    body = F.when(key % 6 == 5, F.concat(F.lit("%PDF-1.7 "), F.col("url"))).otherwise(page)
    return load(spark, sf_dir, "pages").select(
        F.concat(F.lit("doc-"), key.cast("string")).alias("doc_id"), F.encode(body, "UTF-8").alias("body")
    )


def page_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as escaped markup inside a reply; every fourth one without its list items."""
    key = F.col("page_id")
    bare = F.when(key % 4 == 3, F.regexp_replace("html", "(?i)</?li>", "")).otherwise(F.col("html"))
    escaped = F.replace(F.replace(bare, F.lit('"'), F.lit('\\"')), F.lit("/"), F.lit("\\/"))
    escaped = F.replace(F.replace(escaped, F.lit("\n"), F.lit("\\n")), F.lit("é"), F.lit("\\u00e9"))
    code = F.format_string("%02d.%02d.%02d.%03d.%03d", key % 97, key % 13, key % 7, key % 501, key % 333)
    return load(spark, sf_dir, "pages").select(
        key.cast("string").alias("doc_id"),
        F.concat(code, F.lit(' s0.nomenklaturMarkup:"'), escaped, F.lit('"; '), code).alias("body"),
    )
