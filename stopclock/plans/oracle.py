"""The registered queries again as plain SQL over the same tables, written independently of the operators."""

from __future__ import annotations

from stopclock.functions import text as tx

AS_OF_US = 1_706_659_200_000_000
DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def half_up(x: str, decimals: int = 0) -> str:
    if decimals == 0:
        return f"CAST(floor({x} + 0.5) AS BIGINT)"
    return f"(floor(({x}) * 1e{decimals} + 0.5) / 1e{decimals})"


def int_half_up(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS INTEGER)"


def at_index(x: str, p: float) -> str:
    """Sorted non-null value at zero-based index min(n - 1, floor(p n))."""
    n = f"count({x})"
    return f"list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL))[CAST(1 + least({n} - 1, floor({p} * {n})) AS BIGINT)]"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    def sq(x):
        return f"({x}) * ({x})"

    a = (
        f"{sq(f'sin(({lat2} - {lat1}) * pi() / 180 / 2)')} + cos({lat1} * pi() / 180) * cos({lat2} * pi() / 180) * "
        f"{sq(f'sin(({lon2} - {lon1}) * pi() / 180 / 2)')}"
    )
    return f"(2 * 6371000.0::DOUBLE * asin(sqrt({a})))"


ARR = """arr AS (
  SELECT CAST(ts AS DATE) AS service_date, 'S' || (user_id % 3) AS stop_id,
         CASE WHEN event_type IN ('click', 'view') THEN 'R1' ELSE 'R2' END AS route_id,
         CAST(event_id % 2 AS INTEGER) AS direction, CAST(epoch_us(ts) AS DOUBLE) / 1000 AS ts_ms,
         CASE WHEN value * 10 - 200 <= 1200 THEN CAST(floor(value * 10 - 200 + 0.5) AS INTEGER) END AS delay_s,
         CAST(hour(ts) AS INTEGER) AS hour
  FROM events)"""

COUNTS = """CAST(count(*) AS INTEGER) AS n_obs, CAST(count(delay_s) AS INTEGER) AS n_matched,
  CAST(count(*) FILTER (WHERE delay_s BETWEEN -60 AND 300) AS INTEGER) AS on_time,
  CAST(count(*) FILTER (WHERE delay_s > 300) AS INTEGER) AS late,
  CAST(count(*) FILTER (WHERE delay_s < -60) AS INTEGER) AS early"""

KEYS = "service_date, stop_id, route_id, direction"


def headways(arr: str) -> str:
    return f"""gaps AS (
  SELECT {KEYS}, ts_ms, (ts_ms - lag(ts_ms) OVER (PARTITION BY {KEYS} ORDER BY ts_ms)) / 1000 AS h FROM {arr}),
hw AS (SELECT * FROM gaps WHERE h > 60 AND h < 3600),
hs AS (SELECT {KEYS}, count(*) AS n_headways, {int_half_up('quantile_cont(h, 0.5)')} AS headway_med_s,
         CASE WHEN count(*) >= 3 THEN sum(h * h) / (2 * (sum(h) / count(*)) * count(*)) END AS wait_s
       FROM hw GROUP BY ALL)"""


def daily(arr: str, hour_free: bool = True) -> str:
    return f"""{headways(arr)},
delays AS (SELECT {KEYS}, {COUNTS}, {int_half_up('quantile_cont(delay_s, 0.5)')} AS delay_med_s,
             {at_index('delay_s', 0.9)} AS delay_p90_s FROM {arr} GROUP BY {KEYS}),
daily AS (SELECT delays.service_date AS date, delays.stop_id, delays.route_id, delays.direction, n_obs, n_matched, on_time, late, early,
            delay_med_s, delay_p90_s, headway_med_s, 3600 AS headway_sched_s,
            CASE WHEN wait_s IS NOT NULL THEN {int_half_up('greatest(0, wait_s - 1800)')} END AS ewt_s
          FROM delays LEFT JOIN hs USING ({KEYS}))"""


def hourly(arr: str) -> str:
    return f"""hourly AS (SELECT service_date AS date, stop_id, route_id, direction, hour, {COUNTS},
             {int_half_up('quantile_cont(delay_s, 0.5)')} AS delay_med_s FROM {arr} GROUP BY ALL)"""


def text_date(sql: str, *names: str) -> str:
    swaps = ", ".join(f"CAST({n} AS VARCHAR) AS {n}" for n in names)
    return f"{sql.rstrip()}" if not names else f"SELECT * REPLACE ({swaps}) FROM ({sql})"


SPAN = "date BETWEEN DATE '2024-01-03' AND DATE '2024-01-28'"
PICKED = f"stop_id IN ('S0', 'S1') AND {SPAN}"
DAY_TYPES = {"weekday": "isodow(date) <= 5", "sat": "isodow(date) = 6", "sun": "isodow(date) = 7"}
BANDS = {
    "am_peak": "hour BETWEEN 7 AND 9", "midday": "hour BETWEEN 10 AND 16", "pm_peak": "hour BETWEEN 17 AND 19",
    "evening": "(hour >= 20 OR hour <= 6)",
}
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("n_obs", "n_matched", "on_time", "late", "early"))


def stats_from_daily(where: str) -> str:
    return f"""SELECT stop_id, {SUMS}, quantile_cont(delay_med_s, 0.5) AS delay_med_s,
  quantile_cont(delay_p90_s, 0.5) AS delay_p90_s,
  sum(ewt_s * n_obs)::DOUBLE / nullif(sum(n_obs) FILTER (WHERE ewt_s IS NOT NULL), 0) AS ewt_s,
  quantile_cont(headway_med_s, 0.5) AS headway_med_s FROM daily WHERE {where} GROUP BY stop_id"""


def history(day_type: str | None, band: str | None) -> str:
    days = DAY_TYPES.get(day_type, "true")
    if band == "all":
        return f"WITH {ARR}, {daily('arr')} {stats_from_daily(f'{PICKED} AND {days}')}"
    hours = "false" if band is None else BANDS.get(band, "true")
    return f"""WITH {ARR}, {hourly('arr')} SELECT stop_id, {SUMS}, quantile_cont(delay_med_s, 0.5) AS delay_med_s,
  CAST(NULL AS DOUBLE) AS delay_p90_s, CAST(NULL AS DOUBLE) AS ewt_s, CAST(NULL AS DOUBLE) AS headway_med_s
  FROM hourly WHERE {PICKED} AND {days} AND {hours} GROUP BY stop_id"""


ALL_STATS = f"WITH {ARR}, {daily('arr')}, stats AS ({stats_from_daily('true')})"
MEASURED = """measured AS (SELECT stop_id, n_obs, n_matched, n_matched < 30 AS insufficient,
  CASE WHEN n_matched >= 30 THEN on_time / n_matched END AS on_time_share,
  CASE WHEN n_matched >= 30 THEN late / n_matched END AS late_share,
  CASE WHEN n_matched >= 30 THEN delay_med_s END AS delay_med_s,
  CASE WHEN n_matched >= 30 THEN headway_med_s END AS headway_med_s FROM stats)"""
ROUTES = f"""routes AS (SELECT route_id, {SUMS}, count(DISTINCT date) AS days,
  {half_up('sum(on_time)::DOUBLE / nullif(sum(n_matched), 0)', 6)} AS on_time_share,
  {half_up('sum(n_obs)::DOUBLE / count(DISTINCT date)', 6)} AS obs_per_day FROM daily WHERE {PICKED} GROUP BY route_id)"""
HOUR_PROFILE = """SELECT hour, CAST(sum(n_matched) AS BIGINT) AS n_matched, CAST(sum(on_time) AS BIGINT) AS on_time,
  CAST(sum(late) AS BIGINT) AS late, quantile_cont(delay_med_s, 0.5) AS delay_med_s FROM hourly WHERE"""


# Positions

LON = "44.78::DOUBLE"


def positions(days: int, whole_ms: bool = False) -> str:
    ts = "1705287600000::DOUBLE + us / 120000::DOUBLE + shift * 86400000::DOUBLE"
    return f"""raw AS (SELECT CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) AS us, user_id, value, user_id % {days} AS shift FROM events),
pos AS (SELECT DATE '2024-01-15' + CAST(shift AS INTEGER) AS service_date, CAST(user_id AS VARCHAR) AS vehicle_id,
    (user_id % 2) || ':01' AS pattern_suffix, CAST((user_id + 1) % 2 AS INTEGER) AS direction,
    {f'floor({ts})' if whole_ms else ts} AS ts_ms,
    (4::DOUBLE * us / 120000000::DOUBLE + value) % 9000::DOUBLE AS d FROM raw),
samples AS (SELECT service_date, vehicle_id, pattern_suffix, direction, ts_ms, 41.7::DOUBLE AS lat, {LON} + d / 83000 AS lon,
    'S' || CAST(floor(d / 400) + 1 AS BIGINT) AS next FROM pos)"""


PAIRS = """lagged AS (SELECT *, lag(ts_ms) OVER w AS a_ts, lag(lon) OVER w AS a_lon, lag(next) OVER w AS a_next
  FROM samples WINDOW w AS (PARTITION BY service_date, vehicle_id, pattern_suffix ORDER BY ts_ms, lat, lon, next)),
pairs AS (SELECT *, ts_ms - a_ts AS dt, row_number() OVER () AS pid FROM lagged WHERE ts_ms - a_ts > 0 AND ts_ms - a_ts <= 360000)"""


PAIR_COLUMNS = f"""service_date, vehicle_id, pattern_suffix, {half_up('a_ts')} AS a_ms, {half_up('ts_ms')} AS b_ms,
  a_next AS a_next_stop_id, next AS b_next_stop_id, {half_up('dt')} AS dt_ms"""


def _stop_lon(k: str) -> str:
    return f"({LON} + {k} * 400::DOUBLE / 83000)"


ARRIVALS = f"""changes AS (SELECT *, CAST(substr(a_next, 2) AS INTEGER) AS i1, CAST(substr(next, 2) AS INTEGER) AS i2 FROM pairs
  WHERE a_next <> next),
forward AS (SELECT * FROM changes WHERE i2 > i1 AND i1 <= 23 AND i2 <= 23),
passed AS (SELECT *, unnest(range(i1, i2)) AS k FROM forward),
legs AS (SELECT *, greatest(20, CASE WHEN k = i1 THEN {hav('lat', 'a_lon', 'lat', _stop_lon('k'))}
    ELSE {hav('lat', _stop_lon('(k - 1)'), 'lat', _stop_lon('k'))} END) AS leg,
    greatest(20, {hav('lat', _stop_lon('(i2 - 1)'), 'lat', 'lon')}) AS tail FROM passed),
runs AS (SELECT *, sum(leg) OVER (PARTITION BY pid ORDER BY k) AS run, sum(leg) OVER (PARTITION BY pid) + tail AS total FROM legs),
timed AS (SELECT service_date, 'S' || k AS stop_id, 'R1' AS route_id, direction, a_ts + dt * (run / total) AS ts_ms FROM runs),
clocked AS (SELECT *, (ts_ms - (CAST(epoch(service_date) AS DOUBLE) * 1000 - 14400000)) / 1000 AS at_s FROM timed),
nearest AS (SELECT *, list_min(list_transform(range(25200, 46801, 3600), lambda t: {{'off': abs(at_s - t), 'entry': t}})) AS best FROM clocked),
arr AS (SELECT service_date, stop_id, route_id, direction, ts_ms,
    CAST((CAST(floor(ts_ms / 3600000) AS BIGINT) + 4) % 24 AS INTEGER) AS hour,
    CASE WHEN best.off <= 1200 THEN {int_half_up('at_s - best.entry')} END AS delay_s FROM nearest)"""

_VERTEX = f"({LON} + j * 50::DOUBLE / 83000)"
SPEEDS = f"""line AS (SELECT j, {_VERTEX} AS vlon FROM range(0, 181) t(j)),
steps AS (SELECT j, vlon, coalesce({hav('41.7::DOUBLE', 'lag(vlon) OVER (ORDER BY j)', '41.7::DOUBLE', 'vlon')}, 0) AS step FROM line),
verts AS (SELECT j, vlon, sum(step) OVER (ORDER BY j) AS cum FROM steps),
moving AS (SELECT *, {hav('lat', 'a_lon', 'lat', 'lon')} AS m FROM pairs),
fast AS (SELECT *, (m / 1000) / (dt / 3600000) AS kmh FROM moving),
usable AS (SELECT * FROM fast WHERE kmh <= 65 AND m > 15),
near_a AS (SELECT pid, min({{'d': (vlon - a_lon) * (vlon - a_lon), 'j': j, 'cum': cum}}).cum AS d1 FROM usable, verts GROUP BY pid),
near_b AS (SELECT pid, min({{'d': (vlon - lon) * (vlon - lon), 'j': j, 'cum': cum}}).cum AS d2 FROM usable, verts GROUP BY pid),
kept AS (SELECT * FROM usable JOIN near_a USING (pid) JOIN near_b USING (pid) WHERE d2 > d1 AND d2 - d1 < 3000),
speeds AS (SELECT service_date, strftime(service_date, '%G-W%V') AS iso_week, 'R1' AS route_id, direction, kmh,
    unnest(range(CAST(floor(d1 / 150) AS INTEGER), CAST(floor(d2 / 150) AS INTEGER) + 1)) AS bin_idx,
    (CAST(floor(a_ts / 3600000) AS BIGINT) + 4) % 24 AS h FROM kept),
banded AS (SELECT * EXCLUDE (h, bin_idx), CAST(bin_idx AS INTEGER) AS bin_idx, CASE WHEN h BETWEEN 7 AND 9 THEN 'am_peak' WHEN h BETWEEN 10 AND 16 THEN 'midday'
    WHEN h BETWEEN 17 AND 19 THEN 'pm_peak' ELSE 'evening' END AS band FROM speeds)"""
SPEED_STATS = f"""count(*) AS n, {half_up('quantile_cont(kmh, 0.5)', 1)} AS speed_med_kmh,
  {half_up(at_index('kmh', 0.15), 1)} AS speed_p15_kmh"""
WEEK_KEYS = "iso_week, route_id, direction, bin_idx, band"


# Subscriptions

BILLING = f"""ev AS (SELECT event_id, epoch_us(ts) AS at_us, CAST(user_id AS VARCHAR) AS user_id,
    CASE event_type WHEN 'signup' THEN 'activated' WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'updated' WHEN 'click' THEN 'past_due'
      ELSE CASE WHEN event_id % 2 = 0 THEN 'canceled' ELSE 'paused' END END AS kind,
    'obj_' || event_id AS obj, CASE WHEN event_id % 5 <> 0 THEN 'sub_' || user_id END AS sub,
    CASE WHEN event_id % 2 = 0 THEN 'canceled' ELSE 'active' END AS status_in,
    epoch_us(ts) - (event_id % 60) * {DAY_US} AS started,
    epoch_us(ts) + (CAST(floor(value) AS BIGINT) - 35) * {DAY_US} AS ends,
    CASE WHEN user_id % 3 = 0 THEN 'year' ELSE 'month' END AS itv,
    event_id % 7 = 0 AS consent FROM events)"""

CUSTOMERS = f"""cust AS (SELECT c_custkey AS key, CAST(c_custkey AS VARCHAR) AS user_id, CASE WHEN c_custkey % 4 = 0 THEN 'free' ELSE 'pro' END AS plan,
    ['trialing', 'active', 'canceling', 'canceled', 'past_due'][c_custkey % 5 + 1] AS status,
    CASE WHEN c_custkey % 11 <> 0 THEN 'sub_' || c_custkey END AS sub,
    CASE WHEN c_custkey % 3 = 0 THEN 'year' ELSE 'month' END AS itv,
    CASE WHEN c_custkey % 13 <> 0 THEN {AS_OF_US} + (c_custkey % 400 - 20) * {DAY_US} END AS ends,
    'cus_' || c_custkey AS cus, {AS_OF_US} - (c_custkey % 90) * {DAY_US} AS started, {AS_OF_US} AS touched,
    c_custkey % 5 = 0 AS trial_active, {AS_OF_US} + (c_custkey % 240 - 60) * {HOUR_US} AS trial_ends,
    CASE WHEN c_custkey % 7 <> 0 THEN c_name || '@example.org' END AS email, c_name,
    c_custkey % 10 = 1 AS is_admin FROM customer)"""


def state(policy: str, with_current: bool = False) -> str:
    server = policy == "server"
    prior = ""
    ctes = f"WITH {BILLING}"
    if with_current:
        ctes += f", {CUSTOMERS}"
        prior = """UNION ALL SELECT -1, -1, user_id, 'prior', NULL, NULL, NULL, started, ends, itv, NULL, plan, status, sub, cus, touched
          FROM cust WHERE status <> 'past_due'"""
    outside = "kind = 'updated' AND NOT coalesce(held_start + CASE WHEN held_itv = 'year' THEN 365 ELSE 30 END * "
    outside += f"{DAY_US} > at_us, false)"
    cond_end = f"kind IN ('activated', 'canceled', 'prior') OR (kind = 'completed' AND sub IS NULL) OR ({outside})"
    cond_id = "kind IN ('completed', 'activated', 'prior')" + ("" if server else f" OR ({outside})")
    cond_touch = "true" if server else "kind IN ('updated', 'prior')"
    frees = "('paused', 'canceled')" if server else "('paused')"
    return f"""{ctes},
evs AS (SELECT *, NULL AS p_plan, NULL AS p_status, NULL AS p_sub, 'cus_' || user_id AS p_cus, at_us AS p_touched FROM ev {prior}),
scan AS (SELECT *, row_number() OVER o AS seq,
    max(CASE WHEN kind IN ('completed', 'activated', 'prior') THEN 1 ELSE 0 END) OVER (o ROWS UNBOUNDED PRECEDING) AS live,
    last_value(CASE WHEN kind IN ('activated', 'prior') THEN started END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held_start,
    last_value(CASE WHEN kind IN ('activated', 'completed', 'prior') THEN itv END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held_itv
  FROM evs WINDOW o AS (PARTITION BY user_id ORDER BY at_us, event_id)),
live AS (SELECT * FROM scan WHERE live = 1)
SELECT user_id,
  arg_max({{'v': CASE WHEN kind = 'prior' THEN p_plan WHEN kind IN ('completed', 'activated') THEN 'pro' ELSE 'free' END}}, seq)
    FILTER (WHERE kind IN ('prior', 'completed', 'activated') OR kind IN {frees}).v AS plan,
  arg_max({{'v': CASE kind WHEN 'prior' THEN p_status WHEN 'completed' THEN 'active' WHEN 'activated' THEN 'active'
      WHEN 'updated' THEN CASE WHEN status_in = 'canceled' AND ends > at_us THEN 'canceling' ELSE status_in END
      WHEN 'canceled' THEN '{"canceled" if server else "canceling"}' ELSE kind END}}, seq).v AS status,
  arg_max({{'v': CASE kind WHEN 'prior' THEN p_sub WHEN 'completed' THEN coalesce(sub, obj) ELSE obj END}}, seq)
    FILTER (WHERE {cond_id}).v AS paddle_subscription_id,
  arg_max({{'v': itv}}, seq) FILTER (WHERE kind IN ('completed', 'activated', 'prior')).v AS billing_interval,
  arg_max({{'v': CASE WHEN kind = 'activated' THEN started + CASE WHEN itv = 'year' THEN 365 ELSE 30 END * {DAY_US} ELSE ends END}}, seq)
    FILTER (WHERE {cond_end}).v // 1000 AS period_end_ms,
  arg_max({{'v': p_cus}}, seq) FILTER (WHERE kind IN ('completed', 'activated', 'prior')).v AS paddle_customer_id,
  arg_max({{'v': started}}, seq) FILTER (WHERE kind IN ('activated', 'prior')).v // 1000 AS started_ms,
  arg_max({{'v': p_touched}}, seq) FILTER (WHERE {cond_touch}).v // 1000 AS updated_ms
FROM live GROUP BY user_id"""


def cancellation(policy: str) -> str:
    server = policy == "server"
    statuses = "('active', 'trialing')" if server else "('active')"
    return f"""WITH {CUSTOMERS}, c AS (SELECT *, status = 'trialing' AS trial,
    coalesce((ends - {AS_OF_US}) / {DAY_US}::DOUBLE, 999) AS days FROM cust WHERE status IN {statuses} AND sub IS NOT NULL),
  r AS (SELECT *, NOT trial AND itv = 'year' AND days >= 335 AS refund FROM c)
  SELECT user_id, trial AS was_trial, {half_up('days', 4)} AS days_until_end,
    CASE WHEN trial OR refund THEN 'immediately' ELSE 'next_billing_period' END AS effective_from,
    CASE WHEN refund THEN 'canceled' ELSE 'canceling' END AS new_status,
    CASE WHEN refund THEN 'free' ELSE plan END AS new_plan,
    CASE WHEN NOT refund THEN sub END AS new_subscription_id FROM r"""


OWNED = "SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS user_id, o_orderstatus AS status FROM orders"
REMINDER = f"""CASE WHEN trial_ends >= {AS_OF_US} + 84 * {HOUR_US} AND trial_ends < {AS_OF_US} + 108 * {HOUR_US} THEN 'four_day'
  WHEN trial_ends >= {AS_OF_US} + 12 * {HOUR_US} AND trial_ends < {AS_OF_US} + 36 * {HOUR_US} THEN 'last_day' END"""
EXPIRES = f"status = 'trialing' AND trial_ends < {AS_OF_US}"
FINISHES = f"status = 'canceling' AND ends < {AS_OF_US}"

SPACE = tx.SPACE.replace(r"\x0B", r"\v")
USES = """uses AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CASE event_type WHEN 'click' THEN 'map_click' WHEN 'view' THEN 'free_analysis'
    WHEN 'purchase' THEN 'pro_analysis' WHEN 'signup' THEN 'pdf_export' ELSE 'other' END AS feature, date_trunc('month', ts) AS m FROM events),
activity AS (SELECT user_id, strftime(m, '%Y-%m-%d') AS month, feature, count(*) AS uses FROM uses WHERE feature <> 'other' GROUP BY ALL)"""
CELLS = """cells AS (SELECT p_brand AS area_id, p_retailprice AS height, (p_partkey * 7 % 450) / 10::DOUBLE AS slope,
    (p_partkey * 13 % 3600) / 10::DOUBLE AS aspect FROM part)"""


def plain_text(html: str) -> str:
    stripped = f"regexp_replace({html}, '<[^>]+>', ' ', 'g')"
    unspaced = f"regexp_replace({stripped}, '(?i)&nbsp;', ' ', 'g')"
    return f"regexp_replace({unspaced}, '{SPACE}+', ' ', 'g')"


def _code(*parts: str) -> str:
    return f"printf('%02d.%02d.%02d.%03d.%03d', {', '.join(parts)})"


_MERC = "6378137::DOUBLE"


def _lat_m(row: str) -> str:
    s = f"(pi() * (1 - 2 * ({row}) / n))"
    return f"ln(tan(pi() / 4 + atan((exp({s}) - exp(-{s})) / 2) / 2)) * {_MERC}"


RATE = """WITH w AS (SELECT CAST(user_id AS VARCHAR) AS client, epoch_us(ts) // 900000000 * 900 AS window_s FROM events)
  SELECT client, window_s, count(*) AS n, count(*) - 1 AS rejected FROM w GROUP BY ALL HAVING count(*) > 1"""

LEDGER = f"""WITH {ARR}, ledger AS (SELECT service_date AS date, count(DISTINCT floor(ts_ms / 3600000)) AS files,
  count(*) AS samples, count(*) AS arrivals, count(delay_s) AS matched FROM arr GROUP BY service_date)"""

ROUTE_MODELS = """k AS (SELECT c_custkey AS k FROM customer),
days(d, snap, blk) AS (VALUES (DATE '2024-01-15', '2024-01-01', 0), (DATE '2024-01-17', '2024-01-16', 1)),
fwd AS (SELECT k, d, snap, snap || '|R' || k || '|1|' || blk AS model_id, blk FROM k, days),
rev AS (SELECT k, d, snap, snap || '|R' || k || '|0|0' AS model_id FROM k, days WHERE k % 3 <> 0)"""

REPLIES = """lines AS (SELECT 'R' || (o_orderkey % 17) AS r, CAST(o_orderkey % 17 AS VARCHAR) AS n, 'S' || (o_orderkey % 9) AS stop,
    CAST(o_custkey AS VARCHAR) AS vehicle, TIMESTAMP '2024-01-15 03:00:00' + to_seconds(o_orderkey % 7 * 86400 + o_orderkey % 1440 * 60) AS sampled,
    unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['0:01', '0:01', '1:01'] ELSE ['0:01', '0:01'] END) AS p FROM orders)"""


def oracle_sql() -> dict[str, str]:
    pages_text = plain_text("html")
    labelled = (
        "html || '<b>" + tx.LABEL_REGISTERED + "</b>:&nbsp;' || printf('%d.%d.%d', page_id % 28 + 1, page_id % 12 + 1, page_id % 30 + 1990) || '<td>"
        + tx.LABEL_RESULT + " : ' || CASE WHEN page_id % 2 = 0 THEN 'დადებითი' ELSE 'უარყოფითი' END || '</td>'"
    )

    def dated(label: str) -> str:
        return f"replace(regexp_extract(plain, '{label}[^0-9]{{0,20}}([0-9]{{1,2}}[/.][0-9]{{1,2}}[/.][0-9]{{4}})', 1), '.', '/')"

    decisions = f"""WITH b AS (SELECT page_id, page_id % 6 = 5 AS pdf, {labelled} AS body, url FROM pages),
            p AS (SELECT *, {plain_text('body')} AS plain FROM b)
            SELECT CAST(page_id AS VARCHAR) AS doc_id, CASE WHEN pdf THEN 'pdf' ELSE 'html' END AS format,
            CASE WHEN NOT pdf THEN {dated(tx.LABEL_REGISTERED)} END AS registered, CASE WHEN NOT pdf THEN {dated(tx.LABEL_ISSUED)} END AS issued,
            CASE WHEN NOT pdf THEN regexp_extract(plain, '{tx.LABEL_RESULT}{SPACE}*:?{SPACE}*([ა-ჰ]+)', 1) END AS result,
            CASE WHEN pdf THEN to_base64(encode('%PDF-1.7 ' || url)) END AS base64 FROM p"""
    return {
        "stop_daily": text_date(f"WITH {ARR}, {daily('arr')} SELECT * FROM daily", "date"),
        "stop_hourly": text_date(f"WITH {ARR}, {hourly('arr')} SELECT * FROM hourly", "date"),
        "observed_headways": text_date(
            f"WITH {ARR}, {headways('arr')} SELECT {KEYS}, {half_up('ts_ms * 1000')} AS at_us, {half_up('h', 3)} AS headway_s FROM hw",
            "service_date"),
        "excess_wait": text_date(
            f"""WITH {ARR}, {headways('arr')} SELECT {KEYS}, n_headways, headway_med_s, {half_up('wait_s', 3)} AS wait_s,
            CASE WHEN wait_s IS NOT NULL THEN {int_half_up('greatest(0, wait_s - 1800)')} END AS ewt_s FROM hs""", "service_date"),
        "bucketed_quantiles": f"""SELECT l_returnflag, l_linestatus, count(*) AS n, floor(quantile_cont(l_extendedprice, 0.5) + 0.5) AS med,
            floor({at_index('l_extendedprice', 0.15)} + 0.5) AS p15, floor({at_index('l_extendedprice', 0.9)} + 0.5) AS p90
            FROM lineitem GROUP BY ALL""",
        "history_stats_all": history("all", "all"),
        "history_stats_weekday": history("weekday", "all"),
        "history_stats_v1": history(None, "all"),
        "history_stats_am_peak": history("all", "am_peak"),
        "history_stats_midday_sat": history("sat", "midday"),
        "history_stats_pm_peak": history("weekday", "pm_peak"),
        "history_stats_evening_sun": history("sun", "evening"),
        "history_stats_unknown_band": history("all", "night"),
        "history_stats_null_band": history("all", None),
        "history_hourly": f"WITH {ARR}, {hourly('arr')} {HOUR_PROFILE} {PICKED} AND isodow(date) <= 5 GROUP BY hour",
        "history_hourly_area": f"WITH {ARR}, {hourly('arr')} {HOUR_PROFILE} {PICKED} GROUP BY hour",
        "history_coverage": f"""WITH {ARR} SELECT CAST(min(service_date) AS VARCHAR) AS first_date,
            CAST(max(service_date) AS VARCHAR) AS last_date, count(DISTINCT service_date) AS days FROM arr""",
        "derive_ledger": f"{LEDGER} SELECT CAST(date AS VARCHAR) AS date, files, samples, arrivals, matched FROM ledger",
        "stored_ledger": f"""{LEDGER} SELECT CAST(date AS VARCHAR) AS date, CASE WHEN day(date) % 3 = 0 THEN files + 100 ELSE files END AS files,
            samples, arrivals, matched FROM ledger""",
        "area_reliability": f"""{ALL_STATS}, s AS (SELECT count(*) AS stops, CAST(sum(n_obs) AS BIGINT) AS n_obs,
            sum(on_time / n_matched * n_obs) FILTER (WHERE n_matched > 0) / sum(n_obs) FILTER (WHERE n_matched > 0) AS score FROM stats)
            SELECT stops, n_obs, {half_up('score', 6)} AS score, CASE WHEN score >= 0.8 THEN 'A' WHEN score >= 0.7 THEN 'B'
            WHEN score >= 0.6 THEN 'C' WHEN score >= 0.5 THEN 'D' WHEN score >= 0.4 THEN 'E' ELSE 'F' END AS grade FROM s""",
        "area_medians": f"""WITH {ARR}, {daily('arr')} SELECT quantile_cont(delay_med_s, 0.5) AS delay_med_s,
            quantile_cont(delay_p90_s, 0.5) AS delay_p90_s, quantile_cont(headway_med_s, 0.5) AS headway_med_s FROM daily WHERE {PICKED}""",
        "stop_measures": f"""{ALL_STATS}, {MEASURED} SELECT stop_id, n_obs, n_matched, {half_up('on_time_share', 6)} AS on_time_share,
            {half_up('late_share', 6)} AS late_share, delay_med_s, headway_med_s, insufficient FROM measured""",
        "worst_stops": f"""{ALL_STATS}, {MEASURED}, r AS (SELECT stop_id, n_matched, on_time_share,
            CAST(row_number() OVER (ORDER BY on_time_share, stop_id) AS INTEGER) AS rank FROM measured WHERE NOT insufficient)
            SELECT stop_id, n_matched, {half_up('on_time_share', 6)} AS on_time_share, rank FROM r WHERE rank <= 2""",
        "route_measures": f"WITH {ARR}, {daily('arr')}, {ROUTES} SELECT * FROM routes",
        "worst_route": f"WITH {ARR}, {daily('arr')}, {ROUTES} SELECT route_id, on_time_share FROM routes ORDER BY on_time_share, route_id LIMIT 1",
        "sample_pairs": text_date(
            f"WITH {positions(1)}, {PAIRS} SELECT {PAIR_COLUMNS} FROM pairs", "service_date"),
        "stop_arrivals": text_date(
            f"""WITH {positions(1)}, {PAIRS}, {ARRIVALS} SELECT {KEYS}, {half_up('ts_ms')} AS at_ms, delay_s FROM arr""", "service_date"),
        "arrival_delays": text_date(f"WITH {positions(1)}, {PAIRS}, {ARRIVALS}, {hourly('arr')} SELECT * FROM hourly", "date"),
        "derived_stop_daily": text_date(f"WITH {positions(1)}, {PAIRS}, {ARRIVALS}, {daily('arr')} SELECT * FROM daily", "date"),
        "segment_speeds": f"""WITH {positions(1)}, {PAIRS}, {SPEEDS} SELECT iso_week, direction, bin_idx, band, count(*) AS n,
            {half_up('sum(kmh)', 2)} AS sum_kmh, {half_up('max(kmh)', 4)} AS max_kmh FROM banded GROUP BY ALL""",
        "segment_weekly_merge": f"""WITH {positions(3)}, {PAIRS}, {SPEEDS} SELECT {WEEK_KEYS}, {SPEED_STATS} FROM banded
            GROUP BY {WEEK_KEYS} HAVING count(*) >= 3""",
        "segment_weekly_last_day": f"""WITH {positions(3)}, {PAIRS}, {SPEEDS}, per_day AS (SELECT service_date, {WEEK_KEYS}, {SPEED_STATS} FROM banded
            GROUP BY service_date, {WEEK_KEYS} HAVING count(*) >= 3)
            SELECT * EXCLUDE (service_date) FROM per_day QUALIFY row_number() OVER (PARTITION BY {WEEK_KEYS} ORDER BY service_date DESC) = 1""",
        "network_patterns": f"""WITH {ROUTE_MODELS} SELECT CAST(d AS VARCHAR) AS service_date, 'R' || k AS route_id, s AS pattern_suffix,
            1 AS direction, model_id FROM fwd, (VALUES ('0:01'), ('0:02')) t(s)
            UNION ALL SELECT CAST(d AS VARCHAR), 'R' || k, '1:01', 0, model_id FROM rev""",
        "network_sequences": f"""WITH {ROUTE_MODELS}, placed AS (SELECT 'S' || (c_custkey % 43) AS stop_id, max(c_custkey) AS last FROM customer GROUP BY 1),
            seq AS (SELECT model_id, i AS idx, 'S' || (k % 40 + i) AS stop_id FROM fwd, range(0, 5) t(i)
              UNION ALL SELECT model_id, i, 'S' || (k % 40 + 4 - i) FROM rev, range(0, 5) t(i))
            SELECT model_id, CAST(idx AS INTEGER) AS idx, stop_id, {half_up('41 + last / 10000', 6)} AS lat, {half_up('44 + last / 20000', 6)} AS lon
            FROM seq LEFT JOIN placed USING (stop_id)""",
        "network_headways": f"""WITH {ROUTE_MODELS} SELECT CAST(d AS VARCHAR) AS service_date, 'R' || k AS route_id, 1 AS direction, 'S' || (k % 40 + i) AS stop_id,
            CASE WHEN blk = 1 THEN 600::DOUBLE ELSE (60 + k % 10) * 30::DOUBLE END AS headway_sched_s FROM fwd, range(0, 5) t(i)""",
        "network_vertices": f"""WITH {ROUTE_MODELS}, v AS (SELECT model_id, i,
              sum((k + i) % 16) OVER w AS lat_e5, sum((k * 3 + i) % 16) OVER w AS lon_e5 FROM fwd, range(0, 12) t(i)
              WINDOW w AS (PARTITION BY model_id ORDER BY i)),
            g AS (SELECT *, lat_e5 / 1e5::DOUBLE AS lat, lon_e5 / 1e5::DOUBLE AS lon FROM v),
            l AS (SELECT *, lag(lat) OVER o AS plat, lag(lon) OVER o AS plon FROM g WINDOW o AS (PARTITION BY model_id ORDER BY i)),
            s AS (SELECT *, coalesce({hav('plat', 'plon', 'lat', 'lon')}, 0) AS step FROM l)
            SELECT model_id, CAST(i AS INTEGER) AS idx, CAST(lat_e5 AS BIGINT) AS lat_e5, CAST(lon_e5 AS BIGINT) AS lon_e5,
            {half_up('sum(step) OVER (PARTITION BY model_id ORDER BY i)', 3)} AS cum_m FROM s""",
        "routes_with_patterns": """SELECT c_custkey AS id, c_name AS short_name, CASE WHEN c_custkey % 6 = 0 THEN '0:01,1:01'
            WHEN c_custkey % 2 = 0 THEN '0:01' ELSE '1:01' END AS suffixes FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""",
        "flattened_replies": f"""WITH {REPLIES} SELECT r, n, p, stop AS nextStopId, count(*) AS vehicles,
            min(strftime(sampled, '%Y-%m-%dT%H:%M:%S.%gZ')) AS first_t, count(DISTINCT vehicle) AS distinct_vehicles FROM lines GROUP BY ALL""",
        "collected_positions": f"""WITH {REPLIES}, local AS (SELECT *, sampled + INTERVAL 4 HOUR AS l, epoch_ms(sampled) AS ms FROM lines)
            SELECT CAST(CAST(l AS DATE) AS VARCHAR) AS service_date, p AS pattern_suffix, count(*) AS samples, min(ms) AS first_ms, max(ms) AS last_ms,
            count(DISTINCT vehicle) AS vehicles FROM local WHERE hour(l) >= 6 OR hour(l) < 1 GROUP BY ALL""",
        "collected_twice": f"""WITH {REPLIES}, local AS (SELECT *, time_bucket(INTERVAL 10 MINUTE, sampled) + INTERVAL 4 HOUR AS l, epoch_ms(time_bucket(INTERVAL 10 MINUTE, sampled)) AS ms FROM lines)
            SELECT CAST(CAST(l AS DATE) AS VARCHAR) AS service_date, p AS pattern_suffix, count(*) AS samples, min(ms) AS first_ms, max(ms) AS last_ms,
            count(DISTINCT vehicle) AS vehicles FROM local WHERE hour(l) >= 6 OR hour(l) < 1 GROUP BY ALL""",
        "compacted_positions": f"""WITH {REPLIES}, local AS (SELECT *, time_bucket(INTERVAL 10 MINUTE, sampled) + INTERVAL 4 HOUR AS l, epoch_ms(time_bucket(INTERVAL 10 MINUTE, sampled)) AS ms FROM lines)
            SELECT CAST(CAST(l AS DATE) AS VARCHAR) AS service_date, p AS pattern_suffix, count(*) AS samples, min(ms) AS first_ms, max(ms) AS last_ms,
            count(DISTINCT vehicle) AS vehicles FROM local WHERE hour(l) >= 6 OR hour(l) < 1 GROUP BY ALL""",
        "backfill_daily": text_date(f"WITH {positions(3, True)}, {PAIRS}, {ARRIVALS}, {daily('arr')} SELECT * FROM daily", "date"),
        "stream_positions": f"""WITH {positions(3, True)} SELECT CAST(service_date AS VARCHAR) AS service_date, pattern_suffix, count(*) AS samples,
            CAST(min(ts_ms) AS BIGINT) AS first_ms, CAST(max(ts_ms) AS BIGINT) AS last_ms, count(DISTINCT vehicle_id) AS vehicles FROM samples GROUP BY ALL""",
        "snapshot_routes": """SELECT '2024-01-01' AS snapshot_date, 'R' || c_custkey AS id, CASE WHEN c_custkey = 1 THEN 2 ELSE 4 END AS n_patterns,
            CASE WHEN c_custkey = 1 THEN 1 ELSE 2 END AS n_sched_fwd, CAST(c_custkey = 1 OR c_custkey % 3 <> 0 AS INTEGER) AS n_sched_rev,
            CASE WHEN c_custkey <> 1 THEN 24 END AS n_poly, CASE WHEN c_custkey = 1 THEN 378 WHEN c_custkey % 3 <> 0 THEN 40 ELSE 35 END AS entries,
            CASE WHEN c_custkey = 1 THEN 2 ELSE 0 END AS bad FROM customer""",
        "derive_job_rerun": text_date(f"WITH {positions(3, True)}, {PAIRS}, {ARRIVALS}, {daily('arr')} SELECT * FROM daily", "date"),
        "history_sql_hourly": f"WITH {ARR}, {hourly('arr')} {HOUR_PROFILE} {PICKED} AND isodow(date) <= 5 GROUP BY hour",
        "billing_files": state("server"),
        "stream_state_resumed": state("server"),
        "stream_hourly_medians": text_date(f"WITH {ARR}, {hourly('arr')} SELECT * FROM hourly", "date"),
        "report_routes": f"WITH {ARR}, {daily('arr')}, {ROUTES} SELECT * FROM routes",
        "worst_stops_all": f"""{ALL_STATS}, {MEASURED} SELECT stop_id, n_matched, {half_up('on_time_share', 6)} AS on_time_share,
            CAST(row_number() OVER (ORDER BY on_time_share, stop_id) AS INTEGER) AS rank FROM measured WHERE NOT insufficient""",
        "consented_profiles": f"""WITH {BILLING}, given AS (SELECT user_id, arg_max(consent, (at_us, event_id)) AS given FROM ev
            WHERE kind IN ('completed', 'activated') GROUP BY user_id)
            SELECT CAST(c_custkey AS VARCHAR) AS id, coalesce(given, c_custkey % 2 = 0) AS marketing_consent
            FROM customer LEFT JOIN given ON user_id = CAST(c_custkey AS VARCHAR)""",
        "emptied_groups": """SELECT c_mktsegment AS cadastral, c_custkey AS owner_id FROM customer
            WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') OR (c_mktsegment = 'BUILDING' AND c_acctbal > 5000)""",
        "arrivals_archive": f"""WITH {ARR} SELECT CAST(service_date AS VARCHAR) AS service_date, stop_id AS stop, route_id AS route, direction AS dir,
            strftime(make_timestamp(CAST(ts_ms * 1000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%gZ') AS ts, delay_s AS delay FROM arr""",
        "stored_history": history("all", "all"),
        "stored_hourly": f"WITH {ARR}, {hourly('arr')} {HOUR_PROFILE} {PICKED} GROUP BY hour",
        "stored_weekly": f"""WITH {positions(3)}, {PAIRS}, {SPEEDS} SELECT iso_week, direction, bin_idx, band, {SPEED_STATS} FROM banded
            GROUP BY {WEEK_KEYS} HAVING count(*) >= 3""",
        "derive_job_daily": text_date(f"WITH {positions(3, True)}, {PAIRS}, {ARRIVALS}, {daily('arr')} SELECT * FROM daily", "date"),
        "derive_job_ledger": f"""WITH {positions(3, True)}, {PAIRS}, {ARRIVALS}, {SPEEDS}, week AS (SELECT count(*) AS n FROM banded
            GROUP BY {WEEK_KEYS} HAVING count(*) >= 3)
            SELECT (SELECT count(DISTINCT service_date) FROM samples) AS days, (SELECT count(*) FROM samples) AS samples, count(*) AS arrivals,
            count(delay_s) AS matched, (SELECT CAST(sum(n) AS BIGINT) FROM week) AS traversals FROM arr""",
        "exported_features": f"""{ALL_STATS} SELECT 'Feature' AS type, 'Point' AS shape, CAST(44.5 + CAST(substr(stop_id, 2) AS INTEGER) AS DOUBLE) AS lon, stop_id, n_obs
            FROM stats""",
        "exported_csv": f"{ALL_STATS} SELECT * FROM stats",
        "history_sql": f"""SELECT 'all' AS band, * FROM ({history('weekday', 'all')}) UNION ALL SELECT 'pm_peak', * FROM ({history('all', 'pm_peak')})
            UNION ALL (WITH {ARR} SELECT CAST(count(DISTINCT service_date) AS VARCHAR), CAST(min(service_date) AS VARCHAR), 0, 0, 0, 0, 0,
            NULL, NULL, NULL, NULL FROM arr)""",
        "stream_rate_limit": RATE,
        "stream_sample_pairs": text_date(f"WITH {positions(1)}, {PAIRS} SELECT {PAIR_COLUMNS} FROM pairs", "service_date"),
        "stream_hourly_counts": text_date(f"WITH {ARR}, {hourly('arr')} SELECT * EXCLUDE (delay_med_s) FROM hourly", "date"),
        "stream_subscription_state": state("server"),
        "snapshot_asof": f"""WITH {ARR}, days AS (SELECT DISTINCT service_date FROM arr),
            snaps AS (SELECT DISTINCT service_date AS s FROM arr WHERE day(service_date) % 5 = 0)
            SELECT CAST(service_date AS VARCHAR) AS service_date, CAST(max(s) AS VARCHAR) AS snapshot_date
            FROM days JOIN snaps ON s <= service_date GROUP BY service_date""",
        "pending_days": f"""WITH {ARR} SELECT DISTINCT CAST(service_date AS VARCHAR) AS service_date FROM arr
            WHERE day(service_date) % 3 <> 0 AND service_date < DATE '2024-01-25'""",
        "subscription_state": state("server"),
        "subscription_state_edge": state("edge"),
        "subscription_state_on_current": state("server", with_current=True),
        "marketing_consent": f"""WITH {BILLING} SELECT user_id, arg_max(consent, (at_us, event_id)) AS marketing_consent FROM ev
            WHERE kind IN ('completed', 'activated') GROUP BY user_id""",
        "trial_maintenance": f"""WITH {CUSTOMERS} SELECT user_id, CASE WHEN ({EXPIRES}) OR coalesce({FINISHES}, false) THEN 'free' ELSE plan END AS plan,
            CASE WHEN {EXPIRES} THEN 'expired' WHEN {FINISHES} THEN 'canceled' ELSE status END AS status,
            CASE WHEN {EXPIRES} THEN false ELSE trial_active END AS trial_active, trial_ends // 1000 AS trial_ends_ms FROM cust""",
        "maintenance_counts": f"""WITH {CUSTOMERS}, a AS (SELECT CASE WHEN {EXPIRES} THEN 'expired' WHEN {FINISHES} THEN 'finalized'
            WHEN status = 'trialing' THEN {REMINDER} END AS action FROM cust)
            SELECT action, count(*) AS rows_touched FROM a WHERE action IS NOT NULL GROUP BY action""",
        "trial_reminders": f"""WITH {CUSTOMERS} SELECT user_id, email, {REMINDER} AS reminder, trial_ends // 1000 AS trial_ends_ms FROM cust
            WHERE status = 'trialing' AND email IS NOT NULL AND {REMINDER} IS NOT NULL""",
        "cancellation_policy": cancellation("server"),
        "cancellation_policy_edge": cancellation("edge"),
        "account_view": f"""WITH {CUSTOMERS} SELECT user_id, email, CASE WHEN key % 5 <> 0 THEN c_name ELSE '' END AS name,
            CASE WHEN key % 6 <> 0 THEN 'a/' || key END AS avatar_url,
            CASE WHEN status = 'canceled' THEN 'free' ELSE plan END AS plan, CASE WHEN status = 'canceled' THEN 'free' ELSE status END AS status,
            CASE WHEN status = 'canceled' THEN 'month' ELSE itv END AS billing_interval,
            CASE WHEN status <> 'canceled' THEN ends // 1000 END AS period_end_ms FROM cust""",
        "visible_rows": f"""WITH {CUSTOMERS}, u AS ({OWNED}) SELECT * FROM u WHERE user_id = '7'
            OR coalesce((SELECT max(is_admin) FROM cust WHERE user_id = '7'), false)""",
        "visible_rows_admin": f"""WITH {CUSTOMERS}, u AS ({OWNED}) SELECT * FROM u WHERE user_id = '11'
            OR coalesce((SELECT max(is_admin) FROM cust WHERE user_id = '11'), false)""",
        "entitled_rows": f"""WITH {CUSTOMERS}, u AS ({OWNED}) SELECT * FROM u WHERE EXISTS (SELECT 1 FROM cust
            WHERE cust.user_id = '6' AND plan = 'pro' AND cust.status IN ('active', 'trialing', 'canceling'))""",
        "entitled_rows_denied": f"""WITH {CUSTOMERS}, u AS ({OWNED}) SELECT * FROM u WHERE EXISTS (SELECT 1 FROM cust
            WHERE cust.user_id = '8' AND plan = 'pro' AND cust.status IN ('active', 'trialing', 'canceling'))""",
        "entitled_users": f"WITH {CUSTOMERS} SELECT user_id FROM cust WHERE plan = 'pro' AND status IN ('active', 'trialing', 'canceling')",
        "checked_writes": f"""WITH {CUSTOMERS} SELECT user_id AS id, CASE WHEN key % 5 <> 0 THEN c_name END AS full_name, is_admin,
            user_id = '7' AS accepted FROM cust""",
        "deletion_requests": f"""WITH u AS ({OWNED}) SELECT id, user_id, CASE WHEN status = 'F' THEN 'completed' ELSE status END AS status,
            CASE WHEN status = 'F' THEN {AS_OF_US // 1000} END AS completed_ms FROM u""",
        "purged_users": f"WITH u AS ({OWNED}) SELECT * FROM u WHERE CAST(user_id AS BIGINT) % 7 <> 0",
        "merge_records": """WITH inc AS (SELECT o_custkey + 50 AS cadastral, o_orderkey AS seq, o_orderpriority AS zone,
              CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS area FROM orders),
            latest AS (SELECT cadastral, arg_max({'v': area}, seq) AS a, arg_max({'v': zone}, seq) FILTER (WHERE seq % 2 = 0) AS z
              FROM inc GROUP BY cadastral),
            old AS (SELECT c_custkey AS cadastral, c_name AS owner, c_acctbal AS area, c_mktsegment AS zone FROM customer)
            SELECT cadastral, owner, CASE WHEN a IS NOT NULL THEN a.v ELSE area END AS area,
              CASE WHEN z IS NOT NULL THEN z.v ELSE zone END AS zone FROM old FULL JOIN latest USING (cadastral)""",
        "replace_groups": """SELECT o_custkey AS cadastral, o_orderkey AS owner_id, o_orderstatus AS owner_type FROM orders
            WHERE o_custkey NOT IN (SELECT l_suppkey FROM lineitem)
            UNION ALL SELECT l_suppkey, l_orderkey, l_returnflag FROM lineitem""",
        "owner_batches": """WITH b AS (SELECT *, 1 + (conv_id * 7 + turn * 13) % 120 AS n FROM conversations)
            SELECT conv_id || '-' || turn AS batch_id, CAST(n AS INTEGER) AS n_rows,
            n <= 100 AND turn % 5 <> 4 AND length(text) % 11 <> 0 AS accepted FROM b""",
        "parcel_checks": """WITH b AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN replace(props, '{', '{"cadastral": "c", ')
              WHEN 1 THEN replace(props, '"k"', '"cadastral"') ELSE '[' || props || ']' END AS body FROM events)
            SELECT event_id, regexp_matches(body, '^[{].*"cadastral": "') AS accepted FROM b""",
        "page_text": f"SELECT page_id, regexp_replace({pages_text}, '^{SPACE}+|{SPACE}+$', '', 'g') AS plain FROM pages",
        "page_items": f"""WITH found AS (SELECT page_id, regexp_extract_all(html, '(?i)<li>([^\\n\\r\\x{{2028}}\\x{{2029}}]*?)</li>', 1) AS raw FROM pages),
            cleaned AS (SELECT page_id, list_filter(list_transform(raw, lambda s: regexp_replace(regexp_replace(s, '<[^>]+>', '', 'g'),
              '^{SPACE}+|{SPACE}+$', '', 'g')), lambda s: s <> '') AS items FROM found)
            SELECT page_id, CAST(len(items) AS INTEGER) AS items, coalesce(array_to_string(items, ' | '), '') AS joined FROM cleaned""",
        "code_extract": f"""WITH body AS (SELECT page_id, {_code('page_id % 97', 'page_id % 13', 'page_id % 7', 'page_id % 501', 'page_id % 333')} AS c,
              {_code('page_id % 89', 'page_id % 17', 'page_id % 5', 'page_id % 401', 'page_id % 777')} AS o, html FROM pages),
            found AS (SELECT page_id, regexp_extract_all(c || ' ' || html || ' ' || o || ' ' || c,
              '[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{3}}[.][0-9]{{3}}') AS l FROM body)
            SELECT page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS codes FROM found""",
        "permit_decisions": decisions,
        "document_files": decisions,
        "permit_details": f"""WITH b AS (SELECT page_id, replace(CASE WHEN page_id % 4 = 3 THEN regexp_replace(html, '(?i)</?li>', '', 'g') ELSE html END,
              chr(10), ' ') AS markup, {_code('page_id % 97', 'page_id % 13', 'page_id % 7', 'page_id % 501', 'page_id % 333')} AS code FROM pages),
            f AS (SELECT *, list_filter(list_transform(regexp_extract_all(markup, '(?i)<li>([^\\n\\r\\x{{2028}}\\x{{2029}}]*?)</li>', 1),
              lambda s: regexp_replace(regexp_replace(s, '<[^>]+>', '', 'g'), '^{SPACE}+|{SPACE}+$', '', 'g')), lambda s: s <> '') AS items FROM b)
            SELECT CAST(page_id AS VARCHAR) AS doc_id, CASE WHEN len(items) > 0 THEN array_to_string(items, ' | ') ELSE
              regexp_replace(regexp_replace(regexp_replace(markup, '<[^>]+>', ' ', 'g'), '{SPACE}+', ' ', 'g'), '^{SPACE}+|{SPACE}+$', '', 'g') END AS nomenclature,
            code AS cadastral FROM f""",
        "rate_limit_audit": RATE,
        "monthly_activity": f"WITH {USES} SELECT * FROM activity",
        "quota_status": f"""WITH {USES}, {CUSTOMERS}, used AS (SELECT user_id, month, CAST(sum(uses) AS BIGINT) AS used FROM activity GROUP BY ALL),
            q AS (SELECT used.*, CAST(CASE WHEN key % 4 = 1 THEN key % 60 + 20 WHEN status = 'trialing' THEN 300 WHEN plan = 'pro' THEN 1000
              ELSE 50 END AS BIGINT) AS monthly_limit FROM used LEFT JOIN cust USING (user_id))
            SELECT *, greatest(monthly_limit - used, 0) AS remaining, used >= monthly_limit * 0.9 AS warn, used >= monthly_limit AS exceeded FROM q""",
        "diversity_index": f"""WITH a AS (SELECT user_id AS site_id,
              ['food', 'health', 'parks', 'retail', 'culture', 'office'][(CAST(floor(value) AS BIGINT) + length(event_type)) % 6 + 1] AS c FROM events),
            n AS (SELECT site_id, c, count(*) AS k FROM a WHERE c <> 'office' GROUP BY ALL),
            p AS (SELECT *, k::DOUBLE / sum(k) OVER (PARTITION BY site_id) AS p FROM n)
            SELECT site_id, CAST(sum(k) AS BIGINT) AS amenities, count(*) AS categories, {half_up('-sum(p * ln(p))', 6)} AS shannon FROM p GROUP BY site_id""",
        "relief_summary": f"""WITH {CELLS} SELECT area_id, count(*) AS cells, min(height) AS height_min, max(height) AS height_max,
            {half_up('avg(height)', 4)} AS height_mean,
            {half_up('avg(CASE WHEN aspect BETWEEN 135 AND 225 AND slope <= 30 THEN 1 ELSE 0 END)', 6)} AS solar_share FROM cells GROUP BY area_id""",
        "relief_classes": f"""WITH {CELLS} SELECT area_id, CASE WHEN slope < 3 THEN 'flat' WHEN slope < 8 THEN 'gentle' WHEN slope < 15 THEN 'moderate'
            WHEN slope < 30 THEN 'steep' ELSE 'very_steep' END AS slope_class,
            ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor(((aspect + 22.5) % 360) / 45) AS BIGINT) + 1] AS aspect_sector,
            count(*) AS cells FROM cells GROUP BY ALL""",
        "tile_boxes": f"""WITH t AS (SELECT CAST(p_partkey % 19 AS INTEGER) AS z, pow(2::DOUBLE, p_partkey % 19) AS n, p_partkey FROM part),
            k AS (SELECT z, n, p_partkey * 7919 % CAST(n AS BIGINT) AS x, p_partkey * 104729 % CAST(n AS BIGINT) AS y FROM t)
            SELECT z, x, y, {half_up(f'(x / n * 2 * pi() - pi()) * {_MERC}', 3)} AS west, {half_up(_lat_m('y + 1'), 3)} AS south,
            {half_up(f'((x + 1) / n * 2 * pi() - pi()) * {_MERC}', 3)} AS east, {half_up(_lat_m('y'), 3)} AS north FROM k""",
        "service_hours": """WITH l AS (SELECT ts + INTERVAL 4 HOUR AS t FROM events)
            SELECT strftime(t, '%Y-%m-%d') AS folder, strftime(t, '%H%M') AS stem,
            CASE WHEN hour(t) BETWEEN 7 AND 9 THEN 'am_peak' WHEN hour(t) BETWEEN 10 AND 16 THEN 'midday' WHEN hour(t) BETWEEN 17 AND 19 THEN 'pm_peak'
              ELSE 'evening' END AS band, strftime(t, '%G-W%V') AS iso_week, count(*) AS n
            FROM l WHERE hour(t) >= 6 OR hour(t) < 1 GROUP BY ALL""",
    }
