"""Event and request metrics over whole event tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from pagegrid.functions import labels
from pagegrid.functions.urls import host_key
from pagegrid.operators import metrics, ratelimit, runs
from pagegrid.plans.registry import query
from pagegrid.plans.tables import NOW
from pagegrid.queries import sqltext as s
from pagegrid.queries.scalars import _FAMILY, _taxonomy_sql

c = F.col
_SUM = f"""count(*) AS requests_total, count(*) FILTER (WHERE status_code BETWEEN 200 AND 399) AS status_2xx, count(*) FILTER (WHERE status_code BETWEEN 400 AND 499) AS status_4xx,
  count(*) FILTER (WHERE status_code >= 500) AS status_5xx, {s.pct('count(*) FILTER (WHERE status_code >= 500)', 'count(*)')} AS error_rate_percent"""


def _mean2(expr: str) -> str:
    return s.round2(f"CAST(sum(CAST({expr} AS DECIMAL(18,4))) AS DOUBLE) / count(*)")


def _p95(expr: str) -> str:
    return s.round2(f"quantile_disc({expr}, 0.95)")


@query("a07_window_summary", f"SELECT time_bucket(INTERVAL 60 MINUTES, ts) AS window_start, {_SUM} FROM v_requests GROUP BY 1")
def _(t):
    w = metrics.request_summary(t.v_requests, [F.window("ts", "60 minutes").alias("w")])
    return w.select(c("w.start").alias("window_start"), "requests_total", "status_2xx", "status_4xx", "status_5xx", "error_rate_percent")


@query(
    "a08_family_summary",
    f"""SELECT {_FAMILY} AS family, count(*) AS requests, count(*) FILTER (WHERE status_code >= 400) AS failures, {s.pct('count(*) FILTER (WHERE status_code >= 400)', 'count(*)')} AS failure_rate_percent,
      {_mean2('duration_ms')} AS avg_duration_ms, {_p95('duration_ms')} AS p95_duration_ms FROM v_requests GROUP BY 1""",
)
def _(t):
    return metrics.family_summary(t.v_requests)


@query("a09_nearest_rank", f"SELECT user_id, event_type, {_p95('value')} AS p95 FROM events GROUP BY 1, 2")
def _(t):
    return metrics.nearest_rank(t.events, ["user_id", "event_type"], "value", 0.95, "p95")


@query(
    "a10_running_totals",
    """SELECT count(*) AS requests, count(*) FILTER (WHERE status_code BETWEEN 200 AND 299) AS status_2xx, count(*) FILTER (WHERE status_code BETWEEN 400 AND 499) AS status_4xx, count(*) FILTER (WHERE status_code >= 500) AS status_5xx,
      count(*) FILTER (WHERE status_code >= 400 AND starts_with(path, '/api/auth/')) AS auth_failures, count(*) FILTER (WHERE status_code >= 400 AND starts_with(path, '/api/license/')) AS license_failures,
      count(*) FILTER (WHERE status_code >= 400 AND starts_with(path, '/api/devices')) AS device_failures FROM v_requests""",
)
def _(t):
    return metrics.running_totals(t.v_requests)


@query("a11_top_routes", f'SELECT method, path, count(*) AS "count", count(*) FILTER (WHERE status_code >= 400) AS error_count, {_mean2("duration_ms")} AS avg_duration_ms FROM v_requests GROUP BY 1, 2 ORDER BY 3 DESC, 2, 1 LIMIT 25')
def _(t):
    return metrics.top_routes(t.v_requests)


_LEVELS = f"""SELECT 'availability_percent' AS name, count(*) AS samples, {s.pct('count(*) FILTER (WHERE status_code BETWEEN 200 AND 399)', 'count(*)', 4)} AS value, CAST(99.5 AS DOUBLE) AS target FROM v_requests WHERE path = '/healthz'
  UNION ALL SELECT 'auth_p95_ms', count(*), {_p95('duration_ms')}, 400 FROM v_requests WHERE path IN ('/api/auth/login', '/api/auth/refresh')
  UNION ALL SELECT 'license_p95_ms', count(*), {_p95('duration_ms')}, 350 FROM v_requests WHERE path IN ('/api/license/status', '/api/devices/validate-devices')"""


@query("a12_service_levels", _LEVELS)
def _(t):
    return metrics.service_levels(t.v_requests)


_RULES = ", ".join(f"('{n}', {m}, {b}, '{side}')" for n, m, b, side in metrics.SLO_RULES)


@query(
    "a13_service_breaches",
    f"""WITH l AS ({_LEVELS}), a AS (SELECT name, samples, value FROM l UNION ALL SELECT 'window_5xx_percent', count(*), {s.pct('count(*) FILTER (WHERE status_code >= 500)', 'count(*)')} FROM v_requests
        UNION ALL SELECT {_FAMILY} || '_failure_percent', count(*), {s.pct('count(*) FILTER (WHERE status_code >= 400)', 'count(*)')} FROM v_requests GROUP BY {_FAMILY}),
      r(name, min_samples, bound, side) AS (VALUES {_RULES})
      SELECT a.name, samples, value, CAST(bound AS DOUBLE) AS bound FROM a JOIN r ON r.name = a.name WHERE samples >= min_samples AND CASE WHEN side = 'below' THEN value < bound ELSE value > bound END""",
)
def _(t):
    return metrics.service_breaches(t.v_requests)


_TOOL = "CASE event_id % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'pages' ELSE 'metadata' END"


@query(
    "a16_event_summary",
    f"""WITH e AS (SELECT event_type, {_taxonomy_sql(1)} AS severity, {_TOOL} AS tool FROM v_lifecycle)
      SELECT event_type, severity, tool, count(*) AS n FROM e GROUP BY GROUPING SETS ((event_type), (severity), (tool), ())""",
)
def _(t):
    return runs.event_summary(t.v_lifecycle.selectExpr("event_type", f"{_TOOL} AS tool"))


_ERR = "SELECT event_id, ts, path FROM v_requests WHERE status_code >= 400"


@query("a18_error_summary", f"SELECT path AS event, count(*) AS n FROM ({_ERR}) GROUP BY 1")
def _(t):
    e = runs.recent_errors(t.v_requests.filter("status_code >= 400"), [c("ts").desc(), c("event_id").desc()])
    return e.groupBy(c("path").alias("event")).agg(F.count(F.lit(1)).alias("n"))


_ART = """SELECT automation_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'automation.started') AS started, count(*) FILTER (WHERE event_type = 'automation.progress') AS progress_count,
  coalesce(max(greatest(0, least(100, progress))) FILTER (WHERE event_type = 'automation.progress'), 0) AS progress_max, arg_max(greatest(0, least(100, progress)), event_id) FILTER (WHERE event_type = 'automation.progress') AS progress_last,
  coalesce(arg_max(CASE event_type WHEN 'automation.stop_requested' THEN 'stopping' WHEN 'automation.completed' THEN 'completed' WHEN 'automation.failed' THEN 'error' END, event_id) FILTER (WHERE event_type IN ('automation.stop_requested', 'automation.completed', 'automation.failed')), 'running') AS status,
  arg_max(event_type, event_id) FILTER (WHERE event_type IN ('automation.completed', 'automation.failed')) AS terminal_event, max(emitted_at) AS updated_at FROM v_lifecycle GROUP BY 1"""


@query(
    "a19_run_artifacts",
    f"""WITH a AS ({_ART}), p AS (SELECT automation_id, event_id, greatest(0, least(100, progress)) AS v, row_number() OVER (PARTITION BY automation_id ORDER BY emitted_at DESC, event_id DESC) AS rn FROM v_lifecycle WHERE event_type = 'automation.progress'),
      l AS (SELECT automation_id, string_agg(CAST(CAST(v AS INT) AS VARCHAR), ',' ORDER BY event_id) AS samples FROM p WHERE rn <= 120 GROUP BY 1)
      SELECT a.*, l.samples FROM a LEFT JOIN l ON l.automation_id = a.automation_id""",
)
def _(t):
    a = runs.run_artifacts(t.v_lifecycle)
    return a.withColumn("samples", F.array_join(F.transform("samples", lambda x: x.cast("int").cast("string")), ","))


@query(
    "a20_status_counts",
    f"""WITH a AS ({_ART}) SELECT count(*) AS total, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'stopped') AS stopped,
      count(*) FILTER (WHERE status = 'error') AS error, count(*) FILTER (WHERE status NOT IN ('running', 'completed', 'stopped', 'error')) AS other, (SELECT automation_id FROM a ORDER BY updated_at DESC, automation_id DESC LIMIT 1) AS latest_run,
      (SELECT automation_id FROM a WHERE status = 'error' ORDER BY updated_at DESC, automation_id DESC LIMIT 1) AS latest_failure FROM a""",
)
def _(t):
    return runs.status_counts(runs.run_artifacts(t.v_lifecycle))


_LIMITED = """WITH RECURSIVE e AS (SELECT event_id, client_id, ts, (epoch_us(ts) // 1000) AS tm FROM v_requests),
  w AS (SELECT client_id, min(tm) AS start FROM e GROUP BY 1 UNION ALL SELECT w.client_id, (SELECT min(e.tm) FROM e WHERE e.client_id = w.client_id AND e.tm >= w.start + 7200000) FROM w WHERE w.start IS NOT NULL),
  p AS (SELECT e.*, (SELECT max(w.start) FROM w WHERE w.client_id = e.client_id AND w.start <= e.tm) AS start FROM e),
  n AS (SELECT *, row_number() OVER (PARTITION BY client_id, start ORDER BY tm, event_id) AS request_no FROM p)"""


@query(
    "w07_rate_limit",
    f"""{_LIMITED} SELECT event_id, client_id, request_no, greatest(0, 2 - request_no) AS remaining, CAST(ceil((start + 7200000) / 1000.0) AS BIGINT) AS reset_s, request_no > 2 AS limited,
      CASE WHEN request_no > 2 THEN greatest(1, CAST(ceil((start + 7200000 - tm) / 1000.0) AS BIGINT)) END AS retry_after_s FROM n""",
)
def _(t):
    return ratelimit.fixed_window_limit(t.v_requests, "client_id", "ts", "event_id", 7_200_000, 2).select(
        "event_id", "client_id", "request_no", "remaining", "reset_s", "limited", "retry_after_s"
    )


@query(
    "a22_limiter_stats",
    f"""{_LIMITED} SELECT CASE event_id % 2 WHEN 0 THEN 'read' ELSE 'write' END AS scope, count(*) AS requests, count(*) FILTER (WHERE request_no > 2) AS limited_requests, {s.pct('count(*) FILTER (WHERE request_no > 2)', 'count(*)')} AS limited_percent, max(ts) AS last_seen_at FROM n GROUP BY 1""",
)
def _(t):
    lim = ratelimit.fixed_window_limit(t.v_requests, "client_id", "ts", "event_id", 7_200_000, 2)
    return ratelimit.limiter_stats(lim.selectExpr("CASE event_id % 2 WHEN 0 THEN 'read' ELSE 'write' END AS scope", "limited", "ts"), "scope", "ts")


@query("a24_usage_counters", 'SELECT user_id AS account_id, event_type AS metric, CAST(ts AS DATE) AS period_start, count(*) AS "count" FROM events GROUP BY 1, 2, 3')
def _(t):
    return metrics.usage_counters(t.events, "user_id", "event_type", "ts")


@query(
    "a25_spend_projection",
    f"""WITH m AS (SELECT CAST(coalesce(sum(usd), 0) AS DOUBLE) AS mtd FROM v_spend WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-20'),
      p AS (SELECT {s.round2('mtd', 4)} AS month_to_date_usd, {s.round2('mtd / 20 * 31', 4)} AS projected_usd, {s.round2('mtd / 9000 * 100')} AS usage_percent, {s.round2('mtd / 20 * 31 / 9000 * 100')} AS projected_percent FROM m)
      SELECT *, usage_percent >= 100 AS usage_over_cap, projected_percent >= 100 AS projected_over_cap, usage_percent >= 80 AS usage_over_alert, projected_percent >= 80 AS projected_over_alert FROM p""",
)
def _(t):
    return metrics.spend_projection(t.v_spend, "2024-01-20", budget=9000.0)


@query(
    "w05_daily_anomaly",
    f"""WITH d AS (SELECT day, CAST(usd AS DOUBLE) AS usd, count(*) OVER w AS n, avg(CAST(usd AS DOUBLE)) OVER w AS mean, stddev_samp(CAST(usd AS DOUBLE)) OVER w AS sigma FROM v_spend WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT day, {s.round2('usd')} AS usd, CASE WHEN n < 3 THEN 'not_enough_samples' END AS reason, CASE WHEN n >= 3 THEN {s.round2('(usd - mean) / nullif(sigma, 0)')} END AS z_score,
        CASE WHEN n < 3 THEN false WHEN sigma = 0 THEN usd > mean * 1.5 AND usd > 0 ELSE coalesce((usd - mean) / sigma >= 2.5, false) END AS is_anomaly FROM d""",
)
def _(t):
    return metrics.daily_anomaly(t.v_spend)


@query(
    "w11_running_progress",
    """SELECT event_id, automation_id, max(CASE WHEN event_type = 'automation.progress' THEN greatest(0, least(100, progress)) ELSE 0 END) OVER (PARTITION BY automation_id ORDER BY emitted_at, event_id ROWS UNBOUNDED PRECEDING) AS progress_max FROM v_lifecycle""",
)
def _(t):
    return runs.running_progress(t.v_lifecycle)


_STATE = "CASE event_type WHEN 'automation.started' THEN 'running' WHEN 'automation.stop_requested' THEN 'stopping' WHEN 'automation.completed' THEN 'completed' WHEN 'automation.failed' THEN 'error' ELSE 'idle' END"
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, _t, b in runs.TRANSITIONS)


@query(
    "w12_lifecycle_check",
    f"""WITH x AS (SELECT event_id, automation_id, emitted_at, {_STATE} AS state FROM v_lifecycle), l AS (SELECT event_id, automation_id, state, coalesce(lag(state) OVER (PARTITION BY automation_id ORDER BY emitted_at, event_id), 'idle') AS previous FROM x)
      SELECT event_id, automation_id, previous, state, (previous, state) IN ({_PAIRS}) AS legal FROM l""",
)
def _(t):
    return runs.check_transitions(t.v_lifecycle.selectExpr("event_id", "automation_id", "emitted_at", f"{_STATE} AS state"))


@query(
    "t09_bounded_tails",
    "SELECT event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 500",
)
def _(t):
    return metrics.tail_per_key(t.events.select("event_id", "event_type", "ts"), ["event_type"], [c("ts").desc(), c("event_id").desc()], 500)


@query(
    "d07_latest_hints",
    f"""WITH h AS (SELECT 'shop' || (user_id % 40) || '.example.com' AS host, CASE event_type WHEN 'view' THEN 'list_autodetect_autopilot' WHEN 'click' THEN 'point_follow_guided' ELSE 'other' END AS strategy, 'seen ' || (event_id % 3) AS reason, ts FROM events),
      v AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts DESC, strategy, reason) AS rn FROM h WHERE strategy <> 'other' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAYS)
      SELECT a.host, a.strategy, a.reason, a.ts AS updated_at, b.host IS NULL OR a.strategy <> b.strategy OR a.reason <> b.reason AS changed FROM v a LEFT JOIN v b ON b.host = a.host AND b.rn = 2 WHERE a.rn = 1""",
)
def _(t):
    e = t.events.select(
        host_key(F.concat(F.lit("https://WWW.shop"), c("user_id") % 40, F.lit(".example.com/list"))).alias("host"),
        F.when(c("event_type") == "view", "list_autodetect_autopilot").when(c("event_type") == "click", "point_follow_guided").otherwise("other").alias("strategy"),
        F.concat(F.lit("seen "), c("event_id") % 3).alias("reason"), c("ts").cast("timestamp").alias("updated_at"),
    )
    return runs.latest_hints(e, F.lit(NOW).cast("timestamp"))


@query(
    "s17_audit_events",
    """SELECT event_id AS id, automation_id AS account_id, event_type, '{"progress":' || CAST(CAST(progress AS INT) AS VARCHAR) || ',"source":"run"}' AS event_data FROM v_lifecycle""",
)
def _(t):
    from pagegrid.sources.records import audit_rows

    e = t.v_lifecycle.select("event_id", "automation_id", "event_type", c("progress").cast("int").alias("progress"), F.lit("run").alias("source"))
    return audit_rows(e, id_="event_id", account="automation_id", user=None, event_type=c("event_type"), data=["progress", "source"]).drop("user_id")


@query("s15_exposition", f"""WITH f AS (SELECT {_FAMILY} AS family, {s.pct('count(*) FILTER (WHERE status_code >= 400)', 'count(*)')} AS rate, {_p95('duration_ms')} AS p95 FROM v_requests GROUP BY 1),
  k AS (SELECT count(*) AS n, count(*) FILTER (WHERE status_code BETWEEN 200 AND 299) AS a2, count(*) FILTER (WHERE status_code BETWEEN 200 AND 399) AS b2, count(*) FILTER (WHERE status_code BETWEEN 400 AND 499) AS a4, count(*) FILTER (WHERE status_code >= 500) AS a5, {s.pct('count(*) FILTER (WHERE status_code >= 500)', 'count(*)')} AS er,
    count(*) FILTER (WHERE status_code >= 400 AND starts_with(path, '/api/auth/')) AS af, count(*) FILTER (WHERE status_code >= 400 AND starts_with(path, '/api/license/')) AS lf, count(*) FILTER (WHERE status_code >= 400 AND starts_with(path, '/api/devices')) AS df FROM v_requests),
  l AS ({_LEVELS}), o AS (
  SELECT 'control_api_requests_total ' || n AS line FROM k UNION ALL SELECT 'control_api_requests_total{{status_class="2xx"}} ' || a2 FROM k UNION ALL SELECT 'control_api_requests_total{{status_class="4xx"}} ' || a4 FROM k UNION ALL SELECT 'control_api_requests_total{{status_class="5xx"}} ' || a5 FROM k
  UNION ALL SELECT 'control_api_failures_total{{family="auth"}} ' || af FROM k UNION ALL SELECT 'control_api_failures_total{{family="license"}} ' || lf FROM k UNION ALL SELECT 'control_api_failures_total{{family="devices"}} ' || df FROM k
  UNION ALL SELECT 'control_api_window_requests_total ' || n FROM k UNION ALL SELECT 'control_api_window_requests_total{{status_class="2xx"}} ' || b2 FROM k UNION ALL SELECT 'control_api_window_requests_total{{status_class="4xx"}} ' || a4 FROM k UNION ALL SELECT 'control_api_window_requests_total{{status_class="5xx"}} ' || a5 FROM k
  UNION ALL SELECT 'control_api_window_error_rate_percent ' || coalesce(regexp_replace(CAST(er AS VARCHAR), '\\.0$', ''), 'NaN') FROM k
  UNION ALL SELECT 'control_api_window_family_failure_rate_percent{{family="' || family || '"}} ' || coalesce(regexp_replace(CAST(rate AS VARCHAR), '\\.0$', ''), 'NaN') FROM f
  UNION ALL SELECT 'control_api_window_family_p95_ms{{family="' || family || '"}} ' || coalesce(regexp_replace(CAST(p95 AS VARCHAR), '\\.0$', ''), 'NaN') FROM f
  UNION ALL SELECT 'control_api_slo_value{{name="' || CASE name WHEN 'availability_percent' THEN 'healthz_availability_percent' ELSE name END || '"}} ' || coalesce(regexp_replace(CAST(value AS VARCHAR), '\\.0$', ''), 'NaN') FROM l)
  SELECT line FROM o""")
def _(t):
    return metrics.exposition(t.v_requests).filter(~c("line").startswith("#")).select("line")
