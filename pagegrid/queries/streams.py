"""Streaming jobs over the event tables, each checked against its batch meaning.

A window or timeout fires once the watermark (newest event minus lateness) passes it, so the
oracle keeps the windows that end by then.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from pagegrid.operators import monitor as mon
from pagegrid.operators import rows
from pagegrid.plans.lineage import scratch_path
from pagegrid.plans.registry import query
from pagegrid.plans.tables import VIEWS
from pagegrid.queries import sqltext as s
from pagegrid.queries.monitor import _HIST
from pagegrid.queries.rows import STORE
from pagegrid.streaming import append, memory, stateful, windows
from pagegrid.streaming.run import file_stream, settle

c = F.col
_MARK = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTES"


def _view(t, name, source="events"):
    return t.spark.sql(VIEWS[name], **{source: file_stream(t.spark, t.sf_dir, source)})


@query(
    "st1_sliding_requests",
    f"""WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTES, ts) - to_minutes(5 * k) AS window_start, status_code, duration_ms FROM v_requests, (SELECT unnest(range(0, 12)) AS k))
      SELECT window_start, count(*) AS requests_total, count(*) FILTER (WHERE status_code BETWEEN 200 AND 399) AS status_2xx, count(*) FILTER (WHERE status_code BETWEEN 400 AND 499) AS status_4xx, count(*) FILTER (WHERE status_code >= 500) AS status_5xx,
        {s.pct('count(*) FILTER (WHERE status_code >= 500)', 'count(*)')} AS error_rate_percent, quantile_disc(duration_ms, 0.95) AS p95 FROM w GROUP BY 1 HAVING window_start + INTERVAL 60 MINUTES <= {_MARK}""",
)
def _(t):
    # a window here holds fewer samples than the accuracy of the percentile, so it is the nearest rank
    return settle(windows.sliding_requests(_view(t, "v_requests")), "st1").withColumnRenamed("p95_approx", "p95")


@query("st2_unseen_entities", "SELECT scope, key, count(*) AS n FROM (SELECT DISTINCT event_type AS scope, 'u' || user_id AS key FROM events WHERE user_id > 2 UNION ALL SELECT event_type, '' FROM events WHERE user_id <= 2) GROUP BY 1, 2")
def _(t):
    e = file_stream(t.spark, t.sf_dir, "events").select("ts", c("event_type").alias("scope"), F.when(c("user_id") > 2, F.concat(F.lit("u"), "user_id")).otherwise("").alias("key"))
    return settle(windows.unseen_entities(e, "scope", "key", "ts"), "st2").groupBy("scope", "key").agg(F.count(F.lit(1)).alias("n"))


_RUNS = "SELECT event_id, event_type AS scope, CASE WHEN user_id > 2 THEN 'u' || user_id ELSE '' END AS key, (day(ts) - 1) // 8 AS run FROM events"


#: four runs over arriving files, with a memory of the newest 100 entities of a scope
@query(
    "st2_seen_memory",
    f"""WITH RECURSIVE e AS ({_RUNS}), f AS (SELECT scope, run, key, min(event_id) AS first_at FROM e WHERE key <> '' GROUP BY ALL), k AS (SELECT scope, run, list(key ORDER BY first_at) AS keys FROM f GROUP BY 1, 2),
      n AS (SELECT scope, run, count(*) AS n, count(*) FILTER (WHERE key = '') AS blank FROM e GROUP BY 1, 2),
      m AS (SELECT scope, -1 AS run, CAST([] AS VARCHAR[]) AS mem, CAST(0 AS BIGINT) AS fresh FROM (SELECT DISTINCT scope FROM e)
        UNION ALL SELECT scope, run, mem[greatest(1, len(mem) - 99):], fresh FROM (
          SELECT m.scope, m.run + 1 AS run, list_concat(m.mem, list_filter(coalesce(k.keys, []), lambda x: NOT list_contains(m.mem, x))) AS mem, CAST(len(list_filter(coalesce(k.keys, []), lambda x: NOT list_contains(m.mem, x))) AS BIGINT) AS fresh
          FROM m LEFT JOIN k ON k.scope = m.scope AND k.run = m.run + 1 WHERE m.run < 3))
      SELECT CAST(run AS INT) AS run, scope, fresh + blank AS accepted, n - fresh - blank AS skipped FROM m JOIN n USING (scope, run)""",
)
def _(t):
    key = F.when(c("user_id") > 2, F.concat(F.lit("u"), "user_id")).otherwise("")
    e = t.events.select("event_id", c("event_type").alias("scope"), key.alias("key"), F.expr("(dayofmonth(ts) - 1) div 8").alias("run"))
    arriving, base = scratch_path(t.spark, "arriving"), scratch_path(t.spark, "memory")
    for run in range(4):
        e.filter(c("run") == run).drop("run").write.mode("append").parquet(arriving)
        memory.seen_memory(t.spark.readStream.schema("event_id long, scope string, key string").parquet(arriving), base, "scope", "key", "event_id", limit=100)
    counters = t.spark.read.schema("scope string, accepted long, skipped long, batch_id int").parquet(f"{base}/counters")
    return counters.select(c("batch_id").alias("run"), "scope", "accepted", "skipped")


@query("st3_monitor_runs", f"{_HIST} SELECT run_id, account_id, monitor_key, first_run, changed, row_number() OVER w AS run_count, CAST(sum(CAST(changed AS INT)) OVER w AS BIGINT) AS change_count FROM f WINDOW w AS (PARTITION BY account_id, monitor_key ORDER BY run_at, run_id ROWS UNBOUNDED PRECEDING)")
def _(t):
    v = _view(t, "v_monitor")
    runs = v.select("account_id", "monitor_key", "run_at", "run_id", mon.snapshot_hash(mon.snapshot_json(v)).alias("snapshot_hash"))
    return settle(stateful.monitor_runs(runs), "st3")


_CHAIN = """WITH RECURSIVE e AS (SELECT event_id, {key} AS k, (epoch_us(ts) // 1000) AS tm, {extra} AS x FROM events),
  w AS (SELECT k, min(tm) AS start FROM e GROUP BY 1 UNION ALL SELECT w.k, (SELECT min(e.tm) FROM e WHERE e.k = w.k AND e.tm >= w.start + {length}) FROM w WHERE w.start IS NOT NULL),
  p AS (SELECT e.*, (SELECT max(w.start) FROM w WHERE w.k = e.k AND w.start <= e.tm) AS start FROM e),
  n AS (SELECT *, row_number() OVER (PARTITION BY k, start ORDER BY tm, event_id) AS rn FROM p)"""


@query(
    "st4_idempotent_requests",
    _CHAIN.format(key="user_id", extra="event_type", length=86_400_000) + " SELECT n.event_id AS request_id, CASE WHEN n.rn = 1 THEN 'first' WHEN n.x = f.x THEN 'replay' ELSE 'conflict' END AS label FROM n JOIN n f ON f.k = n.k AND f.start = n.start AND f.rn = 1",
)
def _(t):
    e = file_stream(t.spark, t.sf_dir, "events").select(c("event_id").alias("request_id"), F.lit("api").alias("scope"), c("user_id").alias("key"), F.unix_millis("ts").alias("at_ms"), F.sha2("event_type", 256).alias("request_hash"))
    return settle(stateful.idempotent_requests(e, late="0 seconds"), "st4")


@query("st5_rate_limit", _CHAIN.format(key="user_id", extra="0", length=7_200_000) + " SELECT event_id AS request_id, rn AS request_no, rn > 2 AS limited FROM n")
def _(t):
    e = file_stream(t.spark, t.sf_dir, "events").withWatermark("ts", "10 minutes").select(c("event_id").alias("request_id"), c("user_id").alias("key"), F.unix_millis("ts").alias("at_ms"), "ts")
    return settle(stateful.rate_limit(e, 7_200_000, 2), "st5")


@query(
    "st6_run_sessions",
    f"""WITH l AS (SELECT automation_id, emitted_at, event_type, lag(emitted_at) OVER (PARTITION BY automation_id ORDER BY emitted_at) AS prev FROM v_lifecycle), g AS (SELECT *, sum(CASE WHEN prev IS NULL OR emitted_at > prev + INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY automation_id ORDER BY emitted_at) AS grp FROM l)
      SELECT automation_id, min(emitted_at) AS started_at, count(*) AS events, count(*) FILTER (WHERE event_type IN ('automation.completed', 'automation.failed')) AS terminal_events FROM g GROUP BY automation_id, grp HAVING max(emitted_at) + INTERVAL 6 HOURS <= {_MARK}""",
)
def _(t):
    return settle(windows.run_sessions(_view(t, "v_lifecycle")), "st6")


@query("st7_alert_throttle", _CHAIN.format(key="event_type", extra="0", length=1_800_000) + " SELECT event_id AS alert_id, k AS key, tm AS at_ms FROM n WHERE rn = 1")
def _(t):
    e = file_stream(t.spark, t.sf_dir, "events").select(c("event_id").alias("alert_id"), c("event_type").alias("key"), F.unix_millis("ts").alias("at_ms"))
    return settle(stateful.throttle_alerts(e, 1_800_000, "0 seconds"), "st7")


@query("st8_daily_usage", f'SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS period_start, count(*) AS "count" FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= {_MARK}')
def _(t):
    return settle(windows.tumbling_usage(file_stream(t.spark, t.sf_dir, "events").select("ts", "event_type"), "event_type"), "st8")


@query("st9_append_new", "SELECT table_id, priority, status, item, min(row_seq) AS row_seq FROM v_store GROUP BY 1, 2, 3, 4")
def _(t):
    v = _view(t, "v_store", "orders").withColumn("row_key", rows.content_key(c("table_id"), STORE))
    return append.append_new(v, "row_key", "row_seq").select("table_id", *STORE, "row_seq")


@query(
    "st10_expired_locks",
    f"""WITH e AS (SELECT event_id // 2 AS job_id, ts, (epoch_us(ts) // 1000) AS tm, event_id % 2 = 0 AS running FROM events WHERE event_id % 2 = 0 OR event_type <> 'error')
      SELECT r.job_id, r.tm AS locked_ms FROM e r WHERE r.running AND NOT EXISTS (SELECT 1 FROM e x WHERE x.job_id = r.job_id AND NOT x.running AND x.tm >= r.tm AND x.tm <= r.tm + 300000) AND ((epoch_us({_MARK}) // 1000) > r.tm + 300000 OR EXISTS (SELECT 1 FROM e x WHERE x.job_id = r.job_id AND NOT x.running AND x.tm > r.tm + 300000))""",
)
def _(t):
    e = file_stream(t.spark, t.sf_dir, "events").withWatermark("ts", "10 minutes").filter("event_id % 2 = 0 OR event_type <> 'error'")
    j = e.select(F.floor(c("event_id") / 2).cast("long").alias("job_id"), "ts", F.unix_millis("ts").alias("at_ms"), (c("event_id") % 2 == 0).alias("running"))
    return settle(stateful.expired_locks(j), "st10")
