"""Input tables and the stand-in control/event views derived from them.

The view text is common SQL: Spark runs it over DataFrames, the oracle runs the same text.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "v_requests": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts,
  CASE WHEN event_id % 3 = 0 THEN 'GET' ELSE 'POST' END AS method,
  CASE event_type WHEN 'view' THEN '/healthz' WHEN 'click' THEN '/api/license/status' WHEN 'purchase' THEN '/api/devices/validate-devices'
    WHEN 'signup' THEN '/api/auth/login' ELSE '/api/observability/slo' END AS path,
  CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 500 WHEN event_id % 11 = 0 THEN 404 WHEN event_id % 17 = 0 THEN 302 ELSE 200 END AS status_code,
  value AS duration_ms, user_id AS client_id
FROM {events}""",
    "v_lifecycle": """
SELECT event_id, CAST(user_id AS VARCHAR(20)) AS automation_id, CAST(ts AS TIMESTAMP) AS emitted_at,
  CASE event_type WHEN 'signup' THEN 'automation.started' WHEN 'view' THEN 'automation.progress' WHEN 'click' THEN 'automation.stop_requested'
    WHEN 'purchase' THEN 'automation.completed' ELSE 'automation.failed' END AS event_type,
  CASE WHEN event_type = 'view' THEN CAST(event_id % 130 AS DOUBLE) - 10 ELSE 0 END AS progress
FROM {events}""",
    "v_jobs": """
SELECT event_id AS id, user_id AS account_id,
  CASE event_id % 3 WHEN 0 THEN 'integration.webhook.deliver' WHEN 1 THEN 'extraction.page.summary' ELSE 'monitor.page.diff' END AS job_type,
  CASE event_id % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'retrying' WHEN 3 THEN 'succeeded' WHEN 4 THEN 'failed'
    WHEN 5 THEN 'dead_letter' ELSE 'canceled' END AS status,
  CAST(event_id % 6 AS INT) AS attempts, 5 AS max_attempts, CAST(ts AS TIMESTAMP) AS next_run_at, CAST(ts AS TIMESTAMP) AS created_at
FROM {events}""",
    "v_schedules": """
SELECT o_orderkey AS id, o_custkey AS account_id, CAST(o_orderdate AS TIMESTAMP) AS created_at,
  (o_orderkey % 4 <> 0) AS is_active,
  CASE WHEN o_orderkey % 3 = 0 THEN 'cron' ELSE 'interval' END AS schedule_kind,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(5 * (1 + o_orderkey % 6) AS INT) END AS interval_minutes,
  CASE WHEN o_orderkey % 3 = 0 THEN '*/15 8-18 * * 1-5' ELSE NULL END AS cron_expr,
  'monitor.page.diff' AS target_job_type, concat('https://Example.com/item/', CAST(o_custkey % 50 AS VARCHAR(20)), '#top') AS target_url
FROM {orders}""",
    "v_accounts": """
SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'pro' ELSE 'free' END AS tier, (c_custkey % 3 <> 0) AS is_license_active,
  CAST(2 + c_custkey % 3 AS INT) AS max_devices
FROM {customer}""",
    "v_licenses": """
SELECT o_orderkey AS id, o_custkey AS account_id, CASE WHEN o_orderkey % 7 = 0 THEN 'revoked' ELSE 'active' END AS status,
  CAST(o_orderdate AS TIMESTAMP) AS created_at
FROM {orders} WHERE o_orderkey % 2 = 0""",
    "v_devices": """
SELECT user_id AS account_id, concat('dev-', CAST(event_id % 7 AS VARCHAR(20))) AS device_id,
  MIN(CAST(ts AS TIMESTAMP)) AS created_at, MAX(CAST(ts AS TIMESTAMP)) AS last_seen_at
FROM {events} GROUP BY user_id, concat('dev-', CAST(event_id % 7 AS VARCHAR(20)))""",
    "v_rows": """
SELECT c_custkey AS row_seq, c_mktsegment AS segment, lower(c_mktsegment) AS seg_lower, c_mktsegment AS seg_copy, 'always' AS constant,
  CASE WHEN c_custkey % 20 = 0 THEN c_name ELSE '' END AS sparse, '' AS empty_only,
  concat('https://example.com/img/', CAST(c_nationkey AS VARCHAR(20)), '.png') AS image_url
FROM {customer}""",
    # stored rows of several tables, with repeated content inside a table
    "v_store": """
SELECT concat('t', CAST(o_custkey % 10 AS VARCHAR(20))) AS table_id, o_orderkey AS row_seq, CAST(o_orderdate AS TIMESTAMP) AS created_at,
  o_orderpriority AS priority, o_orderstatus AS status, CAST(o_custkey % 50 AS VARCHAR(20)) AS item
FROM {orders}""",
    # one row per monitor run; the watched title changes now and then
    "v_monitor": """
SELECT event_id AS run_id, user_id AS account_id, concat('mon.', event_type) AS monitor_key, CAST(ts AS TIMESTAMP) AS run_at,
  concat('https://example.com/', event_type) AS target_url, concat('Title ', CAST(CAST(floor(value / 40) AS INT) AS VARCHAR(20))) AS title,
  CAST(event_id % 3 AS INT) AS link_count, CASE WHEN event_id % 2 = 0 THEN 'en' ELSE 'de' END AS lang
FROM {events}""",
    # one row per spend day
    "v_spend": """
SELECT CAST(ts AS DATE) AS day, SUM(CAST(value AS DECIMAL(18,2))) AS usd FROM {events} GROUP BY CAST(ts AS DATE)""",
}

#: the fixed clock of every query; nothing reads wall time
NOW = "2024-02-01 00:00:00"


#: tables of heavy rows, with the key they are spread by when they come in too few partitions
HEAVY = {"pages": "page_id", "documents": "doc_id"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a plain scan over all cores when it has fewer partitions than cores.

    Heavy per-row work on a small file would otherwise sit in one task. A large table already has
    more partitions than cores and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


class Tables:
    """Lazy access to base tables and views as DataFrames: ``t.events``, ``t.v_jobs``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            return spread(df, HEAVY[name]) if name in HEAVY else df
        if name in VIEWS:
            text = VIEWS[name]
            sources = {s: getattr(self, s) for s in set(re.findall(r"\{(\w+)\}", text))}
            return self.spark.sql(text, **sources)
        raise AttributeError(name)


def oracle_text(sql: str) -> str:
    """Prefix the views a statement mentions as common table expressions."""
    sql = sql.strip()
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    ctes = ", ".join(f"{v} AS ({VIEWS[v].format(**{b: b for b in BASE}).strip()})" for v in used)
    head = re.match(r"(?i)with\s+(recursive\s+)?", sql)
    if head:
        return f"WITH {(head.group(1) or '')}{ctes}, {sql[head.end():]}"
    return f"WITH {ctes} {sql}"
