"""Window aggregates over event streams; each has a batch twin in the operators package."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagegrid.functions.labels import request_family
from pagegrid.functions.numbers import percent

c = F.col


def sliding_requests(requests: DataFrame, length: str = "60 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Trailing-window request metrics; late rows beyond the watermark drop. The percentile is approximate here."""
    code = c("status_code")
    g = requests.withWatermark("ts", late).groupBy(F.window("ts", length, slide).alias("w"))
    out = g.agg(
        F.count(F.lit(1)).alias("requests_total"), F.count_if((code >= 200) & (code < 400)).alias("status_2xx"), F.count_if((code >= 400) & (code < 500)).alias("status_4xx"),
        F.count_if(code >= 500).alias("status_5xx"), F.percentile_approx("duration_ms", 0.95, 10_000).alias("p95_approx"),
    )
    return out.select(c("w.start").alias("window_start"), "requests_total", "status_2xx", "status_4xx", "status_5xx", percent(c("status_5xx"), c("requests_total")).alias("error_rate_percent"), "p95_approx")


def tumbling_usage(events: DataFrame, scope: str, length: str = "1 day", late: str = "10 minutes") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), scope)
    return g.agg(F.count(F.lit(1)).alias("count")).select(scope, c("w.start").alias("period_start"), "count")


def family_usage(requests: DataFrame, length: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    return tumbling_usage(requests.select("ts", request_family(c("path")).alias("family")), "family", length, late)


def run_sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Activity sessions per run, closed by idleness."""
    s = events.withWatermark("emitted_at", late).groupBy(F.session_window("emitted_at", gap).alias("w"), "automation_id")
    out = s.agg(F.count(F.lit(1)).alias("events"), F.count_if(c("event_type").isin("automation.completed", "automation.stopped", "automation.failed")).alias("terminal_events"))
    return out.select("automation_id", c("w.start").alias("started_at"), "events", "terminal_events")


def unseen_entities(rows: DataFrame, scope: str, key: str, ts: str, remember: str = "60 days") -> DataFrame:
    """First row of each (scope, key) within the memory span; rows without a key always pass."""
    timed = rows.withWatermark(ts, remember)
    fresh = timed.filter(c(key) != "").dropDuplicatesWithinWatermark([scope, key])
    return fresh.unionByName(timed.filter(c(key) == ""))
