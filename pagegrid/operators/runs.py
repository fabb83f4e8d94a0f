"""Run history: event summaries, per-run artifacts, lifecycle checks and hints."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagegrid.functions.labels import event_taxonomy
from pagegrid.operators.metrics import tail_per_key
from pagegrid.plans.ordered import running

c = F.col


def event_summary(df: DataFrame) -> DataFrame:
    """Counts by type, by severity and by tool plus the total, in one pass."""
    d = df.select("event_type", event_taxonomy(c("event_type"))["severity"].alias("severity"), "tool")
    return d.groupingSets([[c("event_type")], [c("severity")], [c("tool")], []], "event_type", "severity", "tool").agg(F.count(F.lit(1)).alias("n"))


_STATUS = {
    "automation.stop_requested": "stopping",
    "automation.completed": "completed",
    "automation.stopped": "stopped",
    "automation.failed": "error",
}


def _status_of(event_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, status in _STATUS.items():
        out = F.when(event_type == kind, status).otherwise(out)
    return out


def clamp_progress(p: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(p.cast("double"), F.lit(0.0))))


def run_artifacts(df: DataFrame, samples: int = 120) -> DataFrame:
    """One row per run: event counts, progress count/max/last, final status and terminal event.

    All folds are combinable. The newest progress samples come from a rank limit that every map
    task applies first, so even a very long run hands on at most ``samples`` rows per task.
    """
    at = F.struct("emitted_at", "event_id")
    progress = c("event_type") == "automation.progress"
    value = clamp_progress(c("progress"))
    status, terminal = _status_of(c("event_type")), c("event_type").isin("automation.completed", "automation.stopped", "automation.failed")
    base = df.groupBy("automation_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(c("event_type") == "automation.started").alias("started"),
        F.count_if(progress).alias("progress_count"),
        F.coalesce(F.max(F.when(progress, value)), F.lit(0.0)).alias("progress_max"),
        F.max_by(value, F.when(progress, at)).alias("progress_last"),
        F.coalesce(F.max_by(status, F.when(status.isNotNull(), at)), F.lit("running")).alias("status"),
        F.max_by("event_type", F.when(terminal, at)).alias("terminal_event"),
        F.max("emitted_at").alias("updated_at"),
    )
    recent = tail_per_key(df.filter(progress), ["automation_id"], [c("emitted_at").desc(), c("event_id").desc()], samples)
    lists = recent.groupBy("automation_id").agg(F.sort_array(F.collect_list(F.struct("emitted_at", "event_id", value.alias("progress")))).alias("s"))
    return base.join(lists, "automation_id", "left").withColumn("samples", F.transform("s", lambda x: x["progress"])).drop("s")


def status_counts(artifacts: DataFrame) -> DataFrame:
    status = c("status")
    at = F.struct("updated_at", "automation_id")
    return artifacts.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(status == s).alias(s) for s in ("running", "completed", "stopped", "error")],
        F.count_if(~status.isin("running", "completed", "stopped", "error")).alias("other"),
        F.max_by("automation_id", at).alias("latest_run"),
        F.max_by("automation_id", F.when(status == "error", at)).alias("latest_failure"),
    )


def running_progress(df: DataFrame) -> DataFrame:
    progress = F.when(c("event_type") == "automation.progress", clamp_progress(c("progress")))
    out = running(df, ["automation_id"], ["emitted_at", "event_id"], maxima={"progress_max": F.coalesce(progress, F.lit(0.0))}, cheap=True)
    return out.select("event_id", "automation_id", "progress_max")


# Fixed values: (state, transition, next state) that the run lifecycle allows.
TRANSITIONS = [
    ("idle", "start", "running"),
    ("running", "stop_request", "stopping"),
    ("running", "complete", "completed"),
    ("running", "fail", "error"),
    ("stopping", "stop", "stopped"),
    ("stopping", "fail", "error"),
    ("stopped", "reset", "idle"),
    ("completed", "reset", "idle"),
    ("error", "reset", "idle"),
]


def check_transitions(df: DataFrame) -> DataFrame:
    """Flag state changes outside the allowed table. Needs columns (automation_id, emitted_at, event_id, state)."""
    out = running(df, ["automation_id"], ["emitted_at", "event_id"], lags={"previous": "state"}, cheap=True)
    allowed = df.sparkSession.createDataFrame([(a, b) for a, _, b in TRANSITIONS], "previous string, state string").withColumn("legal", F.lit(True))
    out = out.withColumn("previous", F.coalesce("previous", F.lit("idle")))
    return out.join(F.broadcast(allowed), ["previous", "state"], "left").select("event_id", "automation_id", "previous", "state", F.coalesce("legal", F.lit(False)).alias("legal"))


def recent_errors(df: DataFrame, order: list[Column], keep: int | None = None) -> DataFrame:
    """Errors: all, or the first ``keep`` in the given order."""
    return df.orderBy(*order).limit(max(1, keep)) if keep else df


# Strategies a host hint may carry.
HINT_STRATEGIES = ["list_autodetect_autopilot", "point_follow_guided"]


def latest_hints(df: DataFrame, now: Column, ttl_days: int = 30, reason_chars: int | None = None) -> DataFrame:
    """Newest unexpired valid hint per host, with whether it changed from the one before it.

    Input: (host, strategy, reason, updated_at). The two newest hints per host come from a rank
    limit applied in every map task.
    """
    ttl = F.make_dt_interval(F.lit(ttl_days))
    bounded = df.withColumn("updated_at", F.least("updated_at", now + ttl)).withColumn("reason", F.left(F.trim("reason"), F.lit(reason_chars)) if reason_chars else F.trim("reason"))
    valid = bounded.filter((c("host") != "") & c("strategy").isin(HINT_STRATEGIES) & (c("updated_at") >= now - ttl))
    two = tail_per_key(valid, ["host"], [c("updated_at").desc(), c("strategy"), c("reason")], 2)
    ordered = F.struct("updated_at", "strategy", "reason")
    g = two.groupBy("host").agg(F.max_by(F.struct("strategy", "reason", "updated_at"), "updated_at").alias("a"), F.min_by(F.struct("strategy", "reason"), "updated_at").alias("b"), F.count(F.lit(1)).alias("n"))
    changed = (c("n") < 2) | (c("a.strategy") != c("b.strategy")) | (c("a.reason") != c("b.reason"))
    return g.select("host", "a.strategy", "a.reason", "a.updated_at", changed.alias("changed"))
