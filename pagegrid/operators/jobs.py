"""Job and schedule tables as set transforms of (table, outcomes, now)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pagegrid.functions import cronbits, times
from pagegrid.functions.text import to_text, trim_ws
from pagegrid.functions.urls import is_http, let, target_signature
from pagegrid.operators.rows import first_rows
from pagegrid.plans.lineage import stage

c = F.col
OPEN = ["queued", "retrying"]


def list_jobs(jobs: DataFrame, statuses: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    out = jobs.filter(c("status").isin(list(statuses))) if statuses else jobs
    return out.orderBy(c("created_at").desc(), c("id").desc()).limit(limit) if limit else out


def due_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.filter(c("status").isin(OPEN) & (c("next_run_at") <= now))


def due_first(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy("next_run_at", "created_at", "id").limit(max(1, limit))


def dead_letter_list(letters: DataFrame, jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Dead letters with their jobs: all, or the newest ``limit``."""
    j = jobs.select(c("id").alias("job_id"), "job_type", "attempts", "max_attempts")
    return first_rows(letters.join(j, "job_id"), [c("created_at").desc(), c("job_id").desc()], limit)


def queue_stats(jobs: DataFrame, dead_letters: DataFrame, now: Column) -> DataFrame:
    """(measure, value): one row per status, due jobs, dead letters; one pass over the jobs."""
    due = c("status").isin(OPEN) & (c("next_run_at") <= now)
    by = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(due).alias("due"))
    rows = by.select(F.concat(F.lit("status:"), "status").alias("measure"), c("n").alias("value"))
    total = by.agg(F.lit("due_now").alias("measure"), F.coalesce(F.sum("due"), F.lit(0)).alias("value"))
    dead = dead_letters.agg(F.lit("dead_letters").alias("measure"), F.count(F.lit(1)).alias("value"))
    return rows.unionByName(total).unionByName(dead)


def schedule_stats(schedules: DataFrame, now: Column) -> DataFrame:
    by = schedules.groupBy("schedule_kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_active").alias("active"), F.count_if(c("is_active") & (c("next_run_at") <= now)).alias("due")
    )
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), c(v).alias("v")) for m, v in (("schedules_total", "n"), ("schedules_active", "active"), ("schedules_due", "due"))])
    totals = by.select(F.explode(measures).alias("x")).groupBy("x.measure").agg(F.sum("x.v").alias("value"))
    return by.select(F.concat(F.lit("kind:"), "schedule_kind").alias("measure"), c("n").alias("value")).unionByName(totals)


# Queue measure -> highest value without an alert.
QUEUE_LIMITS = [("due_now", 200), ("dead_letters", 3), ("schedules_due", 200)]


def queue_breaches(stats: DataFrame) -> DataFrame:
    limits = stats.sparkSession.createDataFrame(QUEUE_LIMITS, "measure string, bound long")
    return stats.join(F.broadcast(limits), "measure").filter(c("value") > c("bound"))


def stored(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A stored column, or nulls where the table lacks it."""
    return c(name) if name in df.columns else F.lit(None).cast(kind)


def changed(df: DataFrame, table: DataFrame, hit: Column, values: dict[str, Column]) -> DataFrame:
    """The columns of ``table``, with ``values`` where ``hit``; all else, and every other row, stays as stored.

    Columns the table lacks are added, but for locks and ``updated_at``, which only a table that has them keeps.
    """
    kinds = {"next_run_at": "timestamp", "completed_at": "timestamp", "last_run_at": "timestamp"}
    optional = ("locked_at", "locked_by", "updated_at")
    values = {n: v for n, v in values.items() if n in table.columns or n not in optional}
    new = {n: F.when(hit, v).otherwise(stored(table, n, kinds.get(n, "string"))).alias(n) for n, v in values.items()}
    return df.select(*[new.pop(n) if n in new else c(n) for n in table.columns], *new.values(), *[n for n in df.columns if n not in table.columns and n in ("recovered", "canceled")])


def _letters(df: DataFrame, table: DataFrame, code: Column, message: Column, now: Column) -> DataFrame:
    snapshot = [c("payload").alias("payload_snapshot")] if "payload" in table.columns else []
    return df.select(c("id").alias("job_id"), "account_id", code.alias("reason_code"), message.alias("reason_message"), now.alias("created_at"), *snapshot)


def apply_outcomes(jobs: DataFrame, outcomes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(jobs, dead letters) after outcomes (id, ok, retryable, error_code, error_message, jitter).

    Terminal when not retryable or attempts are used up; otherwise retrying after the back-off.
    Several outcomes of one job: the last by ``at`` counts. Jobs without an outcome stay as they are.
    """
    last = outcomes.groupBy("id").agg(F.max_by(F.struct("ok", "retryable", "error_code", "error_message", "jitter"), "at").alias("__o"))
    j = jobs.join(last, "id", "left")
    ok, hit = c("__o.ok"), c("__o.ok").isNotNull()
    terminal = ~ok & (~c("__o.retryable") | (c("attempts") >= c("max_attempts")))
    wait = times.job_backoff_seconds(c("attempts"), F.coalesce("__o.jitter", F.lit(0.0)))
    code = F.coalesce("__o.error_code", F.when(terminal, "JOB_FAILED").otherwise("RETRYABLE_FAILURE"))
    message = F.coalesce("__o.error_message", F.when(terminal, "Unknown job failure").otherwise("Retryable job failure"))
    out = changed(j, jobs, hit, {
        "status": F.when(ok, "succeeded").when(terminal, "dead_letter").otherwise("retrying"),
        "next_run_at": F.when(ok | terminal, c("next_run_at")).otherwise(now + F.make_interval(secs=wait)),
        "completed_at": F.when(ok | terminal, now),
        "last_error_code": F.when(~ok, code), "last_error": F.when(~ok, message),
        "locked_at": F.lit(None), "locked_by": F.lit(None), "updated_at": now,
    })
    letters = _letters(
        j.filter(F.coalesce(terminal, F.lit(False))), jobs, F.coalesce("__o.error_code", F.lit("JOB_FAILED")),
        F.coalesce("__o.error_message", F.lit("Job moved to dead letter queue")), now,
    )
    return out, letters


def upsert_dead_letters(stored: DataFrame, letters: DataFrame) -> DataFrame:
    """A new letter replaces reason and time of a stored one of the same job."""
    cols = stored.columns
    kept = stored.join(letters.select("job_id"), "job_id", "left_anti")
    return kept.select(*cols).unionByName(letters.select(*cols))


def recover_locks(jobs: DataFrame, now: Column, timeout_s: int = 300) -> tuple[DataFrame, DataFrame]:
    """(jobs, dead letters): expired running locks become dead letters when attempts are used up, else retry at once."""
    timeout_s = max(60, int(timeout_s))
    expired = (c("status") == "running") & c("locked_at").isNotNull() & (c("locked_at") < now - F.make_interval(secs=F.lit(timeout_s)))
    j = jobs.withColumn("recovered", F.coalesce(expired, F.lit(False)))
    used_up = c("attempts") >= c("max_attempts")
    lost = "Job lock expired and attempts exhausted"
    out = changed(j, jobs, c("recovered"), {
        "status": F.when(used_up, "dead_letter").otherwise("retrying"), "next_run_at": F.when(used_up, c("next_run_at")).otherwise(now),
        "completed_at": F.when(used_up, now).otherwise(stored(jobs, "completed_at", "timestamp")), "locked_at": F.lit(None), "locked_by": F.lit(None),
        "last_error_code": F.lit("LOCK_TIMEOUT"), "last_error": F.when(used_up, lost).otherwise("Recovered from expired lock"), "updated_at": now,
    })
    return out, _letters(j.filter(c("recovered") & used_up), jobs, F.lit("LOCK_TIMEOUT"), F.lit(lost), now)


def cancel(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Cancel queued, retrying or running jobs of the given (account_id, id) pairs."""
    hit = ids.select("account_id", "id").distinct().withColumn("__hit", F.lit(True))
    j = jobs.join(hit, ["account_id", "id"], "left")
    j = j.withColumn("canceled", F.coalesce(c("__hit") & c("status").isin("queued", "retrying", "running"), F.lit(False)))
    return changed(j, jobs, c("canceled"), {"status": F.lit("canceled"), "completed_at": now, "locked_at": F.lit(None), "locked_by": F.lit(None), "updated_at": now})


# -- schedules ------------------------------------------------------------------------------------


def schedule_signature(target: bool = True) -> Column:
    """Identity of what a schedule does. Needs columns target_job_type, schedule_kind, interval_minutes,
    cron_expr, timezone, max_attempts, target_urls (array), max_urls and payload (JSON text)."""
    from pagegrid.functions.jsonx import canonical

    kind = F.lower(trim_ws(to_text(c("schedule_kind"))))
    cadence = F.when(kind == "interval", F.concat(F.lit("interval:"), F.coalesce("interval_minutes", F.lit(0)))).otherwise(
        F.concat(F.lit("cron:"), trim_ws(to_text(c("cron_expr"))), F.lit("|tz:"), F.coalesce(F.nullif(trim_ws(to_text(c("timezone"))), F.lit("")), F.lit("UTC")))
    )
    strict = F.coalesce(canonical(c("payload")), F.lit("{}"))
    urls = F.array_sort(F.array_distinct(F.filter(F.transform("target_urls", target_signature), lambda u: u != "")))
    limit = F.when(c("max_urls") > 0, F.floor("max_urls").cast("long"))
    compact = F.to_json(F.struct(limit.alias("maxUrls"), urls.alias("targets")))
    payload = F.when(F.size(urls) > 0, compact).otherwise(strict) if target else strict
    return F.concat(
        F.lower(trim_ws(to_text(c("target_job_type")))), F.lit("|"), kind, F.lit("|"), cadence, F.lit("|attempts:"), F.coalesce("max_attempts", F.lit(0)),
        F.lit(f"|signatureMode:{'target' if target else 'strict'}|payload:"), payload,
    )


def duplicate_groups(schedules: DataFrame, keep: str = "oldest", redact: bool = False) -> DataFrame:
    """Groups of equal ``signature`` with at least two members: size and the member to keep.

    Folded without listing members, so a signature shared by a third of all schedules stays cheap.
    Unknown dates sort last; the id breaks ties.
    """
    order = F.struct(c("created_at").isNull().alias("late"), "created_at", "id")
    pick = F.max_by("id", order) if keep == "newest" else F.min_by("id", order)
    g = schedules.groupBy("signature").agg(F.count(F.lit(1)).alias("total"), pick.alias("keep_id")).filter("total >= 2")
    if redact:
        g = g.withColumn("signature", F.concat(F.lit("sha256:"), F.left(F.sha2("signature", 256), F.lit(24))))
    return g


def duplicate_members(schedules: DataFrame, keep: str = "oldest") -> DataFrame:
    """Members of duplicate groups, one row each, with the kept one marked."""
    from pagegrid.plans.lineage import stage

    schedules = stage(schedules, "schedules")  # the groups and the join read it: signatures are made once
    g = duplicate_groups(schedules, keep)
    return schedules.join(g, "signature").withColumn("keeps", c("id") == c("keep_id"))


def pause_plan(members: DataFrame, apply: bool = False, batch_size: int = 20, max_pause: int = 0, force: bool = False) -> DataFrame:
    """Members to pause, labelled and numbered into batches; blocked when the plan exceeds the limit."""
    from pagegrid.plans.lineage import stage
    from pagegrid.plans.ordered import running

    size = max(1, int(batch_size))
    plan = stage(members.filter(~c("keeps")).select("signature", "created_at", "id", "is_active"), "plan")  # read several times below
    numbered = running(plan, [], ["signature", "created_at", "id"], number="place", cheap=True)
    label = F.when(~c("is_active"), "already_inactive").when(F.lit(not apply), "dry_run").otherwise("to_pause")
    out = numbered.select("id", label.alias("action"), F.ceil(c("place") / size).cast("long").alias("batch"))
    attempted = plan.count()  # the plan is staged: a count of its file footers
    return out.withColumn("attempted", F.lit(attempted).cast("long")).withColumn("blocked", F.lit(apply and 0 < max_pause < attempted and not force))


def filter_schedules(df: DataFrame, job_type: str = "", name: str = "", interval_lte: int = 0, min_age: int = 0, now: Column | None = None) -> DataFrame:
    keep = F.lit(True)
    if job_type.strip():
        keep = keep & (c("target_job_type") == job_type.strip().lower())
    if name.strip():
        keep = keep & F.lower("name").contains(name.strip().lower())
    if interval_lte > 0:
        keep = keep & (c("schedule_kind") == "interval") & (c("interval_minutes") > 0) & (c("interval_minutes") <= interval_lte)
    if min_age > 0:
        keep = keep & (times.age_minutes(F.coalesce("created_at", "updated_at"), now) >= min_age)
    return df.filter(keep)


#: zones and cron expressions are sent to every task only up to this many
_SENT_ZONES, _SENT_EXPRESSIONS = 20_000, 100_000


def next_cron_runs(schedules: DataFrame, from_ts: str, look_ahead_minutes: int = 525_600) -> DataFrame:
    """(id, next_run_at) of cron schedules (id, cron_expr, timezone): first matching minute strictly after ``from_ts``.

    Distinct expressions and zones are prepared once; the search is local to a row (see ``cronbits``). An unknown zone or
    no match within the look-ahead, which is at most 366 days, gives null.
    """
    if not 0 < look_ahead_minutes <= 366 * 1440:
        raise ValueError("look_ahead_minutes must be between 1 and 366 days")
    start = F.unix_seconds(F.date_trunc("minute", c(from_ts))) + 60
    rows = schedules.select("id", "cron_expr", "timezone", start.alias("start"))
    # names are written first, so that they are cleaned once each and not row by row
    names = stage(rows.groupBy("timezone").agg(F.min("start").alias("lo"), (F.max("start") + look_ahead_minutes * 60).alias("hi")).filter("lo IS NOT NULL"), "names")
    names = names.withColumn("zone", F.coalesce(F.nullif(trim_ws(to_text(c("timezone"))), F.lit("")), F.lit("UTC")))
    spans = names.groupBy("zone").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    zones = stage(names.select(c("timezone").alias("__named"), "zone").join(cronbits.zone_stretches(spans), "zone").drop("zone"), "zones")
    # written first: a filter on the parsed fields would move below the distinct step and parse every row
    texts = stage(rows.select(c("cron_expr").alias("__expr")).distinct(), "expressions")
    valid = texts.select("__expr", times.cron_fields(c("__expr")).alias("k")).filter("k.valid")
    parsed = stage(valid.select("__expr", cronbits.words("k").alias("k")), "cron")
    sent = lambda df, most: F.broadcast(df) if df.count() <= most else df
    j = rows.join(sent(parsed, _SENT_EXPRESSIONS), c("cron_expr") == c("__expr"), "left").join(sent(zones, _SENT_ZONES), c("timezone").eqNullSafe(c("__named")), "left")
    found = cronbits.next_run("k", "stretches", "start", f"(start + {look_ahead_minutes * 60})")
    solvable = c("k").isNotNull() & c("stretches").isNotNull() & c("start").isNotNull()
    return j.select("id", F.timestamp_seconds(F.when(solvable, found)).alias("next_run_at"))


def trigger_due(schedules: DataFrame, now: Column, now_text: str, worker: str, batch: int | None = 10) -> tuple[DataFrame, DataFrame]:
    """(new jobs, schedules) of a sweep: due schedules become queued jobs and move to their next run.

    A schedule whose cron cannot be solved gets no job, an error text and a retry in five minutes.
    """
    due = schedules.filter(c("is_active") & (c("next_run_at") <= now))
    due = due_first(due, batch) if batch else due
    due = due.withColumn("__now", now)
    cron = next_cron_runs(due.filter("schedule_kind = 'cron'").select("id", "cron_expr", "timezone", "__now"), "__now").withColumnRenamed("next_run_at", "__cron_next")
    d = due.join(cron, "id", "left")
    nxt = F.when(c("schedule_kind") == "interval", times.add_minutes(now, times.valid_interval(c("interval_minutes")))).otherwise(c("__cron_next"))
    d = d.withColumn("__next", nxt)
    info = F.struct(c("id").cast("string").alias("id"), c("name").alias("name"), F.lit(worker).alias("workerId"), F.lit(now_text).alias("triggeredAt"))
    jobs = d.filter(c("__next").isNotNull()).select(
        c("id").alias("schedule_id"), "account_id", c("target_job_type").alias("job_type"), F.lit("queued").alias("status"),
        F.to_json(F.struct(c("target_url").alias("targetUrl"), info.alias("schedule"))).alias("payload"), now.alias("next_run_at"),
    )
    moves = d.select("id", F.lit(True).alias("__swept"), F.coalesce("__next", now + F.expr("INTERVAL 5 MINUTES")).alias("__n"), c("__next").isNull().alias("__bad"))
    s = schedules.join(moves, "id", "left")
    # a schedule that has no next run keeps its last run and says why
    updated = changed(s, schedules, c("__swept").isNotNull(), {
        "next_run_at": c("__n"), "last_run_at": F.when(c("__bad"), stored(schedules, "last_run_at", "timestamp")).otherwise(now),
        "last_error": F.when(c("__bad"), "Unable to calculate next cron run"), "updated_at": now,
    })
    return jobs, updated


def first_run(definitions: DataFrame, now: Column) -> DataFrame:
    """Adds next_run_at to new or changed schedule definitions (id, is_active, schedule_kind, interval_minutes, cron_expr,
    timezone): the next run of an active one, 365 days ahead for an inactive one.
    """
    d = definitions.drop("next_run_at").withColumn("__now", now)
    cron = next_cron_runs(d.filter(c("is_active") & (c("schedule_kind") == "cron")).select("id", "cron_expr", "timezone", "__now"), "__now").withColumnRenamed("next_run_at", "__cron_next")
    nxt = F.when(c("schedule_kind") == "interval", times.add_minutes(now, times.valid_interval(c("interval_minutes")))).otherwise(c("__cron_next"))
    d = d.join(cron, "id", "left")
    return d.withColumn("next_run_at", F.when(c("is_active"), nxt).otherwise(now + F.expr("INTERVAL 365 DAYS"))).drop("__now", "__cron_next")


def save_schedules(stored_rows: DataFrame, definitions: DataFrame, now: Column) -> DataFrame:
    """Schedules after definitions: ids the table lacks are created, others updated; columns a definition does not name stay."""
    fresh = first_run(definitions, now).withColumn("__d", F.struct("*")).select("id", "__d")
    given = fresh.schema["__d"].dataType.names
    j = stored_rows.join(fresh, "id", "full_outer")
    new = lambda n: F.when(c("__d").isNotNull(), c(f"__d.{n}")).otherwise(c(n)) if n in given else c(n)
    stamp = {"created_at": F.coalesce(c("created_at"), now), "updated_at": F.when(c("__d").isNotNull(), now).otherwise(c("updated_at"))} if {"created_at", "updated_at"} <= set(stored_rows.columns) else {}
    return j.select(*[stamp[n].alias(n) if n in stamp else c("id") if n == "id" else new(n).alias(n) for n in stored_rows.columns])


def toggle(schedules: DataFrame, switches: DataFrame, now: Column) -> DataFrame:
    """Set is_active per (account_id, id); activation recomputes the next run, pausing keeps it."""
    sw = switches.groupBy("account_id", "id").agg(F.max_by("active", "at").alias("__on"))
    j = schedules.join(sw, ["account_id", "id"], "left").withColumn("__now", now)
    cron = next_cron_runs(j.filter(c("__on") & (c("schedule_kind") == "cron")).select("id", "cron_expr", "timezone", "__now"), "__now").withColumnRenamed("next_run_at", "__cron_next")
    j = j.join(cron, "id", "left")
    nxt = F.when(c("schedule_kind") == "interval", times.add_minutes(now, times.valid_interval(c("interval_minutes")))).otherwise(c("__cron_next"))
    return j.select(
        *[n for n in schedules.columns if n not in ("is_active", "next_run_at")], F.coalesce("__on", "is_active").alias("is_active"),
        F.when(F.coalesce("__on", F.lit(False)), F.coalesce(nxt, "next_run_at")).otherwise(c("next_run_at")).alias("next_run_at"),
    )


def schedule_input_error() -> Column:
    """First validation code of a schedule definition row, null when it is valid."""
    name = trim_ws(to_text(c("name")))
    kind = F.lower(trim_ws(to_text(c("schedule_kind"))))
    job = F.lower(trim_ws(to_text(c("target_job_type"))))
    payload_kind = F.schema_of_variant(F.try_parse_json("payload"))
    return (
        F.when((name == "") | (F.length(name) > 120), "INVALID_SCHEDULE_NAME")
        .when(~kind.isin("interval", "cron"), "INVALID_SCHEDULE_KIND")
        .when(~job.rlike("^[a-z0-9._-]{3,80}$"), "INVALID_TARGET_JOB_TYPE")
        .when(~F.coalesce(payload_kind.startswith("OBJECT"), F.lit(False)), "INVALID_TARGET_PAYLOAD")
        .when((kind == "interval") & times.valid_interval(c("interval_minutes")).isNull(), "INVALID_INTERVAL_MINUTES")
        .when((kind == "cron") & (trim_ws(to_text(c("cron_expr"))) == ""), "INVALID_CRON_EXPR")
        .when((kind == "cron") & ~times.cron_fields(c("cron_expr"))["valid"], "INVALID_CRON_EXPR")
    )


# -- payload checks -------------------------------------------------------------------------------


def _text(path: str) -> Column:
    return trim_ws(to_text(F.try_variant_get("__p", path, "string")))


def _kind(path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("__p", path, "variant"))


def _is_object(path: str) -> Column:
    return F.coalesce(_kind(path).startswith("OBJECT"), F.lit(False))


def _present(path: str) -> Column:
    return F.try_variant_get("__p", path, "variant").isNotNull()


def validate_payloads(jobs: DataFrame) -> DataFrame:
    """Adds ``ok``, ``error_type`` and ``message`` by ordered rules per job type; first failure wins.

    Needs ``job_type`` and ``payload`` (JSON text). Split the result on ``ok`` to quarantine bad rows.
    """
    urls = F.filter(F.transform(F.coalesce(F.try_variant_get("__p", "$.targetUrls", "array<string>"), F.array().cast("array<string>")), lambda u: trim_ws(to_text(u))), lambda u: u != "")
    target = _text("$.targetUrl")
    every = F.concat(F.filter(F.array(target), lambda u: u != ""), urls)
    is_obj = F.coalesce(F.schema_of_variant("__p").startswith("OBJECT"), F.lit(False))
    # The messages below, in the order of their rules.
    hook = "$.notify.webhook"
    hook_event, timeout = _text(f"{hook}.eventType"), _text(f"{hook}.timeoutMs").try_cast("double")
    webhook = (
        F.when(~is_obj, "Webhook payload must be an object")
        .when(~is_http(target), "Webhook payload targetUrl must be a valid http/https URL")
        .when(F.length(_text("$.eventType")) < 2, "Webhook payload eventType is required")
    )
    extraction = (
        F.when(~is_obj, "Extraction payload must be an object")
        .when(F.size(every) == 0, "Extraction payload requires targetUrl or targetUrls")
        .when(F.exists(every, lambda u: ~is_http(u)), "Extraction payload URLs must be valid http/https URLs")
    )
    monitor = (
        F.when(~is_obj, "Monitor payload must be an object")
        .when(target == "", "Monitor payload targetUrl is required")
        .when(~is_http(target), "Monitor payload targetUrl must be a valid http/https URL")
        .when(F.size(urls) > 0, "Monitor payload supports single targetUrl only")
        .when((_text("$.monitorKey") != "") & ~_text("$.monitorKey").rlike("^[a-zA-Z0-9._:-]{3,120}$"), "Monitor payload monitorKey must match [a-zA-Z0-9._:-]{3,120}")
        .when(_present("$.compare") & ~_is_object("$.compare"), "Monitor payload compare must be an object")
        .when(_present("$.notify") & ~_is_object("$.notify"), "Monitor payload notify must be an object")
        .when(_present(hook) & ~_is_object(hook), "Monitor notify webhook must be an object")
        .when(_present(hook) & ~is_http(_text(f"{hook}.targetUrl")), "Monitor notify webhook targetUrl must be a valid http/https URL")
        .when((hook_event != "") & (F.length(hook_event) < 2), "Monitor notify webhook eventType must be at least 2 chars")
        .when(_present(f"{hook}.timeoutMs") & (timeout.isNull() | (timeout < 1000)), "Monitor notify webhook timeoutMs must be >= 1000")
        .when(_present(f"{hook}.headers") & ~_is_object(f"{hook}.headers"), "Monitor notify webhook headers must be an object")
        .when(_present(f"{hook}.body") & ~_is_object(f"{hook}.body"), "Monitor notify webhook body must be an object")
        .when(_present(f"{hook}.secretRef") & ~_is_object(f"{hook}.secretRef"), "Monitor notify webhook secretRef must be an object")
        .when(_present(f"{hook}.secretRef") & ((_text(f"{hook}.secretRef.provider") == "") | (_text(f"{hook}.secretRef.secretName") == "")), "Monitor notify webhook secretRef requires provider and secretName")
    )
    kind = c("job_type")
    message = F.when(kind == "integration.webhook.deliver", webhook).when(kind == "extraction.page.summary", extraction).when(kind == "monitor.page.diff", monitor)
    error = (
        F.when(kind == "integration.webhook.deliver", "INVALID_WEBHOOK_PAYLOAD")
        .when(kind == "extraction.page.summary", "INVALID_EXTRACTION_PAYLOAD")
        .when(kind == "monitor.page.diff", "INVALID_MONITOR_PAYLOAD")
    )
    out = jobs.withColumn("__p", F.try_parse_json("payload")).withColumn("message", message)
    return out.withColumn("ok", c("message").isNull()).withColumn("error_type", F.when(~c("ok"), error)).drop("__p")


def needs_webhook_opt_in() -> Column:
    parsed = F.try_parse_json("payload")
    target = F.try_variant_get(parsed, "$.notify.webhook.targetUrl", "string")
    return (c("job_type") == "integration.webhook.deliver") | ((c("job_type") == "monitor.page.diff") & is_http(target))


# Words that mark a payload key as row-level or raw content.
BLOCKED_WORDS = ["rows", "records", "dataset", "extracted", "raw_html", "html", "dom_snapshot", "screenshot", "page_content", "full_text", "csv", "xlsx", "json_export"]


def policy_audit(payloads: DataFrame, key: str, max_bytes: int = 32_768) -> DataFrame:
    """(key, ok, code, blocked_paths): keys are matched inside words; the size check comes first."""
    from pagegrid.functions.jsonx import flatten_paths

    fold = lambda text: F.regexp_replace(F.lower(text), r"[\s-]+", "_")
    bad, named = F.lit(False), c("payload").contains("\\")  # an escaped key is only known when it is read
    for word in BLOCKED_WORDS:
        bad, named = bad | c("name").contains(word), named | c("folded").contains(word)
    sized = payloads.select(key, F.octet_length("payload").alias("size_bytes"), "payload")
    # only payloads whose text has one of the words at all are opened
    suspects = sized.withColumn("folded", fold(c("payload"))).filter(named).select(key, F.try_parse_json("payload").alias("v"))
    paths = flatten_paths(suspects, "v", [key], open_arrays=True).withColumn("name", fold(trim_ws(to_text(c("key")))))
    blocked = paths.filter(bad).groupBy(key).agg(F.sort_array(F.collect_list("path")).alias("blocked_paths"))
    j = sized.select(key, "size_bytes").join(blocked, key, "left")
    code = F.when(c("size_bytes") > max_bytes, "METADATA_PAYLOAD_TOO_LARGE").when(c("blocked_paths").isNotNull(), "METADATA_ONLY_POLICY_VIOLATION")
    return j.select(key, code.isNull().alias("ok"), code.alias("code"), F.coalesce("blocked_paths", F.array().cast("array<string>")).alias("blocked_paths"))


# -- run configuration and batch outcomes --------------------------------------------------------------


def config_summary(df: DataFrame, config: str = "config", runner: str = "runner_type") -> DataFrame:
    """Typed columns of a run configuration JSON with defaults."""
    from pagegrid.functions.labels import tool_type

    d = df.withColumn("__p", F.try_parse_json(config))
    action = F.upper(F.coalesce(F.nullif(_text("$.pageActionType"), F.lit("")), _text("$.actions[0].type")))
    urls = F.coalesce(F.try_variant_get("__p", "$.urls", "array<string>"), F.array().cast("array<string>"))
    actions = F.coalesce(F.try_variant_get("__p", "$.actions", "array<variant>"), F.array().cast("array<variant>"))
    first = trim_ws(to_text(F.get(urls, F.lit(0))))
    num = lambda path: F.coalesce(_text(path).try_cast("double"), F.lit(0.0)).cast("long")
    queue = "$.queue"
    return d.select(
        *df.columns, tool_type(c(runner), action).alias("tool_type"), action.alias("action_type"), _text("$.urlSourceMode").alias("url_source_mode"),
        F.coalesce(F.nullif(_text("$.startUrl"), F.lit("")), first).alias("start_url"), F.size(urls).cast("long").alias("url_count"), (F.size(actions) > 0).alias("has_actions"),
        *[num(f"{queue}.{k}").alias(k) for k in ("maxConcurrentTabs", "delayBetweenRequestsMs", "pageTimeoutMs", "maxRetries", "retryDelayMs", "jitterMs", "waitForSelectorTimeoutMs")],
        F.coalesce(F.try_variant_get("__p", f"{queue}.waitForPageLoad", "boolean"), F.lit(True)).alias("waitForPageLoad"),
        _text(f"{queue}.waitForSelector").alias("waitForSelector"),
        *[_text(f"{queue}.reliability.{k}").alias(k) for k in ("profile", "backoffStrategy", "jitterMode", "sessionReuseMode")],
        *[num(f"{queue}.reliability.{k}").alias(k) for k in ("minRetryDelayMs", "maxRetryDelayMs")],
    )


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """Per run: totals and distinct url counts from per-url outcome rows (run_id, url, ok, retries)."""
    per_url = outcomes.filter(trim_ws(to_text(c("url"))) != "").groupBy("run_id", "url").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("good"), F.count_if(~c("ok")).alias("bad"), F.sum("retries").alias("retries")
    )
    return per_url.groupBy("run_id").agg(
        F.sum("n").alias("attempted"), F.sum("good").alias("success_count"), F.sum("bad").alias("failure_count"), F.sum("retries").alias("retry_count"),
        F.count(F.lit(1)).alias("input_urls"), F.count_if(c("good") > 0).alias("successful_urls"), F.count_if(c("bad") > 0).alias("failed_urls"),
    )


def unresolved_urls(outcomes: DataFrame) -> DataFrame:
    """The checkpoint of a run: its distinct failed urls, one row each."""
    return outcomes.filter(~c("ok")).select("run_id", trim_ws(to_text(c("url"))).alias("url")).filter("url <> ''").distinct()


def quality_gate(extracted: DataFrame, target: str, required: Sequence[str], bounds: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per target: completeness of required fields, share of repeated rows, row range check."""
    from pagegrid.functions.numbers import percent
    from pagegrid.functions.text import is_blank

    full = F.lit(True)
    for name in required:
        full = full & ~is_blank(c(name))
    content = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    per_row = extracted.groupBy(target, content.alias("__content")).agg(F.count(F.lit(1)).alias("n"), F.count_if(full).alias("full"))
    g = per_row.groupBy(target).agg(F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("distinct_rows"), F.sum("full").alias("complete"))
    j = g.join(bounds, target, "left")
    return j.select(
        target, "row_count", percent(c("complete"), c("row_count")).alias("completeness"), percent(c("row_count") - c("distinct_rows"), c("row_count")).alias("dedupe_rate"),
        F.coalesce(c("row_count").between(c("row_min"), c("row_max")), F.lit(False)).alias("in_range"),
    )
