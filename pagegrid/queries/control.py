"""Control tables: accounts, devices, jobs, schedules, payloads."""
from __future__ import annotations

from pyspark.sql import functions as F

from pagegrid.functions import times
from pagegrid.functions.jsonx import canonical, content_hash, flatten_paths, request_hash
from pagegrid.functions.urls import target_signature
from pagegrid.operators import accounts, jobs
from pagegrid.plans.registry import query
from pagegrid.plans.tables import NOW, spread
from pagegrid.queries import sqltext as s
from pagegrid.sources import records

c = F.col
_AT = "2024-01-20 00:00:00"
_TS = f"TIMESTAMP '{_AT}'"


def at():
    return F.lit(_AT).cast("timestamp")


# -- accounts ---------------------------------------------------------------------------------


@query("j01_dead_letters", "SELECT d.id AS job_id, d.account_id, 'E' || d.attempts AS reason_code, d.created_at, j.job_type, j.attempts, j.max_attempts FROM v_jobs d JOIN v_jobs j ON j.id = d.id WHERE d.status = 'dead_letter'")
def _(t):
    letters = t.v_jobs.filter("status = 'dead_letter'").select(c("id").alias("job_id"), "account_id", F.concat(F.lit("E"), "attempts").alias("reason_code"), "created_at")
    return jobs.dead_letter_list(letters, t.v_jobs)


@query("j02_active_licenses", "SELECT l.id AS license_id, l.account_id, a.tier, a.max_devices FROM v_licenses l JOIN v_accounts a ON a.id = l.account_id WHERE l.status = 'active' AND a.is_license_active")
def _(t):
    return accounts.active_license_accounts(t.v_licenses, t.v_accounts)


_LATEST = "SELECT account_id, id, status, created_at FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY created_at DESC NULLS LAST, id DESC) AS rn FROM v_licenses) WHERE rn = 1"


@query("j03_license_status", f"SELECT a.id, a.tier, a.max_devices, a.is_license_active, l.id AS license_id, coalesce(l.status, 'none') AS license_status FROM v_accounts a LEFT JOIN ({_LATEST}) l ON l.account_id = a.id")
def _(t):
    return accounts.license_status(t.v_accounts, t.v_licenses)


@query("w02_latest_child", _LATEST)
def _(t):
    return accounts.latest_child(t.v_licenses, "account_id", F.struct("created_at", "id"), ["id", "status", "created_at"])


_DEV = "SELECT a.id, a.tier, a.max_devices, (SELECT count(*) FROM v_devices d WHERE d.account_id = a.id) AS current_devices FROM v_accounts a"


@query("j04_device_counts", _DEV)
def _(t):
    return accounts.device_counts(t.v_accounts, t.v_devices).drop("at_cap")


@query("a23_device_caps", f"SELECT id, current_devices, current_devices >= max_devices AS at_cap FROM ({_DEV})")
def _(t):
    return accounts.device_counts(t.v_accounts, t.v_devices).select("id", "current_devices", "at_cap")


@query(
    "w04_device_admission",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY created_at, device_id) AS device_no FROM v_devices)
      SELECT account_id, device_id, device_no, device_no <= max_devices AS accepted, CASE WHEN device_no <= max_devices THEN last_seen_at END AS last_seen_at FROM n JOIN v_accounts a ON a.id = account_id""",
)
def _(t):
    uses = t.events.select(c("user_id").alias("account_id"), F.concat(F.lit("dev-"), c("event_id") % 7).alias("device_id"), c("ts").cast("timestamp").alias("ts"))
    return accounts.admit_devices(uses, t.v_accounts, "ts")


@query("q05_device_rename", "SELECT account_id, device_id, CASE WHEN account_id = 7 AND device_id = 'dev-3' THEN 'Laptop' ELSE device_id END AS device_name, account_id = 7 AND device_id = 'dev-3' AS matched FROM v_devices")
def _(t):
    d = t.v_devices.select("account_id", "device_id", c("device_id").alias("device_name"))
    return accounts.rename_device(d, 7, "dev-3", "Laptop")


@query("q05_device_remove", "SELECT account_id, device_id FROM v_devices d WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'error' AND value > 60 AND user_id = d.account_id AND 'dev-' || (event_id % 7) = d.device_id)")
def _(t):
    gone = t.events.filter("event_type = 'error' AND value > 60").select(c("user_id").alias("account_id"), F.concat(F.lit("dev-"), c("event_id") % 7).alias("device_id"))
    return accounts.remove_devices(t.v_devices, gone).select("account_id", "device_id")


@query("q05_device_list", "SELECT d.account_id, device_id, d.created_at, last_seen_at, max_devices FROM v_devices d JOIN v_accounts a ON a.id = d.account_id WHERE d.account_id = 7")
def _(t):
    return accounts.list_devices(t.v_devices, t.v_accounts, 7).select("account_id", "device_id", "created_at", "last_seen_at", "max_devices")


@query("p20_live_keys", f"SELECT event_id, user_id FROM events WHERE ts + INTERVAL 24 HOURS > {_TS}")
def _(t):
    keys = t.events.select("event_id", "user_id", (c("ts").cast("timestamp") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"))
    return accounts.live_keys(keys, at()).select("event_id", "user_id")


def _sessions(t):
    e = t.events.withColumn("at", c("ts").cast("timestamp"))
    return e.select("event_id", "user_id", F.when(c("event_type") == "error", c("at")).alias("revoked_at"), (c("at") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"))


@query("p20_live_sessions", f"SELECT event_id, user_id, ts + INTERVAL 10 DAYS AS expires_at FROM events WHERE event_type <> 'error' AND ts + INTERVAL 10 DAYS > {_TS}")
def _(t):
    return accounts.live_sessions(_sessions(t), at()).select("event_id", "user_id", "expires_at")


_POLICY_REQ = "SELECT user_id AS account_id, event_type IN ('signup', 'purchase') AS cloud, event_id % 2 = 0 AS webhook, ts AS at_ FROM events WHERE event_type IN ('signup', 'purchase', 'error')"


@query(
    "j12_policy_upsert",
    f"""WITH r AS ({_POLICY_REQ}), l AS (SELECT account_id, arg_max(cloud, at_) AS cloud, arg_max(webhook, at_) AS webhook, max(at_) AS at_, min(at_) FILTER (WHERE cloud) AS first_in, max(at_) FILTER (WHERE NOT cloud) AS last_out FROM r GROUP BY 1),
      p AS (SELECT c_custkey AS account_id, c_acctbal > 3000 AS cloud, false AS webhook, CASE WHEN c_acctbal > 3000 THEN TIMESTAMP '2023-12-01 00:00:00' END AS opted_in_at, TIMESTAMP '2023-12-01 00:00:00' AS updated_at FROM customer)
      SELECT coalesce(p.account_id, l.account_id) AS account_id, coalesce(l.cloud, p.cloud) AS cloud, CASE WHEN l.at_ IS NOT NULL THEN l.cloud AND l.webhook ELSE p.webhook END AS webhook, coalesce(p.opted_in_at, l.first_in) AS opted_in_at,
        CASE WHEN l.at_ IS NOT NULL AND NOT l.cloud THEN l.last_out END AS opted_out_at, coalesce(l.at_, p.updated_at) AS updated_at FROM p FULL JOIN l ON l.account_id = p.account_id""",
)
def _(t):
    then = F.lit("2023-12-01 00:00:00").cast("timestamp")
    rich = c("c_acctbal") > 3000
    stored = t.customer.select(c("c_custkey").alias("account_id"), rich.alias("cloud"), F.lit(False).alias("webhook"), F.when(rich, then).alias("opted_in_at"), F.lit(None).cast("timestamp").alias("opted_out_at"), then.alias("updated_at"))
    asked = t.events.filter("event_type IN ('signup', 'purchase', 'error')").select(
        c("user_id").alias("account_id"), c("event_type").isin("signup", "purchase").alias("cloud"), (c("event_id") % 2 == 0).alias("webhook"), c("ts").cast("timestamp").alias("at")
    )
    return accounts.upsert_policies(stored, asked)


@query(
    "j12_dead_letter_upsert",
    "SELECT id AS job_id, CASE WHEN status = 'dead_letter' THEN 'NEW' ELSE 'OLD' END AS reason_code FROM v_jobs WHERE status IN ('dead_letter', 'failed')",
)
def _(t):
    j = t.v_jobs.filter("status IN ('dead_letter', 'failed')")
    stored = j.select(c("id").alias("job_id"), F.lit("OLD").alias("reason_code"))
    return jobs.upsert_dead_letters(stored, j.filter("status = 'dead_letter'").select(c("id").alias("job_id"), F.lit("NEW").alias("reason_code")))


@query(
    "p17_opt_in_gate",
    """WITH p AS (SELECT c_custkey AS account_id, c_acctbal > 0 AS cloud, c_acctbal > 4000 AS webhook FROM customer WHERE c_mktsegment <> 'BUILDING')
      SELECT id, account_id, job_type = 'integration.webhook.deliver' AS needs_webhook, CASE WHEN NOT coalesce(cloud, false) THEN 'CLOUD_OPT_IN_REQUIRED' WHEN job_type = 'integration.webhook.deliver' AND NOT webhook THEN 'WEBHOOK_OPT_IN_REQUIRED' END AS code FROM v_jobs LEFT JOIN p USING (account_id)""",
)
def _(t):
    p = t.customer.filter("c_mktsegment <> 'BUILDING'").select(c("c_custkey").alias("account_id"), (c("c_acctbal") > 0).alias("cloud"), (c("c_acctbal") > 4000).alias("webhook"), F.lit(True).alias("metadata_only"))
    r = t.v_jobs.select("id", "account_id", (c("job_type") == "integration.webhook.deliver").alias("needs_webhook"))
    return accounts.opt_in_gate(r, p)


# -- jobs ----------------------------------------------------------------------------------------


@query("p22_due_jobs", f"SELECT id, status, next_run_at FROM v_jobs WHERE status IN ('queued', 'retrying') AND next_run_at <= {_TS}")
def _(t):
    return jobs.due_jobs(t.v_jobs, at()).select("id", "status", "next_run_at")


@query("p22_jobs_by_status", "SELECT id, account_id, status FROM v_jobs WHERE status IN ('failed', 'dead_letter')")
def _(t):
    return jobs.list_jobs(t.v_jobs, ["failed", "dead_letter"]).select("id", "account_id", "status")


@query("t04_due_first", f"SELECT id, next_run_at FROM v_jobs WHERE status IN ('queued', 'retrying') AND next_run_at <= {_TS} ORDER BY next_run_at, created_at, id LIMIT 50")
def _(t):
    return jobs.due_first(jobs.due_jobs(t.v_jobs, at()), 50).select("id", "next_run_at")


_STATS = f"""SELECT 'status:' || status AS measure, count(*) AS value FROM v_jobs GROUP BY status UNION ALL SELECT 'due_now', count(*) FROM v_jobs WHERE status IN ('queued', 'retrying') AND next_run_at <= {_TS} UNION ALL SELECT 'dead_letters', count(*) FROM v_jobs WHERE status = 'dead_letter'
  UNION ALL SELECT 'kind:' || schedule_kind, count(*) FROM v_schedules GROUP BY schedule_kind UNION ALL SELECT 'schedules_total', count(*) FROM v_schedules UNION ALL SELECT 'schedules_active', count(*) FROM v_schedules WHERE is_active UNION ALL SELECT 'schedules_due', count(*) FROM v_schedules WHERE is_active AND created_at <= {_TS}"""


def _stats(t):
    dead = t.v_jobs.filter("status = 'dead_letter'")
    return jobs.queue_stats(t.v_jobs, dead, at()).unionByName(jobs.schedule_stats(t.v_schedules.withColumn("next_run_at", c("created_at")), at()))


@query("a14_queue_stats", _STATS)
def _(t):
    return _stats(t).select("measure", c("value").cast("long").alias("value"))


@query("a15_queue_breaches", f"SELECT measure, value, CASE measure WHEN 'due_now' THEN 200 WHEN 'dead_letters' THEN 3 ELSE 200 END::BIGINT AS bound FROM ({_STATS}) WHERE (measure IN ('due_now', 'schedules_due') AND value > 200) OR (measure = 'dead_letters' AND value > 3)")
def _(t):
    return jobs.queue_breaches(_stats(t)).select("measure", c("value").cast("long").alias("value"), "bound")


def _outcomes(t):
    running_ = t.v_jobs.filter("status = 'running'")
    return running_.select(
        "id", (c("id") % 2 == 0).alias("ok"), (c("account_id") % 3 != 0).alias("retryable"), F.when(c("id") % 5 == 0, "HTTP_500").alias("error_code"), F.lit(None).cast("string").alias("error_message"), F.lit(0.5).alias("jitter"), c("created_at").alias("at")
    )


_EXP = "15 * pow(2, greatest(0, attempts - 1))"
_OUT = f"""WITH o AS (SELECT *, status = 'running' AS hit, id % 2 = 0 AS ok, account_id % 3 <> 0 AS retryable, CASE WHEN id % 5 = 0 THEN 'HTTP_500' END AS code FROM v_jobs), d AS (SELECT *, hit AND NOT ok AND (NOT retryable OR attempts >= max_attempts) AS terminal FROM o)"""


# jobs as stored, with the columns that outcomes, locks and cancellation touch
_FULL = "(SELECT *, CASE WHEN id % 4 = 0 THEN created_at END AS completed_at, CASE WHEN id % 6 = 0 THEN 'OLD' END AS last_error_code, CASE WHEN id % 6 = 0 THEN 'old error' END AS last_error, CASE WHEN status = 'running' THEN created_at END AS locked_at, CASE WHEN status = 'running' THEN 'w1' END AS locked_by, created_at AS updated_at FROM v_jobs)"


def _full_jobs(t):
    running = c("status") == "running"
    return t.v_jobs.select(
        "*", F.when(c("id") % 4 == 0, c("created_at")).alias("completed_at"), F.when(c("id") % 6 == 0, "OLD").alias("last_error_code"), F.when(c("id") % 6 == 0, "old error").alias("last_error"),
        F.when(running, c("created_at")).alias("locked_at"), F.when(running, "w1").alias("locked_by"), c("created_at").alias("updated_at"),
    )


_JOB_COLUMNS = ("id", "status", "next_run_at", "completed_at", "last_error_code", "last_error", "locked_at", "locked_by", "updated_at")


@query(
    "q02_apply_outcomes",
    f"""{_OUT.replace("FROM v_jobs)", f"FROM {_FULL})", 1)} SELECT id, CASE WHEN NOT hit THEN status WHEN ok THEN 'succeeded' WHEN terminal THEN 'dead_letter' ELSE 'retrying' END AS status,
      CASE WHEN NOT hit OR ok OR terminal THEN next_run_at ELSE {_TS} + to_seconds(least(900, greatest(15, CAST(floor({_EXP} + floor(0.5 * greatest(1, floor({_EXP} * 0.2)))) AS BIGINT)))) END AS next_run_at,
      CASE WHEN NOT hit THEN completed_at WHEN ok OR terminal THEN {_TS} END AS completed_at,
      CASE WHEN NOT hit THEN last_error_code WHEN NOT ok THEN coalesce(code, CASE WHEN terminal THEN 'JOB_FAILED' ELSE 'RETRYABLE_FAILURE' END) END AS last_error_code,
      CASE WHEN NOT hit THEN last_error WHEN ok THEN NULL WHEN terminal THEN 'Unknown job failure' ELSE 'Retryable job failure' END AS last_error,
      CASE WHEN NOT hit THEN locked_at END AS locked_at, CASE WHEN NOT hit THEN locked_by END AS locked_by, CASE WHEN hit THEN {_TS} ELSE updated_at END AS updated_at FROM d""",
)
def _(t):
    j, _letters = jobs.apply_outcomes(_full_jobs(t), _outcomes(t), at())
    return j.select(*_JOB_COLUMNS)


@query("q02_dead_letters", f"{_OUT} SELECT id AS job_id, account_id, coalesce(code, 'JOB_FAILED') AS reason_code, 'Job moved to dead letter queue' AS reason_message, {_TS} AS created_at FROM d WHERE terminal")
def _(t):
    return jobs.apply_outcomes(t.v_jobs, _outcomes(t), at())[1]


_LOCK = f"""WITH l AS (SELECT *, status = 'running' AND locked_at < {_TS} - INTERVAL 300 SECONDS AS expired FROM {_FULL}), k AS (SELECT *, coalesce(expired, false) AS hit, coalesce(expired, false) AND attempts >= max_attempts AS dead FROM l)"""


@query(
    "q03_expired_locks",
    f"""{_LOCK} SELECT id, CASE WHEN dead THEN 'dead_letter' WHEN hit THEN 'retrying' ELSE status END AS status, CASE WHEN hit AND NOT dead THEN {_TS} ELSE next_run_at END AS next_run_at,
      CASE WHEN dead THEN {_TS} ELSE completed_at END AS completed_at, CASE WHEN hit THEN 'LOCK_TIMEOUT' ELSE last_error_code END AS last_error_code,
      CASE WHEN dead THEN 'Job lock expired and attempts exhausted' WHEN hit THEN 'Recovered from expired lock' ELSE last_error END AS last_error,
      CASE WHEN NOT hit THEN locked_at END AS locked_at, CASE WHEN NOT hit THEN locked_by END AS locked_by, CASE WHEN hit THEN {_TS} ELSE updated_at END AS updated_at, hit AS recovered FROM k""",
)
def _(t):
    return jobs.recover_locks(_full_jobs(t), at())[0].select(*_JOB_COLUMNS, "recovered")


@query("q03_dead_letters", f"{_LOCK} SELECT id AS job_id, account_id, 'LOCK_TIMEOUT' AS reason_code, 'Job lock expired and attempts exhausted' AS reason_message, {_TS} AS created_at FROM k WHERE dead")
def _(t):
    return jobs.recover_locks(_full_jobs(t), at())[1]


@query(
    "q04_cancel_jobs",
    f"""WITH k AS (SELECT *, account_id % 2 = 0 AND status IN ('queued', 'retrying', 'running') AS hit FROM {_FULL})
      SELECT id, CASE WHEN hit THEN 'canceled' ELSE status END AS status, next_run_at, CASE WHEN hit THEN {_TS} ELSE completed_at END AS completed_at, last_error_code, last_error,
      CASE WHEN NOT hit THEN locked_at END AS locked_at, CASE WHEN NOT hit THEN locked_by END AS locked_by, CASE WHEN hit THEN {_TS} ELSE updated_at END AS updated_at, hit AS canceled FROM k""",
)
def _(t):
    ids = t.v_jobs.filter("account_id % 2 = 0").select("account_id", "id")
    return jobs.cancel(_full_jobs(t), ids, at()).select(*_JOB_COLUMNS, "canceled")


# -- schedules --------------------------------------------------------------------------------------


def _sched(t):
    return spread(t.v_schedules, "id").select(
        "*", F.lit("UTC").alias("timezone"), F.lit(5).alias("max_attempts"), F.array("target_url").alias("target_urls"), F.lit(None).cast("double").alias("max_urls"), F.to_json(F.struct(c("target_url").alias("targetUrl"))).alias("payload"),
        F.concat(F.lit("Watch "), c("account_id") % 50).alias("name"), c("created_at").alias("updated_at"),
    )


_SIG = "'monitor.page.diff|' || schedule_kind || '|' || CASE schedule_kind WHEN 'interval' THEN 'interval:' || interval_minutes ELSE 'cron:' || cron_expr || '|tz:UTC' END || '|attempts:5|signatureMode:target|payload:{\"targets\":[\"https://example.com/item/' || (account_id % 50) || '\"]}'"


@query("f36_schedule_signature", f"SELECT id, {_SIG} AS signature FROM v_schedules")
def _(t):
    return _sched(t).select("id", jobs.schedule_signature().alias("signature"))


def _signed(t):
    return _sched(t).withColumn("signature", jobs.schedule_signature())


_RANKED = f"SELECT *, count(*) OVER (PARTITION BY signature) AS total, row_number() OVER (PARTITION BY signature ORDER BY created_at, id) AS rn FROM (SELECT *, {_SIG} AS signature FROM v_schedules)"


@query("a17_duplicate_groups", f"SELECT 'sha256:' || left(sha256(signature), 24) AS signature, total, id AS keep_id FROM ({_RANKED}) WHERE rn = 1 AND total >= 2")
def _(t):
    return jobs.duplicate_groups(_signed(t), redact=True)


@query("w01_duplicate_keeper", f"SELECT signature, id AS keep_id FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY created_at DESC, id DESC) AS rd FROM ({_RANKED})) WHERE rd = 1 AND total >= 2")
def _(t):
    return jobs.duplicate_groups(_signed(t), keep="newest").select("signature", "keep_id")


@query("p23_pause_split", f"SELECT id, signature, rn = 1 AS keeps, CASE WHEN rn = 1 THEN NULL WHEN NOT is_active THEN 'already_inactive' ELSE 'dry_run' END AS action FROM ({_RANKED}) WHERE total >= 2")
def _(t):
    m = jobs.duplicate_members(_signed(t))
    return m.select("id", "signature", "keeps", F.when(c("keeps"), F.lit(None)).when(~c("is_active"), "already_inactive").otherwise("dry_run").alias("action"))


@query(
    "w10_pause_batches",
    f"""WITH p AS (SELECT id, is_active, row_number() OVER (ORDER BY signature, created_at, id) AS place, count(*) OVER () AS attempted FROM ({_RANKED}) WHERE total >= 2 AND rn > 1)
      SELECT id, CASE WHEN is_active THEN 'to_pause' ELSE 'already_inactive' END AS action, CAST(ceil(place / 20.0) AS BIGINT) AS batch, attempted, attempted > 100 AS blocked FROM p""",
)
def _(t):
    return jobs.pause_plan(jobs.duplicate_members(_signed(t)), apply=True, batch_size=20, max_pause=100)


@query(
    "p11_schedule_filter",
    f"SELECT id FROM v_schedules WHERE schedule_kind = 'interval' AND interval_minutes BETWEEN 1 AND 15 AND contains('watch ' || (account_id % 50), 'watch 1') AND floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 60000000.0) >= 14000000",
)
def _(t):
    return jobs.filter_schedules(_sched(t), "MONITOR.page.diff", "Watch 1", 15, 14_000_000, F.lit(NOW).cast("timestamp")).select("id")


_CRON_DAY = "generate_series(date_trunc('day', created_at), date_trunc('day', created_at) + INTERVAL 8 DAYS, INTERVAL 1 DAY)"


@query(
    "j09_next_cron",
    f"""WITH s AS (SELECT id, created_at FROM v_schedules WHERE schedule_kind = 'cron'), d AS (SELECT DISTINCT created_at FROM s), k AS (SELECT created_at, unnest({_CRON_DAY}) AS day FROM d),
      h AS (SELECT created_at, day + to_hours(hh) + to_minutes(mm) AS t FROM k, (SELECT unnest(range(8, 19)) AS hh), (SELECT unnest([0, 15, 30, 45]) AS mm) WHERE dayofweek(day) BETWEEN 1 AND 5),
      n AS (SELECT created_at, min(t) AS next_run_at FROM h WHERE t > created_at GROUP BY 1) SELECT s.id, n.next_run_at FROM s JOIN n ON n.created_at = s.created_at""",
)
def _(t):
    return jobs.next_cron_runs(_sched(t).filter("schedule_kind = 'cron'"), "created_at")


_ZONED = f"""WITH s AS (SELECT id, created_at FROM v_schedules WHERE schedule_kind = 'cron'), d AS (SELECT DISTINCT created_at FROM s), k AS (SELECT created_at, unnest({_CRON_DAY}) AS day FROM d),
  h AS (SELECT created_at, timezone('UTC', timezone('America/New_York', day + to_hours(hh) + to_minutes(mm))) AS t FROM k, (SELECT unnest(range(8, 19)) AS hh), (SELECT unnest([0, 15, 30, 45]) AS mm) WHERE dayofweek(day) BETWEEN 1 AND 5),
  n AS (SELECT created_at, min(t) AS next_run_at FROM h WHERE t > created_at GROUP BY 1) SELECT s.id, n.next_run_at FROM s JOIN n ON n.created_at = s.created_at"""


@query("d04_next_cron_zoned", _ZONED)
def _(t):
    return jobs.next_cron_runs(_sched(t).filter("schedule_kind = 'cron'").withColumn("timezone", F.lit("America/New_York")), "created_at")


@query(
    "d02_cron_fields",
    """SELECT id, CASE WHEN account_id % 50 < 5 THEN NULL ELSE array_to_string(range(0, 60, coalesce(interval_minutes, 15)), ',') END AS minutes, CASE WHEN account_id % 50 < 5 THEN NULL WHEN schedule_kind = 'cron' THEN '1,2,3,4,5' ELSE '0,5,6' END AS weekdays, account_id % 50 >= 5 AS valid FROM v_schedules""",
)
def _(t):
    made = F.concat(F.lit("0-59/"), "interval_minutes", F.lit(" ,3,/12 1,15 * 5-7"))
    expr = F.when(c("account_id") % 50 < 5, "61 8 * * 1").when(c("schedule_kind") == "cron", c("cron_expr")).otherwise(made)
    k = _sched(t).select("id", times.cron_fields(expr).alias("k"))

    def show(name):
        return F.when(c("k.valid"), F.array_join(F.transform(f"k.{name}", lambda v: v.cast("string")), ","))

    return k.select("id", show("minute").alias("minutes"), show("dow").alias("weekdays"), c("k.valid").alias("valid"))


def _due_sched(t):
    return _sched(t).withColumn("next_run_at", c("created_at"))


_DUE = f"SELECT * FROM v_schedules WHERE is_active AND created_at <= {_TS} ORDER BY created_at, id LIMIT 50"
_NEXT_CRON = "CASE schedule_kind WHEN 'interval' THEN {at} + to_minutes(interval_minutes) ELSE TIMESTAMP '2024-01-22 08:00:00' END"


@query(
    "q01_due_to_jobs",
    f"""SELECT id AS schedule_id, account_id, 'monitor.page.diff' AS job_type, 'queued' AS status, '{{"targetUrl":"' || target_url || '","schedule":{{"id":"' || id || '","name":"Watch ' || (account_id % 50) || '","workerId":"w1","triggeredAt":"2024-01-20T00:00:00.000Z"}}}}' AS payload, {_TS} AS next_run_at FROM ({_DUE})""",
)
def _(t):
    return jobs.trigger_due(_due_sched(t), at(), "2024-01-20T00:00:00.000Z", "w1", batch=50)[0]


@query(
    "q01_schedule_moves",
    f"WITH d AS ({_DUE}) SELECT s.id, CASE WHEN d.id IS NULL THEN s.created_at ELSE {_NEXT_CRON.format(at=_TS).replace('schedule_kind', 's.schedule_kind').replace('interval_minutes', 's.interval_minutes')} END AS next_run_at, CASE WHEN d.id IS NOT NULL THEN {_TS} END AS last_run_at FROM v_schedules s LEFT JOIN d ON d.id = s.id",
)
def _(t):
    return jobs.trigger_due(_due_sched(t), at(), "2024-01-20T00:00:00.000Z", "w1", batch=50)[1].select("id", "next_run_at", "last_run_at")


@query(
    "q04_toggle_schedules",
    f"SELECT id, NOT is_active AS is_active, CASE WHEN NOT is_active THEN {_NEXT_CRON.format(at=_TS)} ELSE created_at END AS next_run_at FROM v_schedules",
)
def _(t):
    sw = t.v_schedules.select("account_id", "id", (~c("is_active")).alias("active"), c("created_at").alias("at"))
    return jobs.toggle(_due_sched(t), sw, at()).select("id", "is_active", "next_run_at")


_SAVED = f"CASE WHEN NOT d.is_active THEN {_TS} + INTERVAL 365 DAYS ELSE {_NEXT_CRON.format(at=_TS).replace('schedule_kind', 'd.schedule_kind').replace('interval_minutes', 'd.interval_minutes')} END"


@query(
    "q04_save_schedules",
    f"""WITH o AS (SELECT * FROM v_schedules WHERE id % 3 <> 1), d AS (SELECT * REPLACE (id % 5 <> 0 AS is_active) FROM v_schedules WHERE id % 2 = 0)
      SELECT coalesce(o.id, d.id) AS id, CASE WHEN d.id IS NOT NULL THEN d.is_active ELSE o.is_active END AS is_active, coalesce(d.schedule_kind, o.schedule_kind) AS schedule_kind,
        CASE WHEN d.id IS NOT NULL THEN 'New name' ELSE 'Watch ' || (o.account_id % 50) END AS name, CASE WHEN d.id IS NULL THEN o.created_at ELSE {_SAVED} END AS next_run_at,
        coalesce(o.created_at, {_TS}) AS created_at, CASE WHEN d.id IS NULL THEN o.created_at ELSE {_TS} END AS updated_at, coalesce(o.max_attempts, 0) AS max_attempts FROM (SELECT *, 5 AS max_attempts FROM o) o FULL JOIN d ON d.id = o.id""",
)
def _(t):
    stored = _due_sched(t).filter("id % 3 <> 1")
    given = _due_sched(t).filter("id % 2 = 0").select(
        "id", "account_id", (c("id") % 5 != 0).alias("is_active"), "schedule_kind", "interval_minutes", "cron_expr", "timezone", F.lit("New name").alias("name"), "next_run_at"
    )
    saved = jobs.save_schedules(stored, given, at())
    return saved.select("id", "is_active", "schedule_kind", "name", "next_run_at", "created_at", "updated_at", F.coalesce("max_attempts", F.lit(0)).alias("max_attempts"))


@query(
    "q04_schedule_input",
    """SELECT id, CASE WHEN account_id % 50 = 7 THEN 'INVALID_SCHEDULE_NAME' WHEN schedule_kind = 'cron' THEN NULL WHEN interval_minutes > 20 THEN 'INVALID_INTERVAL_MINUTES' END AS code FROM v_schedules""",
)
def _(t):
    s_ = _sched(t).withColumn("name", F.when(c("account_id") % 50 == 7, F.repeat(F.lit("x"), F.lit(121))).otherwise(c("name"))).withColumn("interval_minutes", F.when(c("interval_minutes") > 20, 10081).otherwise(c("interval_minutes")))
    return s_.select("id", jobs.schedule_input_error().alias("code"))


@query(
    "s18_run_summary",
    f"""SELECT '2024-02-01T00:00:00Z' AS generated_at, (SELECT count(*) FROM v_schedules) AS fetched, (SELECT count(*) FROM ({_RANKED}) WHERE total >= 2) AS matched, (SELECT count(*) FROM ({_RANKED}) WHERE total >= 2 AND rn = 1) AS duplicate_groups, '{{"intervalLte":"15","jobType":null}}' AS filters""",
)
def _(t):
    signed = _signed(t)
    return records.run_summary(signed, jobs.duplicate_members(signed), jobs.duplicate_groups(signed), {"jobType": "", "intervalLte": 15}, "2024-02-01T00:00:00Z")


# -- payloads and JSON ---------------------------------------------------------------------------------


@query("f29_canonical_json", """SELECT event_id, '{"a":{"k":' || regexp_extract(props, '[0-9]+') || ',"z":[3,1,{"b":null,"c":"x"}]},"b":"' || event_type || '","u":' || user_id || '}' AS canonical FROM events""")
def _(t):
    k = F.regexp_extract("props", "[0-9]+", 0)
    raw = F.concat(F.lit('{ "u": '), "user_id", F.lit(', "b": "'), "event_type", F.lit('", "a": {"z": [3, 1, {"c": "x", "b": null}], "k": '), k, F.lit("}}"))
    return t.events.select("event_id", canonical(raw).alias("canonical"))


@query(
    "f31_object_paths",
    """WITH k AS (SELECT event_id, user_id, event_type, regexp_extract(props, '[0-9]+') AS k FROM events)
      SELECT event_id, 'a.k' AS path, k AS value FROM k UNION ALL SELECT event_id, 'a.z', '[1,{"c":"x"}]' FROM k UNION ALL SELECT event_id, 'a.n', 'null' FROM k UNION ALL SELECT event_id, 'b', '"' || event_type || '"' FROM k UNION ALL SELECT event_id, 'c.d.e', CAST(user_id AS VARCHAR) FROM k""",
)
def _(t):
    k = F.regexp_extract("props", "[0-9]+", 0)
    raw = F.concat(F.lit('{"a": {"k": '), k, F.lit(', "n": null, "z": [1, {"c": "x"}]}, "b": "'), "event_type", F.lit('", "c": {"d": {"e": '), "user_id", F.lit("}}}"))
    p = flatten_paths(t.events.select("event_id", F.parse_json(raw).alias("v")), "v", ["event_id"])
    return p.select("event_id", "path", F.coalesce(F.to_json("value"), F.lit("null")).alias("value"))


@query(
    "f35_hashes",
    """SELECT event_id, sha256('{"a":' || user_id || ',"b":"' || event_type || '"}') AS row_hash, sha256('{"a":' || user_id || ',"n":[{"c":1}]}') AS request_hash FROM events""",
)
def _(t):
    row = F.concat(F.lit('{"b": "'), "event_type", F.lit('", "a": '), "user_id", F.lit("}"))
    req = F.concat(F.lit('{"n": [{"idempotencyKey": {"x": '), "event_id", F.lit('}, "c": 1}], "idempotencyKey": "k", "a": '), "user_id", F.lit("}"))
    return t.events.select("event_id", content_hash(row).alias("row_hash"), request_hash(req).alias("request_hash"))


@query(
    "p16_payload_validation",
    """SELECT id, CASE job_type WHEN 'monitor.page.diff' THEN attempts IN (0, 1) WHEN 'extraction.page.summary' THEN attempts < 4 ELSE attempts < 3 END AS ok, CASE job_type WHEN 'monitor.page.diff' THEN CASE attempts WHEN 2 THEN 'Monitor payload targetUrl is required' WHEN 3 THEN 'Monitor payload targetUrl must be a valid http/https URL' WHEN 4 THEN 'Monitor payload supports single targetUrl only' WHEN 5 THEN 'Monitor payload compare must be an object' END
      WHEN 'extraction.page.summary' THEN CASE attempts WHEN 4 THEN 'Extraction payload URLs must be valid http/https URLs' WHEN 5 THEN 'Extraction payload requires targetUrl or targetUrls' END
      ELSE CASE attempts WHEN 3 THEN 'Webhook payload eventType is required' WHEN 4 THEN 'Webhook payload targetUrl must be a valid http/https URL' WHEN 5 THEN 'Webhook payload must be an object' END END AS message FROM v_jobs""",
)
def _(t):
    ok = F.concat(F.lit('{"targetUrl": "https://example.com/'), "id", F.lit('", "eventType": "page.changed"}'))
    monitor = (
        F.when(c("attempts") == 2, F.lit('{"eventType": "x"}')).when(c("attempts") == 3, F.lit('{"targetUrl": "ftp://example.com"}')).when(c("attempts") == 4, F.lit('{"targetUrl": "https://example.com", "targetUrls": [" a "]}'))
        .when(c("attempts") == 5, F.lit('{"targetUrl": "https://example.com", "compare": [1]}')).otherwise(ok)
    )
    extraction = F.when(c("attempts") == 4, F.lit('{"targetUrls": ["https://a.example", "nope"]}')).when(c("attempts") == 5, F.lit("{}")).otherwise(ok)
    webhook = F.when(c("attempts") == 3, F.lit('{"targetUrl": "https://a.example", "eventType": "x"}')).when(c("attempts") == 4, F.lit('{"targetUrl": "example.com"}')).when(c("attempts") == 5, F.lit("[1]")).otherwise(ok)
    payload = F.when(c("job_type") == "monitor.page.diff", monitor).when(c("job_type") == "extraction.page.summary", extraction).otherwise(webhook)
    return jobs.validate_payloads(t.v_jobs.withColumn("payload", payload)).select("id", "ok", "message")


@query(
    "p18_policy_audit",
    """SELECT event_id, event_type NOT IN ('view', 'click') AS ok, CASE WHEN event_type IN ('view', 'click') THEN 'METADATA_ONLY_POLICY_VIOLATION' END AS code, CASE event_type WHEN 'view' THEN 'meta.browser' WHEN 'click' THEN 'items[1].Raw-HTML|items[1].Raw-HTML.csvUrl' ELSE '' END AS blocked FROM events""",
)
def _(t):
    p = (
        F.when(c("event_type") == "view", F.concat(F.lit('{"meta": {"browser": '), "user_id", F.lit("}}")))
        .when(c("event_type") == "click", F.concat(F.lit('{"items": [{"a": '), "user_id", F.lit('}, {"Raw-HTML": {"csvUrl": "x"}}]}')))
        .otherwise(F.concat(F.lit('{"count": '), "user_id", F.lit("}")))
    )
    a = jobs.policy_audit(t.events.select("event_id", p.alias("payload")), "event_id")
    return a.select("event_id", "ok", "code", F.array_join("blocked_paths", "|").alias("blocked"))


@query(
    "f41_config_summary",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'list' WHEN 'click' THEN 'email' ELSE 'pages' END AS tool_type, CASE WHEN event_type = 'click' THEN 'EXTRACT_PAGES_EMAIL' ELSE '' END AS action_type, 'https://example.com/' || user_id AS start_url, CAST(2 AS BIGINT) AS url_count, CAST(user_id AS BIGINT) AS max_retries, event_type <> 'error' AS wait_load, 'balanced' AS profile FROM events""",
)
def _(t):
    cfg = F.concat(
        F.lit('{"urls": ["https://example.com/'), "user_id", F.lit('", "b"], "pageActionType": "'), F.when(c("event_type") == "click", "extract_pages_email").otherwise(""),
        F.lit('", "queue": {"maxRetries": '), "user_id", F.lit(', "waitForPageLoad": '), F.when(c("event_type") == "error", "false").otherwise("true"), F.lit(', "reliability": {"profile": "balanced"}}}'),
    )
    runner = F.when(c("event_type") == "view", "listExtractor").otherwise("pageExtractor")
    r = jobs.config_summary(t.events.select("event_id", cfg.alias("config"), runner.alias("runner_type")))
    return r.select("event_id", "tool_type", "action_type", "start_url", "url_count", c("maxRetries").alias("max_retries"), c("waitForPageLoad").alias("wait_load"), "profile")


def _attempts(t):
    return t.events.select(c("user_id").alias("run_id"), F.concat(F.lit(" https://example.com/"), c("event_id") % 20).alias("url"), (c("event_type") != "error").alias("ok"), F.length("event_type").alias("retries"))


@query(
    "a21_batch_summary",
    """SELECT user_id AS run_id, count(*) AS attempted, count(*) FILTER (WHERE event_type <> 'error') AS success_count, count(*) FILTER (WHERE event_type = 'error') AS failure_count, CAST(sum(length(event_type)) AS BIGINT) AS retry_count, count(DISTINCT event_id % 20) AS input_urls,
      count(DISTINCT CASE WHEN event_type <> 'error' THEN event_id % 20 END) AS successful_urls, count(DISTINCT CASE WHEN event_type = 'error' THEN event_id % 20 END) AS failed_urls FROM events GROUP BY 1""",
)
def _(t):
    return jobs.batch_summary(_attempts(t))


@query("u06_checkpoint_urls", "SELECT DISTINCT user_id AS run_id, 'https://example.com/' || (event_id % 20) AS url FROM events WHERE event_type = 'error'")
def _(t):
    return jobs.unresolved_urls(_attempts(t))


@query(
    "a31_quality_gate",
    f"""WITH g AS (SELECT o_orderpriority AS target, count(*) AS row_count, count(*) FILTER (WHERE o_orderstatus <> 'P') AS complete, count(DISTINCT (o_custkey, o_orderstatus)) AS distinct_rows FROM orders GROUP BY 1)
      SELECT target, row_count, {s.pct('complete', 'row_count')} AS completeness, {s.pct('row_count - distinct_rows', 'row_count')} AS dedupe_rate, row_count BETWEEN 1 AND 2990 AS in_range FROM g""",
)
def _(t):
    e = t.orders.select(c("o_orderpriority").alias("target"), F.when(c("o_orderstatus") != "P", c("o_orderstatus")).otherwise(" ").alias("status"), "o_custkey")
    bounds = e.select("target").distinct().withColumn("row_min", F.lit(1)).withColumn("row_max", F.lit(2990))
    return jobs.quality_gate(e, "target", ["status"], bounds, ["o_custkey", "status"])
