"""Control tables: cron, back-off, monitors, payload rules, idempotency, spend, request windows."""
import datetime as dt
import random

from pyspark.sql import functions as F

from pagegrid.functions import times
from pagegrid.functions.numbers import clamp_int
from pagegrid.operators import jobs, metrics, monitor, runs

c = F.col


def ts(text):
    return dt.datetime.fromisoformat(text)


def next_minute(expr, zone, start):
    """Minute-by-minute reference walk."""
    from zoneinfo import ZoneInfo

    def field(spec, lo, hi, dow=False):
        out = set()
        for seg in spec.split(","):
            base, _, step = seg.partition("/")
            vals = list(range(lo, hi + 1)) if base in ("*", "") else list(range(*(lambda a: (int(a[0]), int(a[-1]) + 1))(base.split("-"))))
            vals = sorted({v % 7 if dow else v for v in vals})
            out |= set(vals[:: int(step)] if step else vals)
        return out

    mi, h, d, m, w = [field(s, lo, hi, i == 4) for i, (s, lo, hi) in enumerate(zip(expr.split(), (0, 0, 1, 1, 0), (59, 23, 31, 12, 7)))]
    at = start.replace(second=0, microsecond=0)
    for _ in range(525_600):
        at += dt.timedelta(minutes=1)
        p = at.replace(tzinfo=dt.timezone.utc).astimezone(ZoneInfo(zone))
        if p.minute in mi and p.hour in h and p.day in d and p.month in m and p.isoweekday() % 7 in w:
            return at
    return None


CRON = [
    ("*/15 8-18 * * 1-5", "UTC", "2024-01-05 18:50:30"), ("30 2 * * *", "America/New_York", "2024-03-09 08:00:00"), ("30 1 * * *", "America/New_York", "2024-11-03 05:30:00"),
    ("30 1 * * *", "America/New_York", "2024-11-03 05:45:00"), ("0 0 29 2 *", "UTC", "2023-03-01 00:00:00"), ("5/10 * * * *", "UTC", "2024-01-01 00:05:00"), ("0 12 13 * 5", "Asia/Kolkata", "2024-01-01 00:00:00"),
    ("* * * * *", "Australia/Lord_Howe", "2024-04-06 14:59:00"), ("0 9 * * 7", "Europe/Berlin", "2024-03-30 10:00:00"), ("59 23 31 12 *", "Pacific/Auckland", "2024-01-01 00:00:00"), ("0 0 31 2 *", "UTC", "2024-01-01 00:00:00"),
    ("15,45 2-3 8-14 3 0", "America/New_York", "2024-03-01 00:00:00"),
]


def test_next_cron_run_equals_minute_walk(spark):
    df = spark.createDataFrame([(i, e, z, ts(f)) for i, (e, z, f) in enumerate(CRON)], "id int, cron_expr string, timezone string, from_ts timestamp")
    got = {r["id"]: r["next_run_at"] for r in jobs.next_cron_runs(df, "from_ts").collect()}
    for i, (e, z, f) in enumerate(CRON):
        assert got[i] == next_minute(e, z, ts(f)), (e, z, f, got[i])


def test_cron_errors(spark):
    bad = ["60 * * * *", "* * * *", "5-1 * * * *", "*/0 * * * *", "a * * * *", "* * 0 * *", "* * * JAN *", ", * * * *"]
    good = ["0,30 */6 1-7 * 5-7", "/20 * * * *", "1,, * * * *"]
    df = spark.createDataFrame([(x,) for x in bad + good], "e string").select("e", times.cron_fields(c("e")).alias("k"))
    valid = {r["e"]: r["k"]["valid"] for r in df.collect()}
    assert [valid[x] for x in bad] == [False] * len(bad) and all(valid[x] for x in good)


def test_backoff_profiles(spark):
    def delay(strategy, attempt, mode="none", jitter=0.0):
        return spark.range(1).select(times.retry_delay_ms(F.lit(strategy), F.lit(400), F.lit(attempt), F.lit(200), F.lit(900), F.lit(mode), F.lit(1000), F.lit(jitter))).first()[0]

    assert (delay("linear", 2), delay("linear", 3), delay("exponential", 2), delay("fixed", 5)) == (800, 900, 800, 400)
    assert delay("fixed", 1, "bounded", 0.999) == 400 + 449 and delay("fixed", 1, "full", 0.999) == 900


def test_option_bounds(spark):
    df = spark.createDataFrame([("99",), ("x",), (None,), ("-4.7",)], "v string")
    assert [r[0] for r in df.select(clamp_int(c("v"), 1, 3, 1)).collect()] == [3, 1, 1, 1]


def test_monitor_runs_fixture(spark):
    data = [(i, 7, "k", ts(f"2024-01-0{i} 00:00:00"), "https://m.example", "T", 3) for i in range(1, 5)]
    df = spark.createDataFrame(data, "run_id int, account_id int, monitor_key string, run_at timestamp, target_url string, title string, link_count int")
    full, part = monitor.snapshot_json(df), monitor.snapshot_json(df, {"includeTitle": False})
    snaps = df.withColumn("snapshot", F.when(c("run_id") == 3, part).otherwise(full)).withColumn("snapshot_hash", monitor.snapshot_hash(c("snapshot")))
    h = {r["run_id"]: r for r in monitor.history(snaps.select("run_id", "account_id", "monitor_key", "run_at", "snapshot_hash")).collect()}
    assert [h[i]["changed"] for i in (1, 2, 3, 4)] == [False, False, True, True]
    assert h[1]["first_run"] and h[4]["run_count"] == 4 and h[3]["change_count"] == 1
    cur, prev = snaps.filter("run_id = 3"), snaps.filter("run_id = 2")
    d = [(r["field"], r["previous"], r["current"]) for r in monitor.field_diff(cur, prev, monitor.KEYS).collect()]
    assert d == [("title", "T", None)]
    assert monitor.field_diff(cur, prev.limit(0), monitor.KEYS).count() == 0
    long = spark.createDataFrame([("x" * 281,), ("x" * 280,)], "v string").select(F.length(monitor.clip(c("v"), 280)).alias("n"))
    assert [r["n"] for r in long.collect()] == [283, 280]


def test_policy_matches_inside_words(spark):
    df = spark.createDataFrame([(1, '{"meta":{"browser":"x"}}'), (2, '{"ok":1,"list":[{"a":null}]}'), (3, '{"a":"' + "y" * 33_000 + '","html":1}')], "id int, payload string")
    r = {x["id"]: x for x in jobs.policy_audit(df, "id").collect()}
    assert r[1]["blocked_paths"] == ["meta.browser"] and r[2]["ok"] and r[3]["code"] == "METADATA_PAYLOAD_TOO_LARGE" and r[3]["blocked_paths"] == ["html"]


def test_monitor_payload_rules(spark):
    base = '"targetUrl":"https://a.example"'
    cases = [
        (f'{{{base},"monitorKey":"a b"}}', "Monitor payload monitorKey must match [a-zA-Z0-9._:-]{3,120}"), (f'{{{base},"notify":[]}}', "Monitor payload notify must be an object"),
        (f'{{{base},"notify":{{"webhook":{{"targetUrl":"x"}}}}}}', "Monitor notify webhook targetUrl must be a valid http/https URL"),
        (f'{{{base},"notify":{{"webhook":{{{base},"timeoutMs":999}}}}}}', "Monitor notify webhook timeoutMs must be >= 1000"),
        (f'{{{base},"notify":{{"webhook":{{{base},"secretRef":{{"provider":"p"}}}}}}}}', "Monitor notify webhook secretRef requires provider and secretName"),
        (f'{{{base},"notify":{{"webhook":{{{base},"eventType":"ok","timeoutMs":1000,"secretRef":{{"provider":"p","secretName":"s"}}}}}}}}', None), ("nope", "Monitor payload must be an object"),
    ]
    df = spark.createDataFrame([(i, "monitor.page.diff", p) for i, (p, _) in enumerate(cases)], "id int, job_type string, payload string")
    got = {r["id"]: r["message"] for r in jobs.validate_payloads(df).collect()}
    assert [got[i] for i in range(len(cases))] == [m for _, m in cases]


def test_spend_anomaly(spark):
    def flags(values):
        days = spark.createDataFrame([(dt.date(2024, 1, i + 1), float(v)) for i, v in enumerate(values)], "day date, usd double")
        return metrics.daily_anomaly(days).orderBy("day").collect()[-1]

    assert flags([1, 1, 1])["reason"] == "not_enough_samples"
    assert flags([2, 2, 2, 3.1])["is_anomaly"] and not flags([2, 2, 2, 3.0])["is_anomaly"] and flags([2, 2, 2, 3.1])["z_score"] is None
    assert flags([1, 2, 3, 4.6])["is_anomaly"] and not flags([1, 2, 3, 4.4])["is_anomaly"]


def test_request_windows(spark):
    rows = [("2024-01-01 00:00:00", "GET", "/healthz", 302, 5.0), ("2024-01-01 00:30:00", "POST", "/api/auth/login", 500, 10.0), ("2023-12-31 22:00:00", "GET", "/x", 200, 1.0)]
    df = spark.createDataFrame([(ts(a), *r) for a, *r in rows], "ts timestamp, method string, path string, status_code int, duration_ms double")
    s = metrics.request_summary(metrics.in_window(df, "2024-01-01 00:45:00")).first()
    assert (s["requests_total"], s["status_2xx"], s["status_5xx"], s["error_rate_percent"]) == (2, 1, 1, 50.0)
    assert metrics.running_totals(df).first()["status_2xx"] == 1
    empty = metrics.request_summary(df.limit(0)).first()
    assert empty["requests_total"] == 0 and empty["error_rate_percent"] is None
    levels = {r["name"]: r for r in metrics.service_levels(df.filter("path = '/x'")).collect()}
    assert levels["auth_p95_ms"]["samples"] == 0 and levels["auth_p95_ms"]["value"] is None


def test_lifecycle(spark):
    steps = ["running", "stopping", "stopped", "idle", "completed"]
    df = spark.createDataFrame([(i, "r", ts(f"2024-01-01 00:0{i}:00"), s) for i, s in enumerate(steps)], "event_id int, automation_id string, emitted_at timestamp, state string")
    assert [r["legal"] for r in runs.check_transitions(df).orderBy("event_id").collect()] == [True, True, True, True, False]


def test_due_schedule_with_unsolvable_cron(spark):
    df = spark.createDataFrame(
        [(1, 1, "n", True, "cron", None, "0 0 31 2 *", "UTC", "monitor.page.diff", "https://a.example", ts("2024-01-01 00:00:00"), ts("2023-01-01 00:00:00"))],
        "id int, account_id int, name string, is_active boolean, schedule_kind string, interval_minutes int, cron_expr string, timezone string, target_job_type string, target_url string, next_run_at timestamp, created_at timestamp",
    )
    new, moved = jobs.trigger_due(df, F.lit("2024-01-01 00:10:00").cast("timestamp"), "t", "w")
    row = moved.first()
    assert new.count() == 0 and row["next_run_at"] == ts("2024-01-01 00:15:00") and row["last_error"]


def nested(depth, inner):
    text = inner
    for k in range(depth):
        text = f'{{"o{k}": {text}}}' if k % 3 else f'[{text}]'
    return text


def test_policy_sees_every_depth(spark):
    df = spark.createDataFrame([(d, nested(d, '{"csv": 1}')) for d in range(31)], "id int, payload string")
    got = {r["id"]: r for r in jobs.policy_audit(df, "id").collect()}
    assert [d for d in range(31) if got[d]["ok"]] == []
    assert all(len(got[d]["blocked_paths"]) == 1 and got[d]["blocked_paths"][0].endswith("csv") for d in range(31))


def test_field_diff_sees_every_depth(spark):
    def snap(v):
        text = v
        for k in range(30):
            text = f'{{"k{k}": {text}}}'
        return text

    now, old = (spark.createDataFrame([(1, "m", snap(v))], "account_id int, monitor_key string, snapshot string") for v in ('[1.50, {"a": 2}]', '"x"'))
    (row,) = monitor.field_diff(now, old, monitor.KEYS).collect()
    assert row["field"].count(".") == 29 and row["previous"] == "x" and row["current"] == '[1.5,{"a":2}]'


def test_cron_across_skipped_and_repeated_time(spark):
    from zoneinfo import ZoneInfo

    # a zone that skips a whole day, one that repeats a day, short and odd clock changes
    starts = {"Pacific/Apia": dt.datetime(2011, 12, 29), "Pacific/Kwajalein": dt.datetime(1969, 9, 29), "Australia/Lord_Howe": dt.datetime(2024, 4, 6), "Europe/Berlin": dt.datetime(2024, 10, 26), "America/New_York": dt.datetime(2024, 3, 9), "UTC": dt.datetime(2024, 2, 28)}
    rnd = random.Random(3)
    cases, want = [], []
    for zone, base in starts.items():
        for _ in range(12):
            start = int(base.replace(tzinfo=dt.timezone.utc).timestamp()) + 60 * rnd.randrange(2880)
            minutes, hours = sorted(rnd.sample(range(60), rnd.choice([1, 3, 40]))), sorted(rnd.sample(range(24), rnd.choice([1, 4, 24])))
            days = rnd.choice([list(range(1, 32)), sorted(rnd.sample(range(1, 32), 9))])
            local = [(start + 60 * i, dt.datetime.fromtimestamp(start + 60 * i, ZoneInfo(zone))) for i in range(1, 4 * 1440)]
            want.append(next((u for u, t in local if t.hour in hours and t.minute in minutes and t.day in days), None))
            cases.append((len(cases), f"{','.join(map(str, minutes))} {','.join(map(str, hours))} {','.join(map(str, days))} * *", zone, dt.datetime.fromtimestamp(start, dt.timezone.utc)))
    df = spark.createDataFrame(cases, "id int, cron_expr string, timezone string, from_ts timestamp")
    solved = jobs.next_cron_runs(df, "from_ts", 4 * 1440 - 1).select("id", F.unix_seconds("next_run_at").alias("at"))
    got = {r["id"]: r["at"] for r in solved.collect()}
    assert [got[i] for i in range(len(cases))] == want
    assert "Python" not in solved._jdf.queryExecution().toString() and "Arrow" not in solved._jdf.queryExecution().toString()


def test_cron_zones(spark):
    rows = [(1, "0 9 * * *", "Nowhere/Else"), (2, "0 9 * * *", "UTC+5"), (3, "0 9 * * *", "-3:30"), (4, "0 9 * * *", None), (5, "0 9 * *", "UTC"), (6, "0 9 * * *", " "), (7, "0 9 * * *", "+02:00"), (8, None, "UTC")]
    df = spark.createDataFrame([(i, e, z, ts("2024-01-01 00:00:00")) for i, e, z in rows] + [(9, "0 9 * * *", "UTC", None)], "id int, cron_expr string, timezone string, from_ts timestamp")
    got = {r["id"]: r["next_run_at"] and r["next_run_at"].strftime("%d %H:%M") for r in jobs.next_cron_runs(df, "from_ts").collect()}
    assert got == {1: None, 2: "01 04:00", 3: "01 12:30", 4: "01 09:00", 5: None, 6: "01 09:00", 7: "01 07:00", 8: None, 9: None}
    assert jobs.next_cron_runs(df.limit(0), "from_ts").count() == 0


def test_signatures_of_members_are_made_once(spark):
    # the groups and both sides of the join made them again
    made = spark.sparkContext.accumulator(0)

    def sign(k):
        made.add(1)
        return f"s{k % 3}"

    rows = spark.createDataFrame([(k, None, True) for k in range(7)] + [(9, None, False)], "id long, created_at timestamp, is_active boolean").withColumn("signature", F.udf(sign)("id"))
    got = sorted((r["id"], r["signature"], r["keeps"]) for r in jobs.duplicate_members(rows).collect())
    assert got == [(k, f"s{k % 3}", k < 3) for k in (0, 1, 2, 3, 4, 5, 6, 9)]
    assert made.value == 8
