"""Streams over several micro-batches: late rows, forgotten keys, bounded memory."""
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagegrid.streaming import memory, stateful
from pagegrid.streaming.run import settle

c = F.col
HOUR = 3_600_000


@pytest.fixture
def batches(spark, tmp_path):
    """A stream that takes in one list of rows after the other."""

    def make(parts, schema):
        for k, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            for name in os.listdir(f"{tmp_path}/in"):  # files are taken by age
                path = f"{tmp_path}/in/{name}"
                if os.path.getmtime(path) > 1_000_000:
                    os.utime(path, (k + 1, k + 1))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    return make


def test_late_requests_are_labelled_in_order(spark, batches):
    schema = "request_id long, scope string, key string, at_ms long, request_hash string"
    parts = [
        [(1, "s", "a", 10_000, "x"), (2, "s", "a", 30_000, "y")],
        [(3, "s", "a", 20_000, "x"), (4, "s", "a", 5_000, "y"), (5, "s", "b", 6_000, "z")],  # the first of the key comes late
        [(6, "s", "a", 25 * HOUR, "q"), (7, "s", "b", 24 * HOUR + 5_000, "z")],  # a is over, b is not
        [(8, "s", "end", 60 * HOUR, "-")],
    ]
    got = {r["request_id"]: r["label"] for r in settle(stateful.idempotent_requests(batches(parts, schema), late="1 minute"), "late").collect()}
    assert got == {4: "first", 1: "conflict", 3: "conflict", 2: "replay", 5: "first", 7: "replay", 6: "first"}


def test_late_alerts_count_in_order(spark, batches):
    parts = [[(1, "a", 20_000)], [(2, "a", 10_000), (3, "a", 26_000)], [(4, "a", 70_000)], [(5, "end", 10 * HOUR)]]
    got = sorted((r["alert_id"], r["key"], r["at_ms"]) for r in settle(stateful.throttle_alerts(batches(parts, "alert_id long, key string, at_ms long"), 15_000, "1 minute"), "alerts").collect())
    assert got == [(2, "a", 10_000), (3, "a", 26_000), (4, "a", 70_000)]


def test_keys_are_forgotten():
    class State:
        def __init__(self, mark):
            self.exists, self.mark, self.value, self.hasTimedOut = False, mark, None, False

        def getCurrentWatermarkMs(self):
            return self.mark

        def update(self, value):
            self.exists, self.value = True, value

        def remove(self):
            self.exists, self.value = False, None

        def setTimeoutTimestamp(self, at):
            assert at > self.mark
            self.wakes = at

        get = property(lambda self: self.value)

    s = State(100)
    stateful._keep(s, "h 50", [], 2, 500)
    assert s.exists and s.wakes == 500
    stateful._keep(s, "h 50", [(150, 1), (170, 2)], 2, 500)
    assert s.wakes == 149 and stateful._in_order(s, iter(()), 2) == ("h 50", [], [(150, 1), (170, 2)])
    s.mark = 160
    assert stateful._in_order(s, iter(()), 2) == ("h 50", [(150, 1)], [(170, 2)])
    stateful._keep(s, None, [], 2, None)
    assert not s.exists


def test_memory_forgets_the_oldest(spark, tmp_path):
    runs = [["a", "b", "a", ""], ["c", "a", "d"], ["b", "e", "", "c"], ["a", "b"]]
    seen, want, n = [], [], 0
    for k, keys in enumerate(runs):
        accepted = 0
        before = list(seen)
        for key in dict.fromkeys(keys):
            if key and key not in before:
                seen.append(key)
                accepted += 1
        accepted += keys.count("")
        want.append((k, accepted, len(keys) - accepted))
        seen = seen[-3:]
        rows = spark.createDataFrame([("s", key, n + i) for i, key in enumerate(keys)], "scope string, key string, n long")
        n += len(keys)
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        memory.seen_memory(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/base", "scope", "key", "n", limit=3)
    got = spark.read.parquet(f"{tmp_path}/base/counters").orderBy("batch_id").collect()
    assert [(r["batch_id"], r["accepted"], r["skipped"]) for r in got] == want
    last = spark.read.parquet(f"{tmp_path}/base/memory/batch_id=3").orderBy("run", "at").collect()
    assert [r["key"] for r in last] == seen


def test_many_jobs_take_few_calls(spark, batches):
    # a bucket of jobs shares a state; 3,000 jobs went through 3,000 calls before
    jobs = [(k, 10_000 + k % 7, True) for k in range(3_000)] + [(k, 20_000, False) for k in range(0, 3_000, 3)]
    late = [(1, 10_005, False), (2, 15_000, True), (None, 12_000, True)]  # releases and a new start within the lateness
    parts = [jobs, late, [(-1, 900_000, False)], [(-1, 1_900_000, False)]]
    schema = "job_id long, at_ms long, running boolean"
    events = batches(parts, schema).withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", "1 minute")
    calls = spark.sparkContext.accumulator(0)
    got = sorted(((r["job_id"], r["locked_ms"]) for r in settle(_counted(stateful.expired_locks, calls, events, 300_000, buckets=16), "locks").collect()), key=str)
    want = [(k, 10_000 + k % 7) for k in range(3_000) if k % 3 and k not in (1, 2)] + [(2, 15_000), (None, 12_000)]
    assert got == sorted(want, key=str)
    assert 0 < calls.value <= 16 * 6


def _counted(operator, calls, df, *args, **options):
    """``operator`` on ``df``, with its calls of the worker counted."""
    made = type(df.groupBy("at_ms")) if "at_ms" in df.columns else type(df.groupBy(df.columns[0]))
    plain = made.applyInPandasWithState

    def counted(self, func, *rest):
        def one(key, pdfs, state):
            calls.add(1)
            yield from func(key, pdfs, state)

        return plain(self, one, *rest)

    made.applyInPandasWithState = counted
    try:
        return operator(df, *args, **options)
    finally:
        made.applyInPandasWithState = plain


def test_many_monitors_take_few_calls(spark, batches):
    # F16: as above; a null account is one account
    schema = "account_id long, monitor_key string, run_at long, run_id long, snapshot_hash string"
    parts = [[(k if k else None, m, 1, 10 * k, "a") for k in range(500) for m in ("x", "y")], [(None, "x", 2, 1, "b"), (7, "y", 3, 72, "a"), (7, "y", 2, 71, "c")]]
    calls = spark.sparkContext.accumulator(0)
    found = settle(_counted(stateful.monitor_runs, calls, batches(parts, schema), buckets=16), "monitors")
    got = sorted(tuple(r) for r in found.filter("run_count > 1").select("run_id", F.coalesce("account_id", F.lit(-1)), "monitor_key", "first_run", "changed", "run_count", "change_count").collect())
    assert got == [(1, -1, "x", False, True, 2, 1), (71, 7, "y", False, True, 2, 1), (72, 7, "y", False, True, 3, 2)]
    assert found.count() == 1_003 and found.filter("first_run AND run_count = 1 AND NOT changed").count() == 1_000
    assert 0 < calls.value <= 32


def test_waiting_alerts_are_few_numbers(spark):
    # alerts wait as two numbers each, and those that come after another at the same time do not wait
    alerts = spark.createDataFrame([(1, "a", 1)], "alert_id long, key string, at_ms long")
    made, taken = type(alerts.groupBy("key")), []
    plain, made.applyInPandasWithState = made.applyInPandasWithState, lambda self, step, *rest: taken.append(step)
    try:
        stateful.throttle_alerts(alerts, 1_000)
    finally:
        made.applyInPandasWithState = plain

    class State:
        exists = hasTimedOut = False
        mark = 0

        def getCurrentWatermarkMs(self):
            return self.mark

        def update(self, value):
            self.get, self.exists = value, True

        def remove(self):
            self.exists = False

        def setTimeoutTimestamp(self, at):
            assert at > self.mark

    state, [step] = State(), taken
    rows = pd.DataFrame({"at_ms": [60_000 + k // 4 for k in range(40_000)], "alert_id": range(40_000)})
    assert [len(x) for x in step(("a",), iter([rows]), state)] == [0]
    assert len(state.get[1]) == 16 * 10_000
    state.mark, more = 80_000, pd.DataFrame({"at_ms": [61_000], "alert_id": [-1]})
    kept = pd.concat(step(("a",), iter([more]), state))
    assert list(zip(kept["alert_id"], kept["at_ms"])) == [(-1 if k == 1 else 4_000 * k, 60_000 + 1_000 * k) for k in range(10)]
