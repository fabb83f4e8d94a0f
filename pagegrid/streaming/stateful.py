"""Keyed state machines on streams. State per key is a few values; rows of a key come ordered
within each micro-batch by sorting what the batch holds for it."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

c = F.col


def _ordered(pdfs: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    parts = list(pdfs)
    return pd.concat(parts).sort_values(by, kind="stable") if parts else pd.DataFrame()


#: keys are dealt into this many buckets with one state each, so that a call of the worker handles many keys
_BUCKETS = 1024


def _bucket(*keys: str, buckets: int = _BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(max(1, int(buckets)))).cast("int")


def monitor_runs(runs: DataFrame, buckets: int = _BUCKETS) -> DataFrame:
    """Label each monitor run: first run, changed, counters. Monitors are told apart by (account_id, monitor_key); a
    bucket of them shares a state.
    """

    def step(_: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        monitors = {row[:3]: row[3:] for row in zip(*state.get, strict=True)} if state.exists else {}
        pdf = _ordered(pdfs, ["run_at", "run_id"])
        out = []
        for run_id, known, account, monitor, digest in zip(*(pdf[n].tolist() for n in ("run_id", "known", "account", "monitor_key", "snapshot_hash")), strict=True):
            key = (known, account, monitor)
            seen, runs_, changes = monitors.get(key, (None, 0, 0))
            first = seen is None
            changed = not first and digest != seen
            monitors[key] = (digest, runs_ + 1, changes + int(changed))
            out.append((run_id, known, account, monitor, first, changed, runs_ + 1, changes + int(changed)))
        state.update(tuple(list(x) for x in zip(*(k + v for k, v in monitors.items()), strict=True)))
        yield pd.DataFrame(out, columns=["run_id", "known", "account", "monitor_key", "first_run", "changed", "run_count", "change_count"])

    # a null account is a key of its own; frames have no whole numbers with nulls
    keyed = runs.select(
        _bucket("account_id", "monitor_key", buckets=buckets).alias("bucket"), c("account_id").isNotNull().alias("known"), F.coalesce("account_id", F.lit(0)).cast("long").alias("account"),
        "monitor_key", "run_at", "run_id", "snapshot_hash",
    )
    out = "run_id long, known boolean, account long, monitor_key string, first_run boolean, changed boolean, run_count long, change_count long"
    held = "known array<boolean>, account array<bigint>, monitor_key array<string>, snapshot_hash array<string>, run_count array<bigint>, change_count array<bigint>"
    labelled = keyed.groupBy("bucket").applyInPandasWithState(step, out, held, "append", GroupStateTimeout.NoTimeout)
    return labelled.select("run_id", F.when(c("known"), c("account")).alias("account_id"), "monitor_key", "first_run", "changed", "run_count", "change_count")


def _in_order(state: GroupState, pdfs: Iterator[pd.DataFrame], width: int) -> tuple[tuple, list[tuple], list[tuple]]:
    """(values, ready, waiting): what the state holds besides rows, and the rows held or new, as (at_ms, id, ..) of
    ``width`` values. Rows are ready, in order, when the watermark has reached them, so that a row which comes late in a later
    batch still takes its place.
    """
    held = state.get if state.exists else (None,)
    rows = [tuple(r) for r in zip(*held[1:], strict=True)] if len(held) > 1 else []
    if not state.hasTimedOut:
        for pdf in pdfs:
            rows += [tuple(r[:width]) for r in pdf.itertuples(index=False)]
    rows.sort(key=lambda r: r[:2])
    mark = state.getCurrentWatermarkMs()
    return held[0], [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]


def _keep(state: GroupState, value: str | None, waiting: list[tuple], width: int, until: int | None) -> None:
    """Stores ``value`` and the waiting rows, and wakes the key when the first of them is ready or else at ``until``; without
    either the key is forgotten.
    """
    if not waiting and until is None:
        if state.exists:
            state.remove()
        return
    state.update((value, *([r[i] for r in waiting] for i in range(width))))
    # a timeout fires once the watermark is past it
    state.setTimeoutTimestamp(max(waiting[0][0] - 1 if waiting else until, state.getCurrentWatermarkMs() + 1))


def idempotent_requests(requests: DataFrame, ttl_ms: int = 24 * 3_600_000, late: str = "10 minutes") -> DataFrame:
    """Label requests of (scope, key): first, replay (same hash) or conflict; an expired key starts anew.

    Requests are labelled in the order of their times, once the watermark (newest time less ``late``) has reached them. A
    key is forgotten when its time is over.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, ready, waiting = _in_order(state, pdfs, 3)
        digest, since = (value.split(" ")[0], int(value.split(" ")[1])) if value else (None, None)
        out = []
        for at, request_id, h in ready:
            if since is None or at >= since + ttl_ms:
                digest, since, label = h, int(at), "first"
            else:
                label = "replay" if h == digest else "conflict"
            out.append((request_id, label))
        over = since is None or state.getCurrentWatermarkMs() >= since + ttl_ms
        _keep(state, None if over else f"{digest} {since}", waiting, 3, None if over else since + ttl_ms)
        yield pd.DataFrame(out, columns=["request_id", "label"])

    timed = requests.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", late).select("scope", "key", "at_ms", "request_id", "request_hash", "ts")
    # the keys come first in what a group hands over, so the rows are read by name
    schema = "value string, at_ms array<bigint>, request_id array<bigint>, request_hash array<string>"
    return timed.groupBy("scope", "key").applyInPandasWithState(_rows_only(step, ["at_ms", "request_id", "request_hash"]), "request_id long, label string", schema, "append", GroupStateTimeout.EventTimeTimeout)


def _rows_only(step, names: list[str]):
    """``step`` on frames of the named columns."""
    return lambda key, pdfs, state: step(key, (pdf[names] for pdf in pdfs), state)


def rate_limit(requests: DataFrame, window_ms: int, max_requests: int) -> DataFrame:
    """Per-key fixed windows on a stream (request_id, key, at_ms); idle keys are forgotten once their window is over."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        pdf = _ordered(pdfs, ["at_ms", "request_id"])
        out = []
        for request_id, at in zip(pdf["request_id"], pdf["at_ms"]):
            if start is None or at >= start + window_ms:
                start, count = int(at), 0
            count += 1
            out.append((request_id, count, count > max_requests))
        state.update((start, count))
        state.setTimeoutTimestamp(max(start + window_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["request_id", "request_no", "limited"])

    return requests.groupBy("key").applyInPandasWithState(step, "request_id long, request_no long, limited boolean", "start long, count long", "append", GroupStateTimeout.EventTimeTimeout)


def throttle_alerts(alerts: DataFrame, interval_ms: int = 15_000, late: str = "10 minutes") -> DataFrame:
    """Alerts kept at most once per interval and key; the rest drop. Alerts count in the order of their times, once the
    watermark has reached them; a key is forgotten when its interval is over.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, b"")
        rows = [np.frombuffer(held, np.int64).reshape(-1, 2)]
        if not state.hasTimedOut:
            rows += [pdf.to_numpy(np.int64) for pdf in pdfs]
        rows = np.concatenate(rows)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        # of alerts at one time only that of the least id can be kept
        rows = rows[np.diff(rows[:, 0], prepend=rows[:1, 0] - 1) != 0] if interval_ms > 0 else rows
        mark = state.getCurrentWatermarkMs()
        ready, waiting = np.split(rows, [np.searchsorted(rows[:, 0], mark, "right")])
        kept, at = [], 0
        while True:
            # from an alert that is kept straight to the next one that is
            at = max(at, int(np.searchsorted(ready[:, 0], last + interval_ms))) if last is not None else at
            if at >= len(ready):
                break
            last = int(ready[at, 0])
            kept.append((int(ready[at, 1]), key[0], last))
            at += 1
        until = None if last is None or mark >= last + interval_ms else last + interval_ms
        if len(waiting) or until is not None:
            state.update((None if until is None else last, waiting.tobytes()))
            # a timeout fires once the watermark is past it
            state.setTimeoutTimestamp(max(int(waiting[0, 0]) - 1 if len(waiting) else until, mark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(kept, columns=["alert_id", "key", "at_ms"])

    timed = alerts.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", late).select("key", "at_ms", "alert_id", "ts").filter("at_ms IS NOT NULL")
    key_type = alerts.schema["key"].dataType.simpleString()
    return timed.groupBy("key").applyInPandasWithState(_rows_only(step, ["at_ms", "alert_id"]), f"alert_id long, key {key_type}, at_ms long", "last long, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)


def expired_locks(job_events: DataFrame, timeout_ms: int = 300_000, buckets: int = _BUCKETS) -> DataFrame:
    """Jobs running without a terminal event within the timeout. Input (job_id, at_ms, running) with event time
    watermarked. A bucket of jobs shares a state, which holds the open locks alone; a release at the time of its start counts
    as after it.
    """
    timeout_ms = max(60_000, int(timeout_ms))

    def step(_: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # an event: job known, job, time it sorts by, not running, time known, time
        held = np.frombuffer(state.get[0], np.int64).reshape(-1, 3) if state.exists else np.empty((0, 3), np.int64)
        none = np.zeros(len(held), np.int64)
        rows = [np.column_stack((held[:, 0], held[:, 1], none + np.iinfo(np.int64).min, none, none + 1, held[:, 2]))]
        if not state.hasTimedOut:
            for pdf in pdfs:
                known, job, timed, at, running = (pdf[n].to_numpy(np.int64) for n in ("known", "job", "timed", "at", "held"))
                rows.append(np.column_stack((known, job, np.where(timed, at, np.iinfo(np.int64).max), 1 - running, timed, at)))
        rows = np.concatenate(rows)
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        start = rows[:, 3] == 0
        follows = np.zeros(len(rows), bool)  # the next event is of the same job
        follows[:-1] = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
        over = np.zeros(len(rows), bool)
        over[:-1] = (rows[1:, 4] == 1) & (rows[1:, 5] > rows[:-1, 5] + timeout_ms)
        mark = state.getCurrentWatermarkMs()
        late = start & np.where(follows, over, mark > rows[:, 5] + timeout_ms)
        still = rows[start & ~follows & ~late]
        if len(still):
            state.update((still[:, [0, 1, 5]].tobytes(),))
            state.setTimeoutTimestamp(max(int(still[:, 5].min()) + timeout_ms, mark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"known": rows[late, 0] == 1, "job": rows[late, 1], "locked_ms": rows[late, 5]})

    # a null job is a key of its own; an event without a time ends a lock and starts none
    timed = c("at_ms").isNotNull()
    keyed = job_events.select(
        _bucket("job_id", buckets=buckets).alias("bucket"), c("job_id").isNotNull().alias("known"), F.coalesce("job_id", F.lit(0)).cast("long").alias("job"), timed.alias("timed"), F.coalesce("at_ms", F.lit(0)).cast("long").alias("at"),
        (timed & F.coalesce("running", F.lit(False))).alias("held"), "ts",
    )
    found = keyed.groupBy("bucket").applyInPandasWithState(step, "known boolean, job long, locked_ms long", "locks binary", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.when(c("known"), c("job")).alias("job_id"), "locked_ms")
