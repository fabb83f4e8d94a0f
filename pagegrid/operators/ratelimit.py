"""Per-key fixed windows that open at the key's first request and reset after their length.

The windows of a key form a chain: the next one opens at the first request at or after
start + length. A chain is sequential, but a range slice of it is a monotone step function
from the window open at its left border to the window open at its right border. So slices
are reduced in parallel to a few steps each, the steps are walked per key (at most one slice
count per key), and the slices are then resolved in parallel. No task ever holds a whole key.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pagegrid.plans.lineage import stage
from pagegrid.plans.ordered import SLICE, running, with_slices

c = F.col
_NONE = -(2**62)


def _steps(pdf: pd.DataFrame, length: int) -> list[tuple[int, int]]:
    """(latest entering start, start on leaving) steps of one slice; chains merge, so few remain."""
    t = np.sort(pdf["at"].to_numpy())
    n = len(t)
    nxt = np.searchsorted(t, t + length, side="left")
    last = np.arange(n)
    for i in range(n - 1, -1, -1):
        if nxt[i] < n:
            last[i] = last[nxt[i]]
    steps: list[tuple[int, int]] = []
    # an entering start s < t[0] opens its successor at the first t >= s + length
    for e in range(min(n, int(np.searchsorted(t, t[0] + length, side="left")) + 1)):
        leave = int(t[last[e]])
        bound = int(t[e]) - length
        if steps and steps[-1][1] == leave:
            steps[-1] = (bound, leave)
        else:
            steps.append((bound, leave))
    return steps


def window_starts(df: DataFrame, key: str, at_ms: str, length_ms: int, slices: int | None = None) -> DataFrame:
    """Distinct (key, request time) with the start of the window it falls in."""
    times = df.select(c(key).alias("key"), c(at_ms).cast("long").alias("at")).distinct()
    sliced = with_slices(stage(times, "times"), ["key", "at"], slices)
    key_type = times.schema["key"].dataType.simpleString()
    # slices are ranges of (key, time), so at most one key continues over each border
    spans = sliced.groupBy("key").agg(F.min(SLICE).alias("lo"), F.max(SLICE).alias("hi")).filter("lo < hi").select(c("key").alias("long_key"))
    crossing = sliced.join(spans, c("key").eqNullSafe(c("long_key")), "left_semi")

    def reduce(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _steps(pdf, length_ms)
        return pd.DataFrame({SLICE: group[0], "key": group[1], "bound": [r[0] for r in rows], "leave": [r[1] for r in rows]})

    steps = crossing.groupBy(SLICE, "key").applyInPandas(reduce, f"{SLICE} int, key {key_type}, bound long, leave long")

    def walk(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, start = [], _NONE
        for slice_id, part in pdf.sort_values([SLICE, "bound"]).groupby(SLICE, sort=True):
            out.append((slice_id, start))
            # first step whose bound covers the entering start; beyond the last the window just goes on
            i = int(np.searchsorted(part["bound"].to_numpy(), start, side="left"))
            if i < len(part):
                start = int(part["leave"].to_numpy()[i])
        return pd.DataFrame({SLICE: [o[0] for o in out], "key": group[0], "entering": [o[1] for o in out]})

    entering = steps.groupBy("key").applyInPandas(walk, f"{SLICE} int, key {key_type}, entering long")

    def resolve(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "at"], ignore_index=True)
        t, keys, entered = pdf["at"].to_numpy(), pdf["key"].to_numpy(), pdf["entering"].to_numpy()
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        starts = np.empty(len(t), dtype=np.int64)
        for lo, hi in zip(edges[:-1], edges[1:]):
            mine, current, i = t[lo:hi], int(entered[lo]), 0
            while i < len(mine):
                if mine[i] >= current + length_ms:
                    current = int(mine[i])
                j = int(np.searchsorted(mine, current + length_ms, side="left"))
                starts[lo + i : lo + j] = current
                i = j
        return pd.DataFrame({"key": keys, "at": t, "start": starts})

    entering = entering.select(c(SLICE).alias("s"), c("key").alias("k"), "entering")
    joined = sliced.join(entering, (c(SLICE) == c("s")) & c("key").eqNullSafe(c("k")), "left").drop("s", "k").withColumn("entering", F.coalesce("entering", F.lit(_NONE)))
    return joined.groupBy(SLICE).applyInPandas(resolve, f"key {key_type}, at long, start long")


def fixed_window_limit(df: DataFrame, key: str, ts: str, order: str, window_ms: int = 60_000, max_requests: int = 60) -> DataFrame:
    """Each request with its window count, remaining allowance and, when refused, the wait in seconds.

    Refused requests still count. ``order`` breaks ties between requests of one millisecond.
    """
    window_ms, max_requests = max(1_000, int(window_ms)), max(1, int(max_requests))
    reqs = df.withColumn("__at", F.unix_millis(c(ts)))
    starts = window_starts(reqs, key, "__at", window_ms)
    starts = starts.select(c("key").alias("__key"), c("at").alias("__t"), c("start").alias("__start"))
    placed = reqs.join(starts, c(key).eqNullSafe(c("__key")) & (c("__at") == c("__t"))).drop("__key", "__t")
    counted = running(placed, [key, "__start"], ["__at", order], number="request_no")
    limited = c("request_no") > max_requests
    reset = c("__start") + window_ms
    return counted.select(
        *df.columns, "request_no",
        F.greatest(F.lit(0), F.lit(max_requests) - c("request_no")).alias("remaining"),
        F.ceil(reset / 1000).cast("long").alias("reset_s"),
        limited.alias("limited"),
        F.when(limited, F.greatest(F.lit(1), F.ceil((reset - c("__at")) / 1000))).cast("long").alias("retry_after_s"),
    )


def limiter_stats(limited: DataFrame, scope: str, ts: str) -> DataFrame:
    from pagegrid.functions.numbers import percent

    return limited.groupBy(scope).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("limited").alias("limited_requests"),
        percent(F.count_if("limited"), F.count(F.lit(1))).alias("limited_percent"),
        F.max(ts).alias("last_seen_at"),
    )
