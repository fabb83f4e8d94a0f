"""Ordered computations that survive hot keys.

A plain window over ``partitionBy(key)`` sends one key to one task. Here rows are cut
into range slices of the *whole* sort order (keys, then order columns), so a hot key is
spread over many slices. Each slice is computed on its own; the little that must cross a
slice border (running totals, the last row of a key) is carried by a table with one row
per (slice, key that continues), which is bounded by the number of slices.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagegrid.plans.lineage import stage

SLICE = "__slice"
_ROWS_PER_SLICE = 1_000_000


def with_slices(df: DataFrame, order: Sequence[str | Column], slices: int | None = None) -> DataFrame:
    """``df`` range-partitioned by ``order`` with ``__slice``, the number of a row's range, written to the shared folder.

    Spark's range partitioning finds the borders. There are as many slices as shuffle partitions, and more where these
    would hold over about a million rows. Written once, a slice stays the same for all who read it.
    """
    if slices is None:
        slices = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-df.count() // _ROWS_PER_SLICE))
    return stage(df.repartitionByRange(max(2, slices), *order).withColumn(SLICE, F.spark_partition_id()), "sliced")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    last_known: dict[str, Column] | None = None,
    lags: dict[str, str] | None = None,
    number: str | None = None,
    slices: int | None = None,
    cheap: bool = False,
) -> DataFrame:
    """Running sums / maxima / last non-null values, lags and row numbers per key, in order.

    Equivalent to windows over ``partitionBy(keys).orderBy(order)`` with a frame from the
    start to the current row, but a key may span any number of tasks. ``order`` must make
    rows unique within a key for the result to be deterministic. Columns such as ``c.desc()``
    may order sums, maxima and row numbers; lags and last values need plain names.

    The input is read a few times (count, borders, rows, carries), so it is staged in the shared
    folder first unless it is ``cheap`` to read again, such as a plain scan.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    last_known, lags = dict(last_known or {}), dict(lags or {})
    if number:
        sums[number] = F.lit(1).cast("long")
    # inputs become columns first, so an expression may itself use an earlier column
    base = df
    for name, col in {**sums, **maxima, **last_known}.items():
        base = base.withColumn(f"__in_{name}", col)
    base = with_slices(base if cheap else stage(base, "ordered"), [*keys, *order], slices)

    local = Window.partitionBy(SLICE, *keys).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = base
    for name in sums:
        out = out.withColumn(name, F.sum(f"__in_{name}").over(upto))
    for name in maxima:
        out = out.withColumn(name, F.max(f"__in_{name}").over(upto))
    for name in last_known:
        out = out.withColumn(name, F.last(f"__in_{name}", ignorenulls=True).over(upto))
    for name, source in lags.items():
        out = out.withColumn(name, F.lag(source).over(local))
    if lags:
        out = out.withColumn("__first", F.row_number().over(local) == 1)

    # what each (slice, key) hands on; map-side combined before its shuffle
    pos = F.struct(*[F.col(c) for c in order]) if lags or last_known else None
    aggs = [F.sum(f"__in_{n}").alias(f"__c_{n}") for n in sums]
    aggs += [F.max(f"__in_{n}").alias(f"__c_{n}") for n in maxima]
    aggs += [
        F.max_by(f"__in_{n}", F.when(F.col(f"__in_{n}").isNotNull(), pos)).alias(f"__c_{n}") for n in last_known
    ]
    aggs += [F.max_by(F.struct(F.col(s).alias("v")), pos).alias(f"__c_{n}") for n, s in lags.items()]
    ends = base.groupBy(SLICE, *keys).agg(*aggs)
    # slices of one key: at most the slice count, so this window stays small for every key
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends
    for n in sums:
        carry = carry.withColumn(f"__p_{n}", F.sum(f"__c_{n}").over(before))
    for n in maxima:
        carry = carry.withColumn(f"__p_{n}", F.max(f"__c_{n}").over(before))
    for n in last_known:
        carry = carry.withColumn(f"__p_{n}", F.last(f"__c_{n}", ignorenulls=True).over(before))
    for n in lags:
        carry = carry.withColumn(f"__p_{n}", F.last(f"__c_{n}").over(before))
    carry = (
        carry.withColumn("__seen", F.count(F.lit(1)).over(before))
        .filter("__seen > 0")
        .select(SLICE, *keys, *[f"__p_{n}" for n in [*sums, *maxima, *last_known, *lags]])
    )
    # only keys continuing over a border remain: at most one row per slice
    renamed = carry.select(
        F.col(SLICE).alias("__s"), *[F.col(k).alias(f"__k_{k}") for k in keys], *[f"__p_{n}" for n in [*sums, *maxima, *last_known, *lags]]
    )
    cond = F.col(SLICE) == F.col("__s")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = out.join(renamed, cond, "left")
    for n in sums:
        out = out.withColumn(n, F.col(n) + F.coalesce(F.col(f"__p_{n}"), F.lit(0)))
    for n in maxima:
        out = out.withColumn(n, F.greatest(n, f"__p_{n}"))
    for n in last_known:
        out = out.withColumn(n, F.coalesce(n, f"__p_{n}"))
    for n in lags:
        out = out.withColumn(n, F.when(F.col("__first"), F.col(f"__p_{n}.v")).otherwise(F.col(n)))
    return out.select(*df.columns, *sums, *maxima, *last_known, *lags)
