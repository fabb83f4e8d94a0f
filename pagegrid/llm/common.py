"""Helpers the corpus operators share: text expressions, row keys, prefix sums that survive hot keys."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrid.plans.lineage import cut

#: white space of every contract that counts words
BLANKS = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: rows of one key that one task orders at a time
SLICE_ROWS = 50_000


def text_of(text: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. ``lower`` is the fast way for texts that are all ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def split_words(text: Column, gaps: str = BLANKS) -> Column:
    return F.array_remove(F.split(text, gaps), "")


def text_key(text: Column) -> Column:
    """With the document id this names a row: ids may repeat, and equal rows may stand for each other."""
    return F.xxhash64(text_of(text))


def same_row(left: DataFrame, right: DataFrame, *columns: str) -> Column:
    """Null-safe equality on all ``columns``; an equi join for Spark."""
    found = F.lit(True)
    for c in columns:
        found = found & left[c].eqNullSafe(right[c])
    return found


def spread_position(order: Column, slices: int) -> Column:
    """Slice number of a 64-bit hash; grows with the hash, and hashes fill slices evenly."""
    share = (order.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.least(F.floor(share * slices), F.lit(slices - 1)).cast("long")


def slices_for(rows: int, slice_rows: int = SLICE_ROWS) -> int:
    return max(1, math.ceil(rows / slice_rows))


def running_before(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, slice_col: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same keys that come earlier in ``order``.

    ``slice_col`` numbers slices of the order, each of a bounded number of rows, so a key that holds a third of all rows
    is summed by many tasks: sums per slice, prefix sums over slices, then a window inside each slice. ``df`` is read
    twice and must be cut before. Keys must not be null.
    """
    parts = [*keys, slice_col]
    sums = df.groupBy(*parts).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*parts, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).cast("long").alias("_base"))
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(base, parts)
        .withColumn(out, (F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
        .drop("_base")
    )


def sorted_rank(df: DataFrame, *order: Column, out: str = "rank") -> DataFrame:
    """Adds the position of each row in a total order, from 0, without bringing all rows to one task."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row per partition
    base = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    joined = laid.withColumn("_part", part).join(base, "_part")
    return joined.withColumn(out, (F.col("_base") + F.col("_at") - F.shiftleft("_part", 33)).cast("long")).drop("_at", "_part", "_base")
