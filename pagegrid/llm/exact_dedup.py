"""Exact deduplication over an extendible-hash index.

The key of a text is a 64-bit hash. A directory over the leading bits of the keys names the bucket of every key: it
doubles (takes one more bit) wherever a bucket holds more than ``bucket_keys`` keys. Buckets are ranges of keys; owner
tasks write them, range by range, to the shared folder. Texts are grouped by key and bytes, so keys that collide become
a chain of entries told apart by their bytes. Rows then probe the index.

Only DataFrame operations. Equal texts meet in partial sums first, so a group that holds a third of all rows costs each
map task one row.

Defined results: null texts count as empty; ids may be null (a group of null ids only keeps one of its rows and has a
null ``keep_id``) or repeat (of rows equal in id and text one is kept); an empty table gives an empty result; columns
beyond id and text are not read.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrid.llm.common import ascii_lower, same_row, text_of
from pagegrid.plans.lineage import cut


def normalised(text: Column) -> Column:
    return ascii_lower(text_of(text))


def key_of(norm: Column, hash_bits: int = 64) -> Column:
    return F.xxhash64(norm) if hash_bits >= 64 else F.shiftleft(F.shiftrightunsigned(F.xxhash64(norm), 64 - hash_bits), 64 - hash_bits)


def directory(keys: DataFrame, bucket_keys: int) -> tuple[DataFrame, int]:
    """(slot, bucket, depth) for each slot in use, and the global depth. ``keys`` has a row per key, ``h``.

    Counts are taken once at the finest depth and rolled up; the depth of a slot is the first at which its bucket is not
    overfull. Keys are hashes, so four bits beyond the mean depth suffice; what stays overfull there becomes a chain.
    """
    total = keys.count()
    finest = min(40, max(0, math.ceil(math.log2(max(total, 1) / bucket_keys))) + 4)
    slots = keys.groupBy(F.shiftrightunsigned("h", 64 - finest).alias("slot")).agg(F.count("*").alias("n"))
    rolled = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(finest))).alias("depth"))
    prefix = F.expr(f"shiftright(slot, {finest} - depth)")
    sizes = rolled.groupBy("depth", prefix.alias("prefix")).agg(F.sum("n").alias("n"))
    fits = (
        rolled.select("slot", "depth", prefix.alias("prefix"))
        .join(sizes.where((F.col("n") <= bucket_keys) | (F.col("depth") == finest)), ["depth", "prefix"])
        .groupBy("slot").agg(F.min("depth").alias("depth"))
    )
    return fits.select("slot", "depth", F.expr(f"shiftleft(shiftright(slot, {finest} - depth), {finest} - depth)").alias("bucket")), finest


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = 100_000, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(index, entries): an entry per row (id, h, sha, row), and per distinct text (h, sha, bucket, depth, chain,
    group_size, keep_id, keep_row, keep_copies), written in ranges of buckets.
    """
    norm = normalised(F.col(text_col))
    read = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    read = read.withColumn("h", key_of(F.col("norm"), hash_bits))
    entries = cut(read.select("id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("row")))
    # the bytes of the texts decide which rows belong together
    texts = read.groupBy("h", "norm").agg(F.count("*").alias("group_size")).select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size")
    by_id = entries.groupBy("h", "sha", "id").agg(F.count("*").alias("c"), F.min("row").alias("row"))
    kept = by_id.groupBy("h", "sha").agg(
        F.max("id").alias("keep_id"), F.coalesce(F.max_by("row", "id"), F.min("row")).alias("keep_row"), F.coalesce(F.max_by("c", "id"), F.max("c")).alias("keep_copies")
    )
    groups = cut(texts.join(kept, ["h", "sha"]))
    chains = groups.groupBy("h").agg(F.count("*").alias("chain"))
    slots, finest = directory(chains, bucket_keys)
    at = F.shiftrightunsigned("h", 64 - finest).alias("slot")
    index = groups.select("*", at).join(chains, "h").join(slots, "slot").drop("slot")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(index.repartitionByRange(n, "bucket", "h")), entries


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = 100_000, hash_bits: int = 64) -> DataFrame:
    """Per row: id, keep_id (largest id of its group), group_size, kept, text_sha256, bucket, chain."""
    index, entries = build_index(docs, id_col, text_col, bucket_keys, hash_bits)
    return entries.join(index, ["h", "sha"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "chain",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = 100_000) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    index, _ = build_index(docs, id_col, text_col, bucket_keys)
    norm = normalised(F.col(text_col))
    # whole rows travel as one struct, so no column name can clash
    keyed = docs.select(F.struct("*").alias("doc"), key_of(norm).alias("h"), F.unhex(F.sha2(norm, 256)).alias("sha"), F.col(id_col).alias("id"))
    stays = index.select("h", "sha", F.col("keep_id").alias("id"), F.col("keep_copies").alias("copies"))
    found = keyed.join(stays, same_row(keyed, stays, "h", "sha", "id")).select("doc", keyed["h"], keyed["sha"], keyed["id"], "copies")
    # rows equal in id and text are rare; only they are compared once more
    once = found.where("copies = 1").select("doc.*")
    repeated = found.where("copies > 1").dropDuplicates(["h", "sha", "id"]).select("doc.*")
    return once.unionByName(repeated)
