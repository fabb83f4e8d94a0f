"""Sharding by Karmarkar-Karp differencing: near equal bytes for groups that must not be split.

A partial partition is a list of byte sums, one per shard. Differencing takes the two partial partitions with the largest
spread (largest minus smallest sum), adds them oppositely ordered, and puts the result back, until one is left.

Groups heavier than 1 / (``grain`` x shards) of all bytes are fewer than ``grain`` x shards; they are differenced first.
Tasks then difference at most about ``leaf`` light groups each, together with one more partial partition: their part of
the sums that the heavy groups left. So each task fills up what the heavy groups leave uneven, and its shards are tied
to theirs. No task and not the driver ever holds more groups than that.

Defined results: null texts weigh the overhead only and share the group of empty texts; ids may be null or repeat (rows
count each); an empty table gives an empty result; columns beyond id and text are not read. A group heavier than its even
share fills a shard of its own.
"""
from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrid.llm.common import running_before, slices_for, spread_position, text_of
from pagegrid.plans.lineage import cut


def difference(sums: np.ndarray) -> np.ndarray:
    """``sums``: items x shards. Returns, for each item and column, the shard that column goes to."""
    items, shards = sums.shape
    first = np.argsort(-sums, axis=1, kind="stable")
    ordered = np.take_along_axis(sums, first, axis=1)
    vectors: list[list[int]] = ordered.tolist()
    heap = [(v[-1] - v[0], i) for i, v in enumerate(vectors)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, list[int]]] = []
    for made in range(items, 2 * items - 1):
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        added = [x + y for x, y in zip(vectors[a], reversed(vectors[b]), strict=True)]
        order = sorted(range(shards), key=added.__getitem__, reverse=True)
        merges.append((a, b, order))
        vectors.append([added[j] for j in order])
        vectors[a] = vectors[b] = []
        heapq.heappush(heap, (vectors[made][-1] - vectors[made][0], made))
    # from the last merge down, each partial partition learns where its columns went
    went = np.zeros((2 * items - 1, shards), dtype=np.int32)
    went[-1] = np.arange(shards)
    for k in range(len(merges) - 1, -1, -1):
        a, b, order = merges[k]
        went[a][order] = went[items + k]
        went[b] = went[a][::-1]
    out = np.empty((items, shards), dtype=np.int32)
    np.put_along_axis(out, first, went[:items], axis=1)
    return out


def balance(groups: DataFrame, key: str, weight: str, shards: int, leaf: int = 8192, grain: int = 32) -> DataFrame:
    """(key, shard) for ``groups``, a row per key with its weight."""
    groups = cut(groups.select(F.col(key).alias("key"), F.col(weight).cast("long").alias("weight")))
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    heavy = F.col("weight") * (grain * shards) > total
    first = groups.where(heavy).orderBy(F.desc("weight"), "key").collect()  # fewer than grain * shards rows
    loads, placed = np.zeros(shards, np.int64), []
    if first:
        sums = np.zeros((len(first), shards), np.int64)
        sums[:, 0] = [r["weight"] for r in first]
        home = difference(sums)[:, 0]
        np.add.at(loads, home, sums[:, 0])
        placed = [(r["key"], int(h)) for r, h in zip(first, home, strict=True)]
    rest, nodes = max(total - int(loads.sum()), 1), slices_for(count, leaf)

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "key"], ascending=False, kind="stable")
        # shards change places from task to task, so that what is left uneven does not add up
        turn = np.random.default_rng(int(pdf["node"].iloc[0])).permutation(shards)
        sums = np.zeros((len(pdf) + 1, shards), dtype=np.int64)
        sums[1:, 0] = pdf["weight"]
        sums[0] = (loads[turn] * (float(pdf["weight"].sum()) / rest)).astype(np.int64)
        went = difference(sums)
        named = np.empty(shards, np.int64)
        named[went[0]] = turn  # columns are named by where the heavy groups' part went
        return pd.DataFrame({"key": pdf["key"], "shard": named[went[1:, 0]].astype(np.int32)})

    kind = groups.schema["key"].dataType.simpleString()
    dealt = groups.where(~heavy).withColumn("node", F.pmod(F.xxhash64("key"), F.lit(nodes)))
    light = dealt.groupBy("node").applyInPandas(leaves, f"key {kind}, shard int")
    return light.unionByName(groups.sparkSession.createDataFrame(placed, f"key {kind}, shard int"))


def shard(docs: DataFrame, shards: int = 24, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text", leaf: int = 8192, grain: int = 32) -> DataFrame:
    """Per row: id, size, text_crc32, shard, slot (gapless in its shard)."""
    text = text_of(F.col(text_col))
    rows = cut(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    ))
    groups = rows.groupBy("key").agg(F.sum("size").alias("weight"))
    assigned = cut(rows.join(balance(groups, "key", "weight", shards, leaf, grain), "key").drop("key").withColumn("order", F.xxhash64("row")))
    sliced = assigned.withColumn("slice", spread_position(F.col("order"), slices_for(assigned.count())))
    return running_before(sliced, ["shard"], ["order"], F.lit(1), "slot", "slice").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
