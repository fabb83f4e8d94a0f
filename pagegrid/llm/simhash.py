"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's 64 bits each get a vector of r + 1 bits. Table v keeps the bits whose vector has an odd product with v.
The vectors of any r differing bits leave some v orthogonal to all of them, so every pair within radius r agrees on all
kept bits of some table: no such pair is lost. For r = 2 these are seven tables of about 36 kept bits.

Tables hold distinct fingerprints, so copies cost nothing. A bucket of up to ``bucket`` fingerprints is linked in one
place and gives a spanning forest of its links, not all pairs. A larger bucket is covered again with other vectors, which
keeps more bits. At radius 2 at most 11 bits are free after three levels and 9 after four, so a bucket of the last level
holds at most 512 fingerprints and is linked whole. Links become components by alternating large-star and small-star
steps, each cut to the shared folder.

Defined results: null texts count as empty and, like texts without a word, have fingerprint zero; ids may be null (they
never name a component with other ids) or repeat; an empty table gives an empty result; columns beyond id and text are
not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrid.llm.common import ascii_lower, split_words, text_key, text_of
from pagegrid.plans.lineage import cut

#: shingle hashes whose bits are counted at a time
_CHUNK = 1 << 17


def shingle_hashes(words: Column, width: int) -> Column:
    """XXH64 (seed 42) of each shingle; fewer words than ``width``: of the whole sequence; no word: none."""
    n = F.size(words)
    rolled = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(words, i + k) for k in range(width)])))
    return F.when(n >= width, rolled).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def majority_bits(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit number per row: bit i is set if over half of the row's ``counts`` values have it."""
    out = np.zeros(len(counts), np.int64)
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(counts):
        start = ends[lo] - counts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, start + _CHUNK, side="right")))
        some = np.arange(lo, hi)[counts[lo:hi] > 0]
        if len(some):
            sums = np.zeros((len(some), 64), np.int64)
            if len(some) == 1:  # a single long row is counted in parts
                for at in range(start, ends[hi - 1], _CHUNK):
                    sums[0] += np.unpackbits(values[at : min(at + _CHUNK, ends[hi - 1])].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            else:
                bits = np.unpackbits(values[start : ends[hi - 1]].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                sums = np.add.reduceat(bits, (ends[some] - counts[some] - start).astype(np.int64), axis=0, dtype=np.int32)
            out[some] = np.packbits(2 * sums > counts[some][:, None], axis=1, bitorder="little").view("<i8")[:, 0]
        lo = hi
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, key, fp) per row; ``key`` is the hash of the text."""
    kind = docs.schema[id_col].dataType.simpleString()
    words = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), split_words(ascii_lower(text_of(F.col(text_col)))).alias("words"))
    hashed = words.select("id", "key", shingle_hashes(F.col("words"), width).alias("h"))

    def count(batches):
        for batch in batches:
            h = batch.column("h")
            offsets = h.offsets.to_numpy()
            fp = majority_bits(h.values.to_numpy(zero_copy_only=False)[offsets[0] :] if len(offsets) else np.empty(0, np.int64), np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(fp)], ["id", "key", "fp"])

    return hashed.mapInArrow(count, f"id {kind}, key long, fp long")


def covering_masks(radius: int, level: int) -> list[int]:
    """Kept bits of each table, as signed 64-bit numbers. Levels give the bits their vectors in different orders."""
    tables = (1 << (radius + 1)) - 1
    vector = [(i // tables**level + i * level) % tables + 1 for i in range(64)]
    masks = [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() & 1) for v in range(1, tables + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the components of ``fps`` under distance ``radius``."""
    links, todo = [], np.sort(fps)
    while len(todo):
        reached, todo = [todo[0]], todo[1:]
        while reached and len(todo):
            one = reached.pop()
            near = np.bitwise_count((todo ^ one).view(np.uint64)) <= radius
            links += [(int(one), int(x)) for x in todo[near]]
            reached += list(todo[near])
            todo = todo[~near]
    return links


def links(nodes: DataFrame, radius: int = 2, bucket: int = 256, levels: int = 4) -> DataFrame:
    """(a, b) of distinct fingerprints within ``radius``: enough links to connect all that are connected."""
    found = None
    keyed = nodes.select("fp", F.lit(0).cast("long").alias("kept"), F.lit(0).alias("table"))
    tables = (1 << (radius + 1)) - 1
    for level in range(levels):
        options = F.array(*[F.struct(F.lit(i + 1).alias("t"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(covering_masks(radius, level))])
        opened = keyed.select("fp", "kept", "table", F.explode(options).alias("o")).select(
            "fp", F.col("kept").bitwiseOR(F.col("o.mask")).alias("kept"), (F.col("table") * (tables + 1) + F.col("o.t")).alias("table"),
        ).withColumn("slot", F.col("fp").bitwiseAND(F.col("kept")))
        counted = opened.groupBy("table", "slot").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
        counted = cut(counted)
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
        pairs = counted.where((F.col("n") == 2) & near).select("a", "b")
        more = cut(opened.join(counted.where("n > 2").select("table", "slot", "n"), ["table", "slot"]))
        last = level == levels - 1
        gathered = more.where(F.lit(last) | (F.col("n") <= bucket)).groupBy("table", "slot").agg(F.collect_list("fp").alias("fps")).select("fps")

        def forests(batches):
            for batch in batches:
                made = [x for fps in batch.column("fps") for x in _forest(fps.values.to_numpy(), radius)]
                a, b = zip(*made, strict=True) if made else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        here = pairs.unionByName(gathered.mapInArrow(forests, "a long, b long"))
        found = here if found is None else found.unionByName(here)
        keyed = more.where(F.col("n") > bucket).select("fp", "kept", "table")
        if last or keyed.isEmpty():
            break
    return found.distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node each node of ``edges`` (a, b) is connected to."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(rounds):
        # large star: neighbours above a node move to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = cut(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError("components did not settle")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, bucket: int = 256) -> DataFrame:
    """Per row: id, key (text hash), fp, root (fingerprint that names the component), component_id."""
    rows = cut(fingerprints(docs, id_col, text_col, width))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(links(nodes.select("fp"), radius, bucket))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(named.join(lowest, "root").select("fp", "root", "component_id"), "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of each component the row with the smallest id, with all columns of ``docs``."""
    rows = cut(near_groups(docs, id_col, text_col, **options))
    first = rows.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root", "id", "key").agg(F.count("*").alias("copies"))
    stays = first.groupBy("root").agg(F.min("key").alias("key"), F.min("id").alias("id"), F.min_by("copies", "key").alias("copies"))
    keyed = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("own"), text_key(F.col(text_col)).alias("h"))
    found = keyed.join(stays, keyed["own"].eqNullSafe(stays["id"]) & (keyed["h"] == stays["key"])).select("doc", "own", "h", "copies")
    # rows equal in id and text are rare; only they are compared once more
    once = found.where("copies = 1").select("doc.*")
    return once.unionByName(found.where("copies > 1").dropDuplicates(["own", "h"]).select("doc.*"))
