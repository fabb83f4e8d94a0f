"""Packing token pieces into sequences by minimum bin slack.

Bins have a fixed capacity, so pieces differ in their length only: the corpus is a histogram of at most ``capacity``
lengths, however large it is. Per bin, a subset-sum over the lengths still there (a bitset, each bit a reachable fill)
finds the fullest combination that holds the longest piece left; the combination is then removed. As long as its
lengths last the same combination stays the answer for the next bin, so it is removed as often as it fits at once. What
comes out is a short list of combinations and how often each is used, made on the driver from the histogram. Pieces are
ranked per length and take their place in a bin by arithmetic.

Defined results: null and empty texts are one piece holding the end token; ids may be null or repeat (each row is packed
for itself); an empty table gives an empty result; columns beyond id and text are not read.
"""
from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrid.llm.common import running_before, slices_for, spread_position, text_of
from pagegrid.llm.tokens import byte_level
from pagegrid.plans.lineage import cut, stage

#: characters encoded at a time, or one longer text
_CHARS = 1_500_000


def _parts(batch: pa.RecordBatch):
    """Slices of about ``_CHARS`` characters of text."""
    behind = np.cumsum([len(t) for t in batch.column("text").to_pylist()])
    lo = 0
    while lo < batch.num_rows:
        done = behind[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(behind, done + _CHARS, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def token_pieces(docs: DataFrame, tokenizer: tuple[str, str], capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_row: bool = False) -> DataFrame:
    """``tokenizer``: path of a ``tokenizers`` file and its split pattern. Gives (id, piece, start, length, ids_crc32[, ids][, row]): documents as token ids with ``end_id`` behind, cut only if longer than
    ``capacity``; the first piece of a cut document takes the remainder, all others are full. ``row`` numbers the rows of
    ``docs``; it holds for one reading of them.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def pieces(batches):
        model = byte_level(*tokenizer)
        for batch in (part for b in batches for part in _parts(b)):
            at, out, cuts = [], [], []
            for row, raw in enumerate(model.raw(batch.column("text").to_pylist())):
                ids = np.append(np.frombuffer(raw, np.int32).astype("<u4"), np.array([end_id], "<u4"))
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    at.append(row)
                    out.append((n, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                    if with_ids:
                        cuts.append(ids[a:b])
            columns = [batch.column("id").take(pa.array(at, pa.int64()))]
            columns += [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            if with_ids:
                ends = np.cumsum([0, *map(len, cuts)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cuts).astype(np.int64))))
            columns += [batch.column("row").take(pa.array(at, pa.int64()))] if with_row else []
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, *["row"] * with_row])

    read = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text"), *[F.monotonically_increasing_id().alias("row")] * with_row)
    return read.mapInArrow(pieces, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids + ", row long" * with_row)


def fullest(counts: dict[int, int], capacity: int) -> Counter:
    """The fullest combination of pieces that holds the longest one, as length -> times."""
    top = max(counts)
    room = capacity - top
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length] - (length == top), room // length)):
            wider = (reach | reach << length) & mask
            if wider == reach:
                break
            steps.append((length, reach))
            reach = wider
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    fill, chosen = reach.bit_length() - 1, Counter([top])
    for length, before in reversed(steps):
        if not before >> fill & 1:
            chosen[length] += 1
            fill -= length
    return chosen


def combinations(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """(combination, bins) until every piece has its bin."""
    left = {length: n for length, n in histogram.items() if n}
    found = []
    while left:
        chosen = fullest(left, capacity)
        times = min(left[length] // n for length, n in chosen.items())
        found.append((chosen, times))
        for length, n in chosen.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return found


def pack(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """Adds sequence_id and offset to ``pieces``. Pieces longer than ``capacity`` must have been cut."""
    rows = cut(pieces.select(F.struct("*").alias("piece"), F.col(length_col).cast("long").alias("length"), F.monotonically_increasing_id().alias("row")))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    spark, entries, at, sequences = rows.sparkSession, [], Counter(), 0
    for chosen, times in combinations(histogram, capacity):
        offset = 0
        for length, n in sorted(chosen.items(), reverse=True):
            entries.append((length, at[length], at[length] + n * times, n, sequences, offset))
            at[length] += n * times
            offset += n * length
        sequences += times
    # its size depends on capacity, not on the number of pieces
    places = F.broadcast(spark.createDataFrame(entries, "length long, first long, behind long, copies long, base long, lead long"))
    n = slices_for(sum(histogram.values()))
    ordered = rows.withColumn("order", F.xxhash64("row"))
    ranked = running_before(ordered.withColumn("slice", spread_position(F.col("order"), n)), ["length"], ["order"], F.lit(1), "rank", "slice")
    placed = ranked.join(places, "length").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("behind")))
    turn = F.col("rank") - F.col("first")
    return placed.select(
        "piece.*", (F.col("base") + F.floor(turn / F.col("copies"))).cast("long").alias("sequence_id"), (F.col("lead") + (turn % F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )


def copy_numbers(pieces: DataFrame) -> DataFrame:
    """(row, copy) for each row of the documents behind ``pieces`` (id, piece, row): rows of the same id are numbered from 0."""
    # keys must not be null; ids that share a hash only share their numbers
    rows = cut(pieces.where("piece = 0").select("row", F.xxhash64("id").alias("key"), F.xxhash64("row").alias("order")))
    n = slices_for(rows.count())
    return running_before(rows.withColumn("slice", spread_position(F.col("order"), n)), ["key"], ["order"], F.lit(1), "copy", "slice").select("row", "copy")


def packed_documents(docs: DataFrame, tokenizer: tuple[str, str], capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_copy: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32[, ids][, copy], sequence_id, offset. ``copy`` tells rows of the same id
    apart: the pieces of one row have the same number.
    """
    pieces = token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids, with_copy)
    if not with_copy:
        return pack(pieces, capacity).withColumnRenamed("id", id_col)
    # places and numbers are made of lengths and ids only; tokens are moved once
    pieces = stage(pieces, "pieces")
    placed = pack(pieces.select("row", "piece", "length"), capacity).drop("length")
    numbered = placed.join(copy_numbers(pieces), "row").select("row", "piece", "copy", "sequence_id", "offset")
    return pieces.join(numbered, ["row", "piece"]).select(F.col("id").alias(id_col), "piece", *pieces.columns[2:-1], "copy", "sequence_id", "offset")
