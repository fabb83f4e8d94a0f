"""Alignment of two tokenizers by divide and conquer at shared cuts.

Both tokenizations of a text cover the same bytes. A byte offset at which a token of either ends is a cut. An interval of
tokens is divided at the cut nearest to its middle: ends of A around the middle are looked up among the ends of B by
bisection, going outwards in doubling steps; both halves are divided in turn, and an interval without a cut inside is a
leaf group. All intervals of a level, over many documents, are worked on at once.

The last tokens of a group end together and are linked. Links are counted over the corpus per pair of ids: partial
counts inside the tasks, then one sum by Spark. The finished counts are looked up for each document: as sorted arrays
sent to the tasks up to ``sent_pairs`` different pairs, by a join beyond that.

Defined results: null and empty texts, and texts which one of the tokenizers does not give back byte by byte (with a blank
in front), have no tokens; ids may be null or repeat (each row is aligned for itself); an empty table gives an empty result;
columns beyond id and text are not read. Tokenizers give no empty tokens, so a shared end links exactly one pair.
"""
from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrid.llm.tokens import byte_level_bytes, lengths, merges, pieces
from pagegrid.plans.lineage import stage

#: characters aligned at a time, different pairs counted in a task before they are handed on, and rows looked up at a time
_CHUNK, _HELD, _ROWS = 1 << 19, 1 << 20, 256


@lru_cache(maxsize=1)
def _models(path_a: str, pattern: str, path_b: str):
    a, b = merges(path_a, pattern), pieces(path_b)
    bytes_a, bytes_b = byte_level_bytes(path_a), b.spelled
    # an id with what follows it: "," inside a group, "|" behind the last id of A, ";" behind the last of B
    written = [f"{i}{mark}".encode() for n, marks in ((len(bytes_a), ",|"), (len(bytes_b), ",;")) for i in range(n) for mark in marks]
    return a, b, lengths(bytes_a), lengths(bytes_b), written


def _nearest(lo: np.ndarray, hi: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval of tokens ``lo`` to ``hi`` of A: the token nearest to the middle, the last one left out, that ends
    where a token of B ends, and this token of B; -1 where there is none.
    """
    at, to = np.full(len(lo), -1), np.full(len(lo), -1)
    middle, todo, reach, width = (lo + hi - 2) >> 1, np.arange(len(lo)), 0, 1
    while len(todo):
        steps = np.arange(reach, reach + width)
        tried = middle[todo, None] + np.stack([steps, -steps], axis=1).ravel()
        inside = (tried >= lo[todo, None]) & (tried <= hi[todo, None] - 2)
        tried = np.clip(tried, 0, len(ends_a) - 1)
        found = np.searchsorted(ends_b, ends_a[tried])
        cut = inside & (ends_b[np.minimum(found, len(ends_b) - 1)] == ends_a[tried])
        first, rows = cut.argmax(axis=1), np.arange(len(todo))
        hit = cut[rows, first]
        at[todo[hit]], to[todo[hit]] = tried[rows, first][hit], found[rows, first][hit]
        todo = todo[~hit & inside.any(axis=1)]
        reach, width = reach + width, width * 2
    return at, to


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, borders_a: np.ndarray, borders_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B that end together, in order. Ends run through all documents, whose first tokens, and the number
    of all tokens, are the borders.
    """
    some = np.diff(borders_a) > 0
    lo_a, hi_a, lo_b, hi_b = borders_a[:-1][some], borders_a[1:][some], borders_b[:-1][some], borders_b[1:][some]
    cuts_a, cuts_b = [hi_a - 1], [hi_b - 1]
    while len(lo_a):
        wide = (hi_a - lo_a > 1) & (hi_b - lo_b > 1)
        lo_a, hi_a, lo_b, hi_b = lo_a[wide], hi_a[wide], lo_b[wide], hi_b[wide]
        at, to = _nearest(lo_a, hi_a, ends_a, ends_b)
        hit = at >= 0
        at, to, lo_a, hi_a, lo_b, hi_b = at[hit], to[hit], lo_a[hit], hi_a[hit], lo_b[hit], hi_b[hit]
        cuts_a.append(at)
        cuts_b.append(to)
        lo_a, hi_a = np.concatenate([lo_a, at + 1]), np.concatenate([at + 1, hi_a])
        lo_b, hi_b = np.concatenate([lo_b, to + 1]), np.concatenate([to + 1, hi_b])
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


def _flat(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(raw), np.int32).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw], dtype=np.int64)])


def align(texts: list[str], models) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Per text: numbers of tokens of A, of B and of groups, and the groups as written; ids of A and B of all links."""
    a, b, sizes_a, sizes_b, written = models
    ids_b = b.raw(texts)
    # a byte-level vocabulary spells every text; one that B does not spell has no tokens
    ids_a = a.raw([" " + t if y else "" for t, y in zip(texts, ids_b, strict=True)])
    (flat_a, borders_a), (flat_b, borders_b) = _flat(ids_a), _flat(ids_b)
    cuts_a, cuts_b = shared_cuts(np.cumsum(sizes_a[flat_a]), np.cumsum(sizes_b[flat_b]), borders_a, borders_b)
    groups = np.diff(np.searchsorted(cuts_a, borders_a))
    # groups as text: a token stands behind all tokens of the groups before, those of A before those of B
    last_a, last_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
    last_a[cuts_a] = last_b[cuts_b] = 1
    before_a = np.concatenate([[0], cuts_b + 1])[np.cumsum(last_a) - last_a]
    before_b = (cuts_a + 1)[np.cumsum(last_b) - last_b] if len(cuts_a) else before_a
    codes = np.empty(len(flat_a) + len(flat_b), np.int64)
    codes[np.arange(len(flat_a)) + before_a] = flat_a * 2 + last_a
    codes[np.arange(len(flat_b)) + before_b] = (flat_b + len(sizes_a)) * 2 + last_b
    ends = borders_a + borders_b
    lines = [b"".join(map(written.__getitem__, codes[lo:hi].tolist()))[:-1] for lo, hi in zip(ends, ends[1:], strict=False)]
    return np.diff(borders_a), np.diff(borders_b), groups, lines, flat_a[cuts_a], flat_b[cuts_b]


def _chunks(texts: list[str]):
    """Ranges of rows of about ``_CHUNK`` characters."""
    lo, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= _CHUNK or i == len(texts) - 1:
            yield lo, i + 1
            lo, size = i + 1, 0


def alignments(docs: DataFrame, tokenizers: tuple[str, str, str], id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, links[, groups]): ``links`` are the pairs of linked ids in order, packed as
    32-bit ids of A and B in turn, ``groups`` is the alignment as written. ``tokenizers``: path and split pattern of A, path
    of B.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        models = _models(*tokenizers)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in _chunks(texts):
                n_a, n_b, groups, lines, a, b = align(texts[lo:hi], models)
                links, at = np.stack([a, b], axis=1).astype("<u4").tobytes(), (np.concatenate([[0], np.cumsum(groups)]) * 8).tolist()
                columns = [batch.column("id").slice(lo, hi - lo), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(groups, pa.int64())]
                columns += [pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in lines])]
                columns += [pa.array([links[x:y] for x, y in zip(at, at[1:], strict=False)], pa.binary())]
                columns += [pa.array([x.decode() for x in lines])] if with_groups else []
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_a", "n_b", "n_groups", "groups_sha256", "links", *["groups"] * with_groups])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(work, f"id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary" + ", groups string" * with_groups)


def _small(batches):
    """Slices of a bounded number of rows, since a row holds all links of a document."""
    return (b.slice(lo, _ROWS) for b in batches for lo in range(0, max(b.num_rows, 1), _ROWS))


def _pairs(batch: pa.RecordBatch) -> np.ndarray:
    both = np.frombuffer(b"".join(batch.column("links").to_pylist()), "<u4").astype(np.int64).reshape(-1, 2)
    return both[:, 0] << 32 | both[:, 1]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of ``aligned`` hold a pair of ids (A in the upper half of ``pair``), and whether no
    pair with the same id of B is held by more.
    """

    def count(batches):
        held, size = [], 0

        def merged():
            pairs, place = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            times = np.zeros(len(pairs), np.int64)
            np.add.at(times, place, np.concatenate([n for _, n in held]))
            return pairs, times

        def batch_of(pairs, times):
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "n"])

        for batch in _small(batches):
            held.append(np.unique(_pairs(batch), return_counts=True))
            size += len(held[-1][0])
            if size > _HELD:
                held = [merged()]
                size = len(held[0][0])
                if 2 * size > _HELD:
                    yield batch_of(*held[0])
                    held, size = [], 0
        if held:
            yield batch_of(*merged())

    parts = aligned.select("links").mapInArrow(count, "pair long, n long")
    counts = stage(parts.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    of_b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    highest = counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("highest"))
    return counts.join(highest, of_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def _looked_up(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    found = counts.toArrow()  # at most sent_pairs rows
    order = np.argsort(found["pair"].to_numpy())
    sent = aligned.sparkSession.sparkContext.broadcast(tuple(found[c].to_numpy()[order] for c in ("pair", "n", "best")))
    keep = [f for f in aligned.schema if f.name != "links"]
    names = [f.name for f in keep]

    def look(batches):
        pairs, n, best = sent.value
        for batch in _small(batches):
            at = np.searchsorted(pairs, _pairs(batch))
            borders = np.concatenate([[0], np.cumsum(batch.column("n_groups").to_numpy())])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)])[borders]) for x in (best, n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, sums)], [*names, "n_best", "count_sum"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return aligned.mapInArrow(look, f"{kinds}, n_best long, count_sum long")


def _joined(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    def held(batches):
        for batch in (b.slice(k, 1) for b in batches for k in range(b.num_rows)):
            pairs, times = np.unique(_pairs(batch), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), batch.column("row")[0].as_py())), pa.array(pairs), pa.array(times)], ["row", "pair", "times"])

    links = aligned.select("row", "links").mapInArrow(held, "row long, pair long, times long")
    summed = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = {"n_best": 0, "count_sum": 0}
    return aligned.drop("links").join(summed, "row", "left").fillna(zero, subset=list(zero))


def align_corpus(docs: DataFrame, tokenizers: tuple[str, str, str], id_col: str = "doc_id", text_col: str = "text", sent_pairs: int = 2_000_000, with_groups: bool = False) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]."""
    aligned = stage(alignments(docs, tokenizers, id_col, text_col, with_groups).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stage(pair_counts(aligned), "counts")
    done = _looked_up(aligned, counts) if counts.count() <= sent_pairs else _joined(aligned, counts)
    return done.select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups,
    )
