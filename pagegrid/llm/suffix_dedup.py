"""Removal of byte strings of ``length`` bytes that start at more than one place, by external induced sorting.

A text is cut at anchors: the place of the smallest hash among the ``ANCHOR``-byte strings of a window. Equal windows have
their anchor at the same place inside, so the windows of one anchor (a segment) meet all windows that can equal them in the
class of its anchor hash. Spark deals classes to tasks; identical segments are counted, not moved. Inside a class suffixes
are sorted by induction: suffixes that start at the anchor are sorted once, and the order and common-prefix values of the
suffixes one byte further left follow from theirs (the byte in front decides, ties keep their order, a common prefix is one
more than the least of those between). A window is repeated if the common prefix with a neighbour reaches ``length``.

The tuples wait in Spark's external sort by class, which spills to disk: a task holds one class, or about ``_BATCH``
segments of small ones, however large its share is. A class of more than ``crowd`` different segments is not sorted in one
task; its windows are named by hash and counted by all tasks.

Defined results: null texts count as empty; texts shorter than ``length`` lose nothing; ids may be null or repeat (a row
that repeats another's text is another place, so both lose it); columns beyond id and text are not read.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrid.llm.common import same_row, text_key, text_of
from pagegrid.plans.lineage import stage

#: bytes of an anchor string; a power of two
ANCHOR = 128
#: bytes hashed at a time, and segments sorted at a time
_CHUNK, _BATCH = 1 << 18, 20_000

_random = np.random.default_rng(20240)
_BYTES = _random.integers(0, 2**64, 256, dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left * _A
    h += right
    h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return h


def _names(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of ANCHOR bytes and of ``size`` bytes (ANCHOR <= size); longer names come from two shorter."""
    h, step = _BYTES[data], 1
    anchor = h
    while step * 2 <= size:
        h = _join(h[:-step], h[step:])
        step *= 2
        if step == ANCHOR:
            anchor = h
    rest = size - step
    return anchor, _join(h[: len(h) - rest], h[rest:]) if rest else h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    pad = -len(x) % w
    blocks = np.concatenate([x, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """Segments of the texts ``data[starts:ends]``: (text number, anchor hash, content hash, first window, last window,
    anchor), places counted from the start of the text.
    """
    if len(data) < length:
        return [np.empty(0, np.int64)] * 6
    anchor, name = _names(data, length)
    low = np.uint64((1 << 20) - 1)
    # the leftmost of equal hashes wins
    packed = (anchor & ~low) | np.arange(len(anchor), dtype=np.uint64)
    at = (_sliding_min(packed, length - ANCHOR + 1) & low).astype(np.int64)
    owner = np.searchsorted(starts, np.arange(len(at)), side="right") - 1
    inside = np.arange(len(at)) <= ends[owner] - length
    q = np.flatnonzero(inside)
    if not len(q):
        return [np.empty(0, np.int64)] * 6
    new = np.flatnonzero(np.concatenate([[True], (at[q][1:] != at[q][:-1]) | (owner[q][1:] != owner[q][:-1])]))
    first, last = q[new], q[np.concatenate([new[1:], [len(q)]]) - 1]
    content = _join(_join(name[first], name[last]), (last - first).astype(np.uint64))
    text = owner[first]
    base = starts[text]
    return text, anchor[at[first]].view(np.int64), content.view(np.int64), first - base, last - base, at[first] - base


def _pieces(texts: list[bytes], length: int):
    """(row, first byte, bytes) of texts, in batches of about _CHUNK; pieces of long texts overlap by length - 1."""
    batch, size = [], 0
    for row, text in enumerate(texts):
        for lo in range(0, max(len(text) - length + 1, 0), _CHUNK):
            part = text[lo : lo + _CHUNK + length - 1]
            batch.append((row, lo, part))
            size += len(part)
            if size >= _CHUNK:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


def repeated_windows(group: np.ndarray, segs: list[bytes], anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(flags, offsets): for each window of each segment whether it stands in another segment of its group too.

    ``group`` numbers the classes, ``anchor`` is the place of the anchor in the segment. Suffixes at the anchor are sorted;
    then order and common prefixes are induced byte by byte to the left.
    """
    sizes = np.array([len(s) for s in segs], np.int64)
    windows = sizes - length + 1
    offsets = np.concatenate([[0], np.cumsum(windows)])
    flags = np.zeros(offsets[-1], bool)
    flat = np.frombuffer(b"".join(segs) + bytes(length), np.uint8)
    pos = np.concatenate([[0], np.cumsum(sizes)[:-1]]) + anchor
    right = np.minimum(sizes - anchor, length)
    tails = [s[a:] for s, a in zip(segs, anchor, strict=True)]
    idx = np.array(sorted(range(len(segs)), key=lambda i: (group[i], tails[i])), np.int64)
    lcp = np.zeros(len(segs) + 1, np.int64)  # lcp[k]: of the suffixes at k - 1 and k; the last is a border
    for lo in range(1, len(idx), 4096):
        one, two = idx[lo - 1 : min(lo + 4095, len(idx) - 1)], idx[lo : lo + 4096]
        span = np.arange(length)
        differs = flat[pos[one][:, None] + span] != flat[pos[two][:, None] + span]
        same = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
        lcp[lo : lo + len(two)] = np.where(group[one] == group[two], np.minimum(same, np.minimum(right[one], right[two])), 0)

    def mark(step: int) -> None:
        near = np.maximum(lcp[:-1], lcp[1:]) >= length
        hit = idx[near]
        at = anchor[hit] - step
        ok = (at >= 0) & (at < windows[hit])
        flags[offsets[hit[ok]] + at[ok]] = True

    mark(0)
    for step in range(1, int(anchor.max(initial=0)) + 1):
        old = np.flatnonzero(anchor[idx] >= step)
        if len(old) < 2:
            break
        key = group[idx[old]].astype(np.int64) * 256 + flat[pos[idx[old]] - step]
        turn = np.argsort(key, kind="stable")
        src, key = old[turn], key[turn]
        fresh = np.zeros(len(src) + 1, np.int64)
        k = np.flatnonzero(key[1:] == key[:-1]) + 1
        if len(k):
            bounds = np.column_stack([src[k - 1] + 1, src[k] + 1]).ravel()
            fresh[k] = np.minimum(np.minimum.reduceat(lcp, bounds)[::2] + 1, length)
        idx, lcp = idx[src], fresh
        mark(step)
    return flags, offsets


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - 1


def _segment_table(docs: DataFrame, length: int, kind: str) -> DataFrame:
    def find(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for pieces in _pieces(texts, length):
                data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
                sizes = np.array([len(p[2]) for p in pieces], np.int64)
                ends = np.cumsum(sizes)
                number, h, content, first, last, at = segments(data, ends - sizes, ends, length)
                row, lo = np.array([p[0] for p in pieces], np.int64)[number], np.array([p[1] for p in pieces], np.int64)[number]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("key").take(take), pa.array(h), pa.array(content), pa.array(first + lo), pa.array(last + lo), pa.array(at + lo)],
                    ["id", "key", "h", "content", "first", "last", "anchor"],
                )

    return docs.mapInArrow(find, f"id {kind}, key long, h long, content long, first long, last long, anchor long")


def _by_class(batches, length: int, work):
    """Rows come sorted by class; ``work`` gets whole classes, about _BATCH rows at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < _BATCH:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        h = table.column("h").to_numpy()
        border = int(np.searchsorted(h, h[-1]))  # the last class may go on
        if border:
            yield work(table.slice(0, border))
        held, rows = table.slice(border).to_batches(), len(table) - border
    if rows:
        yield work(pa.Table.from_batches(held).combine_chunks())


def repeats(docs: DataFrame, length: int, crowd: int) -> DataFrame:
    """(id, key, first, last): runs of windows of a text that stand elsewhere too. ``docs``: id, key, text as bytes."""
    kind = docs.schema["id"].dataType.simpleString()
    table = stage(_segment_table(docs, length, kind), "segments")
    # equal segments are one variant; a variant keeps one of its places
    variants = table.groupBy("h", "content").agg(F.count("*").alias("places"), *[F.first(c).alias(c) for c in ("id", "key", "first", "last", "anchor")])
    classes = variants.groupBy("h").agg(F.sum("places").alias("all"), F.count("*").alias("variants"), F.count(F.when(F.col("places") == 1, 1)).alias("single")).where("all > 1")
    known = stage(variants.join(classes, "h"), "variants")
    whole = table.join(known.where("places > 1").select("h", "content"), ["h", "content"]).select("id", "key", "first", "last")
    open_ = known.where("variants > 1 and single > 0")
    wanted = open_.groupBy("id", "key").agg(F.collect_list(F.struct("h", "places", "first", "last", "anchor", "variants")).alias("segs"))
    # a row that repeats another sends its segments twice: these are known to be repeated anyway
    once = docs.join(wanted, same_row(docs, wanted, "id", "key")).select(docs["id"], docs["key"], "text", "segs")

    def cut_out(batches):
        names = ["h", "places", "first", "last", "anchor", "variants"]
        for batch in batches:
            row, fields, data = [], {n: [] for n in names}, []
            for i, (text, segs) in enumerate(zip(batch.column("text").to_pylist(), batch.column("segs").to_pylist(), strict=True)):
                for s in segs:
                    row.append(i)
                    data.append(text[s["first"] : s["last"] + length])
                    for n in names:
                        fields[n].append(s[n])
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("key").take(take), *[pa.array(fields[n], pa.int64()) for n in names], pa.array(data, pa.binary())], ["id", "key", *names, "data"],
            )

    moved = once.mapInArrow(cut_out, f"id {kind}, key long, h long, places long, first long, last long, anchor long, variants long, data binary")

    def sort(batches):
        def work(rows: pa.Table) -> pa.RecordBatch:
            h, first = rows.column("h").to_numpy(), rows.column("first").to_numpy()
            group = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
            flags, offsets = repeated_windows(group, rows.column("data").to_pylist(), rows.column("anchor").to_numpy() - first, length)
            border = np.zeros(len(flags) + 1, bool)
            border[offsets] = True
            owner = np.searchsorted(offsets, np.arange(len(flags)), side="right") - 1
            flags &= rows.column("places").to_numpy()[owner] == 1
            hit = np.flatnonzero(flags)
            new = np.concatenate([[True], (np.diff(hit) != 1) | border[hit[1:]]]) if len(hit) else np.empty(0, bool)
            lo = hit[new]
            hi = hit[np.concatenate([np.flatnonzero(new)[1:], [len(hit)]]) - 1] if len(hit) else lo
            own = owner[lo]
            take = pa.array(own)
            picked = [rows.column(c).combine_chunks().take(take) for c in ("id", "key")]
            picked = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in picked]
            return pa.RecordBatch.from_arrays([*picked, pa.array(first[own] + lo - offsets[own]), pa.array(first[own] + hi - offsets[own])], ["id", "key", "first", "last"])

        yield from _by_class(batches, length, work)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shape = f"id {kind}, key long, first long, last long"
    sorted_ = moved.where(F.col("variants") <= crowd).repartition(n, "h").sortWithinPartitions("h").mapInArrow(sort, shape)

    def name_windows(batches):
        for batch in batches:
            for i, data in enumerate(batch.column("data").to_pylist()):
                _, name = _names(np.frombuffer(data, np.uint8), length)
                take = pa.array(np.full(len(name), i))
                at = batch.column("first")[i].as_py() + np.arange(len(name))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in ("id", "key", "h", "places")], pa.array(name.view(np.int64)), pa.array(at)], ["id", "key", "h", "places", "name", "at"])

    named = moved.where(F.col("variants") > crowd).mapInArrow(name_windows, f"id {kind}, key long, h long, places long, name long, at long")
    crowded = named.join(named.groupBy("h", "name").agg(F.count("*").alias("n")).where("n > 1").drop("n"), ["h", "name"])
    return whole.unionByName(sorted_).unionByName(crowded.where("places = 1").select("id", "key", F.col("at").alias("first"), F.col("at").alias("last")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, crowd: int = _BATCH, with_text: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed [from, to) in bytes)[, kept bytes]."""
    if length < 2 * ANCHOR:
        raise ValueError(f"length must be {2 * ANCHOR} or more")
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), text_of(F.col(text_col)).cast("binary").alias("text"))
    found = repeats(read, length, crowd).groupBy("id", "key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    joined = read.join(found, same_row(read, found, "id", "key"), "left").select(read["id"], "text", "runs")

    def finish(batches):
        for batch in batches:
            out = []
            for raw, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                spans: list[list[int]] = []
                for lo, hi in sorted((r["first"], r["last"] + length) for r in runs or ()):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
                edges = [0, *[x for s in spans for x in s], len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, *([kept] if with_text else [])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), *([pa.binary()] if with_text else [])]
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["kept"] * with_text])

    shape = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>" + ", kept binary" * with_text
    return joined.mapInArrow(finish, shape).withColumnRenamed("id", id_col)
