"""Phrase collocations by Rabin-Karp fingerprints.

The fingerprint of a byte range is a difference of prefix polynomials modulo 2^64, times a power of the base's inverse, so
all words of a chunk of text are hashed by a few array operations; a second level of prefix polynomials over the words'
fingerprints hashes every n-gram. A second, independent polynomial is the check of a fingerprint.

Level by level (words, pairs, triples) tasks count fingerprints and keep a pointer to one occurrence (the document);
the shuffle adds counts and keeps the least pointer and the least and the greatest check. An n-gram is frequent only if
its two parts of n - 1 words are, so a level skips what the Bloom filter of the level before (a fixed size; it may pass
too much, never too little) holds infrequent. A fingerprint with two checks stands for different texts: its occurrences
are counted again by their text. Only frequent phrases become text, read at their pointers, and scoring joins the counts
of their parts by fingerprint and check.

Defined results: null texts are empty; a null language is ``und``; phrases never cross a break or a document; ids may be
null or repeat; an empty table gives an empty result; columns beyond id, text and language are not read. Scores are exact
below 1e15 words per language (products of 38 digits). A text is read in parts cut at breaks; a part without any break is
hashed as one.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrid.plans.lineage import stage

#: bytes hashed at a time, and n-grams counted in a task before they are handed on
_CHUNK, _HELD = 1 << 20, 1 << 21
#: bases of the two polynomials; odd, so that they have inverses modulo 2^64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_FILTER_BITS = 1 << 26

_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: blank, 2: break
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@lru_cache(maxsize=2)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        powers = np.full(size, b, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return tuple(out)


def range_hashes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of ``values[lo:hi]`` for each range, by differences of prefix sums."""
    powers, inverse = _powers(base, max(_CHUNK + 1, 1 << int(len(values)).bit_length()))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers[: len(values)], out=prefix[1:])
    return mixed((prefix[hi] - prefix[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))


class Words:
    """The words of a chunk of normalised documents, their places and hashes. ``data``: bytes; ``borders``: of documents."""

    def __init__(self, data: np.ndarray, borders: np.ndarray, seeds: np.ndarray, bits: int):
        self.data = _LOWER[data]
        kind = _KIND[data]
        first = np.zeros(len(data) + 1, bool)
        first[borders] = True  # a document begins
        word = kind == 0
        self.lo = np.flatnonzero(word & (first[:-1] | ~np.concatenate([[False], word[:-1]])))
        self.hi = np.flatnonzero(word & (first[1:] | ~np.concatenate([word[1:], [False]]))) + 1
        self.doc = np.searchsorted(borders, self.lo, side="right") - 1
        self.piece = np.cumsum(kind == 2)[self.lo] if len(data) else self.lo
        self.seeds, self.bits = seeds, bits
        self.hashes = [range_hashes(self.data, self.lo, self.hi, b) for b in _BASES]

    def starts(self, n: int) -> np.ndarray:
        """Words at which ``n`` words stand in one piece."""
        i = np.arange(max(len(self.lo) - n + 1, 0))
        return i[(self.piece[i] == self.piece[i + n - 1]) & (self.doc[i] == self.doc[i + n - 1])]

    def grams(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and check of the ``n`` words from each of ``at``; the language of the document is part of both."""
        seed = self.seeds[self.doc[at]]
        fp, check = (mixed(range_hashes(h, at, at + n, b) ^ seed) for h, b in zip(self.hashes, _BASES, strict=True))
        return fp >> np.uint64(64 - self.bits), check

    def text(self, at: int, n: int) -> str:
        return b" ".join(self.data[self.lo[k] : self.hi[k]].tobytes() for k in range(at, at + n)).decode()


def _chunks(batch: pa.RecordBatch):
    """(row, bytes) of parts of texts, about ``_CHUNK`` bytes at a time; long texts are cut behind a break."""
    held, size = [], 0
    for row, text in enumerate(batch.column("text")):
        raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and len(text.as_buffer()) else np.empty(0, np.uint8)
        breaks = np.flatnonzero(_KIND[raw] == 2) + 1 if len(raw) > _CHUNK else None
        at = 0
        while at < len(raw):
            end = len(raw)
            if end - at > _CHUNK and (k := np.searchsorted(breaks, at + _CHUNK)) < len(breaks):
                end = int(breaks[k])
            held.append((row, raw[at:end]))
            size += end - at
            at = end
            if size >= _CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def words_of(batch: pa.RecordBatch, bits: int):
    """(rows, Words) for chunks of a batch (doc, lang, text)."""
    langs = batch.column("lang").to_pylist()
    seeds = {x: range_hashes(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x.encode())]), _BASES[1])[0] for x in set(langs)}
    for held in _chunks(batch):
        rows = np.array([row for row, _ in held])
        borders = np.concatenate([[0], np.cumsum([len(x) for _, x in held])])
        yield rows, Words(np.concatenate([x for _, x in held]), borders[:-1], np.array([seeds[langs[r]] for r in rows], np.uint64), bits)


class Filter:
    """A Bloom filter of a fixed size; without one everything passes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def passes(self, fps: np.ndarray) -> np.ndarray:
        out = np.ones(len(fps), bool)
        for place in _places(fps):
            out &= (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def _places(fps: np.ndarray):
    h = mixed(fps.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    yield h % np.uint64(_FILTER_BITS)
    yield (h >> np.uint64(32)) % np.uint64(_FILTER_BITS)


def filter_of(frequent: DataFrame) -> Filter:
    """The filter of the fingerprints ``fp``, as words of 64 bits that Spark ors: at most ``_FILTER_BITS`` / 64 rows."""

    def words(batches):
        for batch in batches:
            place = np.concatenate(list(_places(batch.column("fp").to_numpy().view(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], ["word", "bits"])

    made = frequent.select("fp").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(_FILTER_BITS // 64, np.uint64)
    bits[made["word"].to_numpy()] = made["bits"].to_numpy().view(np.uint64)
    return Filter(bits)


def _counted(fps, checks, times, docs):
    """Sums per (fingerprint, check) with the least pointer."""
    order = np.lexsort((docs, checks, fps))
    fps, checks, docs = fps[order], checks[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], (fps[1:] != fps[:-1]) | (checks[1:] != checks[:-1])])) if len(fps) else np.empty(0, np.int64)
    return fps[first], checks[first], np.add.reduceat(times[order], first) if len(first) else times[:0], docs[first]


def level(docs: DataFrame, n: int, parts: Filter | None, bits: int) -> DataFrame:
    """(fp, a, doc, low, high) per fingerprint of ``n`` words whose two parts of n - 1 words may be frequent."""
    sent = docs.sparkSession.sparkContext.broadcast(parts) if parts else None

    def count(batches):
        held, size = [], 0

        def batch_of():
            fps, checks, times, ids = _counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(checks.view(np.int64)), pa.array(times), pa.array(ids)], ["fp", "check", "n", "doc"])

        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for rows, words in words_of(batch, bits):
                at = words.starts(n)
                if sent:
                    every = np.arange(max(len(words.lo) - n + 2, 0))
                    passed = sent.value.passes(words.grams(every, n - 1)[0])
                    at = at[passed[at] & passed[at + 1]]
                fps, checks = words.grams(at, n)
                held.append(_counted(fps, checks, np.ones(len(at), np.int64), ids[rows[words.doc[at]]]))
                size += len(held[-1][0])
                if size > _HELD:
                    yield batch_of()
                    held, size = [], 0
        if held:
            yield batch_of()

    found = docs.mapInArrow(count, "fp long, check long, n long, doc long")
    return found.groupBy("fp").agg(F.sum("n").alias("a"), F.min("doc").alias("doc"), F.min("check").alias("low"), F.max("check").alias("high"))


def _texts(docs: DataFrame, n: int, wanted: Filter, bits: int) -> DataFrame:
    """(fp, check, phrase, doc, a): occurrences of ``n`` words whose fingerprint may be wanted, by their text."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches):
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for rows, words in words_of(batch, bits):
                at = words.starts(n)
                fps, checks = words.grams(at, n)
                some = sent.value.passes(fps)
                for lo in range(0, int(some.sum()), 1 << 16):
                    part = np.flatnonzero(some)[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fps[part].view(np.int64)), pa.array(checks[part].view(np.int64)), pa.array([words.text(k, n) for k in at[part]]), pa.array(ids[rows[words.doc[at[part]]]])], ["fp", "check", "phrase", "doc"])

    found = docs.mapInArrow(count, "fp long, check long, phrase string, doc long")
    return found.groupBy("fp", "check", "phrase").agg(F.count("*").alias("a"), F.min("doc").alias("doc"))


def frequent(docs: DataFrame, n: int, parts: Filter | None, least: int, bits: int) -> DataFrame:
    """(fp, check, a, doc) of the n-grams counted at least ``least`` times."""
    counted = stage(level(docs, n, parts, bits).where(F.col("a") >= least), f"grams{n}")
    single = counted.where("low = high").select("fp", F.col("low").alias("check"), "a", "doc")
    met = counted.where("low <> high").select("fp")
    if met.isEmpty():
        return single
    again = _texts(docs, n, filter_of(met), bits).join(met, "fp", "left_semi").where(F.col("a") >= least)
    return stage(single.unionByName(again.select("fp", "check", "a", "doc")), f"recounted{n}")


def _part(i: int, j: int) -> str:
    return f"p{i}{j}"


#: places of the parts of a phrase of two and of three words
_PARTS = {2: [(0, 1), (1, 2)], 3: [(0, 1), (1, 3), (0, 2), (2, 3)]}


def materialised(docs: DataFrame, wanted: DataFrame, n: int, bits: int) -> DataFrame:
    """(lang, phrase, fp, check, a, parts): the text of each wanted n-gram, read at its pointer, and the fingerprints and
    checks of its parts.
    """
    per = wanted.groupBy("doc").agg(F.collect_list(F.struct("fp", "check", "a")).alias("wanted"))  # at most the n-grams of a document
    part = "struct<fp:bigint,check:bigint>"
    names = [_part(i, j) for i, j in _PARTS[n]]

    def read(batches):
        for batch in batches:
            langs, asked = batch.column("lang").to_pylist(), batch.column("wanted").to_pylist()
            seen = set()
            for rows, words in words_of(batch, bits):
                at = words.starts(n)
                fps, checks = (x.view(np.int64).tolist() for x in words.grams(at, n))
                doc, place = rows[words.doc[at]].tolist(), {}
                for k, key in enumerate(zip(doc, fps, checks, strict=True)):
                    place.setdefault(key, k)
                found = [(r, w, k) for r in dict.fromkeys(rows.tolist()) for w in asked[r] if (k := place.get((r, w["fp"], w["check"]))) is not None and (r, w["fp"], w["check"]) not in seen]
                seen.update((r, w["fp"], w["check"]) for r, w, _ in found)
                if not found:
                    continue
                start = at[[k for _, _, k in found]]
                columns = [pa.array([langs[r] for r, _, _ in found]), pa.array([words.text(k, n) for k in start]), *(pa.array([w[c] for _, w, _ in found], pa.int64()) for c in ("fp", "check", "a"))]
                for i, j in _PARTS[n]:
                    columns.append(pa.StructArray.from_arrays([pa.array(x.view(np.int64)) for x in words.grams(start + i, j - i)], ["fp", "check"]))
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "fp", "check", "a", *names])

    kinds = "lang string, phrase string, fp long, check long, a long, " + ", ".join(f"{x} {part}" for x in names)
    # rows with the same pointer are copies of one text
    return docs.join(per, "doc").mapInArrow(read, kinds).dropDuplicates(["fp", "check"])


def _score(a: str, left: str, right: str) -> Column:
    wide = f"cast({a} as decimal(15,0))"
    return F.expr(f"cast(floor(({wide} * {wide} * cast(1000000 as decimal(7,0))) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))) as bigint)")


def _with_counts(phrases: DataFrame, counts: dict[int, DataFrame], n: int) -> DataFrame:
    """Adds the counts of all parts: ``f`` and the places."""
    for i, j in _PARTS[n]:
        p = _part(i, j)
        own = counts[j - i].select(F.col("fp").alias("_fp"), F.col("check").alias("_check"), F.col("a").alias(f"f{i}{j}"))
        phrases = phrases.join(own, (F.col(f"{p}.fp") == F.col("_fp")) & (F.col(f"{p}.check") == F.col("_check"))).drop("_fp", "_check")
    return phrases


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = 10, inside: int = 50, top: int = 2000, bits: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two and three words of each language.

    A phrase needs ``least`` places, and goes if a longer one around it has at least ``inside`` percent of its places.
    ``bits``: width of the fingerprints (results do not depend on it).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.xxhash64(F.col(id_col), text).alias("doc"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text.alias("text"))
    words = F.size(F.array_remove(F.split("text", r"[\x20\x09.,;:!?\x0A-\x0D]+"), "")).cast("long")
    totals = read.groupBy("lang").agg(F.sum(words).alias("n"))
    one = frequent(read, 1, None, least, bits)
    two = frequent(read, 2, filter_of(one), least, bits)
    three = frequent(read, 3, filter_of(two), least, bits)
    counts = {1: one, 2: two}
    pairs = _with_counts(stage(materialised(read, two, 2, bits), "pairs"), counts, 2)
    triples = stage(_with_counts(stage(materialised(read, three, 3, bits), "triples"), counts, 3), "triples")
    # a pair inside a triple is its first or its last two words
    around = triples.select(F.explode(F.array(*[F.struct(F.col(f"{p}.fp").alias("fp"), F.col(f"{p}.check").alias("check"), "a") for p in ("p02", "p13")])).alias("x")).select("x.*")
    largest = around.groupBy("fp", "check").agg(F.max("a").alias("longer"))
    alone = pairs.join(largest, ["fp", "check"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside))
    scored2 = alone.select("lang", "phrase", "a", F.col("f01").alias("l"), F.col("f12").alias("r"), _score("a", "f01", "f12").alias("score"))
    cuts = triples.withColumns({"s1": _score("a", "f01", "f13"), "s2": _score("a", "f02", "f23")})
    first = F.col("s1") <= F.col("s2")
    scored3 = cuts.select(
        "lang", "phrase", "a", F.when(first, F.col("f01")).otherwise(F.col("f02")).alias("l"), F.when(first, F.col("f13")).otherwise(F.col("f23")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored2.unionByName(scored3).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
