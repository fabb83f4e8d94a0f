"""Language identification by bit-sliced n-gram filters.

Each language has a Bloom filter of its n-grams. The filters are stored bit-sliced: a position holds one bit per language,
so one lookup of an n-gram returns the set of all languages that contain it (the AND of its positions). Per document the
hits are counted per language; a filter's own false-positive rate, known from how full it is, is taken out of its count;
the largest corrected count decides.

The filters are fitted on a bounded sample (``fit_docs`` documents per language, chosen by the hash of id and text) and have a fixed size
(``positions`` times one word per 64 languages), whatever the corpus. Prediction covers whole texts, row by row.

Defined results: a null text, or one without a letter, is ``und`` with score 0; rows with a null language are not learned
from; without any training row every text is ``und``; ids may be null or repeat (a null id counts as held out); columns
beyond id, text and language are not read.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrid.plans.lineage import cut

#: characters hashed at a time; longer texts are taken in overlapping pieces
_CHUNK = 1 << 19
#: counts of languages are sent to every task only up to this many
_SENT_LANGUAGES = 10_000


def held_out(id_col: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def letters_of(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")


def _chunks(texts: list[str], n: int):
    """(row numbers, lengths, characters) of pieces of texts, each piece wrapped in blanks, about ``_CHUNK`` at a time."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        text = f" {text.strip()} "
        for lo in range(0, max(len(text) - n + 1, 1), _CHUNK):
            part = text[lo : lo + _CHUNK + n - 1]
            rows.append(i)
            parts.append(part)
            size += len(part)
            if size >= _CHUNK:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def gram_hashes(parts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams, and the number of the part each stands in."""
    joined = "\0".join(parts)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(chars) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    wide = chars.astype(np.uint64)
    h, last = np.zeros(len(chars) - n + 1, np.uint64), len(chars) - n + 1
    inside = np.ones(last, bool)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + last] + np.uint64(1)
        inside &= chars[k : k + last] != 0
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    part = np.cumsum(chars == 0)[:last]
    return h[inside], part[inside]


@dataclass
class Filters:
    """Bit-sliced Bloom filters: ``slices[p, w]`` has a bit per language (64 to a word)."""

    languages: list[str]
    slices: np.ndarray
    hashes: int
    n: int

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], positions: int, hashes: int, n: int) -> Filters:
        languages = sorted(grams)
        made = cls(languages, np.zeros((positions, (len(languages) + 63) // 64), np.uint64), hashes, n)
        for i, language in enumerate(languages):
            for at in made._places(grams[language]):
                made.slices[at, i // 64] |= np.uint64(1) << np.uint64(i % 64)
        return made

    def _places(self, h: np.ndarray):
        step = (h >> np.uint64(32)) | np.uint64(1)
        for k in range(self.hashes):
            yield ((h + np.uint64(k) * step) % np.uint64(len(self.slices))).astype(np.int64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Words of language bits for each n-gram."""
        found = np.full((len(h), self.slices.shape[1]), ~np.uint64(0))
        for at in self._places(h):
            found &= self.slices[at]
        return found

    def false_positives(self) -> np.ndarray:
        fill = [np.count_nonzero(self.slices[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / len(self.slices) for i in range(len(self.languages))]
        return np.power(fill, self.hashes)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hits per text and language, and n-grams per text."""
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for rows, parts in _chunks(texts, self.n):
            h, part = gram_hashes(parts, self.n)
            row = np.array(rows)
            found = self.lookup(h)
            np.add.at(total, row, np.bincount(part, minlength=len(parts)))
            for i in range(len(self.languages)):
                bit = (found[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)
                np.add.at(hits[:, i], row, np.bincount(part[bit], minlength=len(parts)))
        return hits, total

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        hits, total = self.counts(texts)
        rate = self.false_positives()
        real = np.clip((hits - total[:, None] * rate) / np.maximum(1 - rate, 1e-9), 0, None)
        best = real.argmax(axis=1)
        top = np.take_along_axis(real, best[:, None], 1)[:, 0]
        second = np.partition(real, -2, axis=1)[:, -2] if real.shape[1] > 1 else np.zeros(len(texts))
        return [self.languages[i] for i in best], np.where(top > 0, top / np.maximum(top + second, 1e-9), 0.0)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", n: int = 3, fit_docs: int = 4000, profile: int = 20_000, share: float = 0.25, least: int = 3, positions: int = 1 << 19, hashes: int = 3) -> Filters | None:
    """Filters from ``docs``, which hold training rows only. An n-gram belongs to a language if its rate there is at least
    ``share`` of its highest rate; a language keeps its ``profile`` most frequent ones.
    """
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where("text is not null")
    per = known.groupBy("lang").agg(F.count("*").alias("n"))
    # rows are drawn one by one: copies of a text are not taken or left together
    part = (F.xxhash64("id", "text").bitwiseAND((1 << 30) - 1) / float(1 << 30)) < F.lit(float(fit_docs)) / F.col("n")
    # joined inside the scan: only n-gram counts are shuffled
    per = F.broadcast(per) if per.count() <= _SENT_LANGUAGES else per
    sample = known.join(per, "lang").where(part).select("lang", letters_of(F.col("text")).alias("text"))

    def count(batches):
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                for _, parts in _chunks(list(own["text"]), n):
                    grams, times = np.unique(gram_hashes(parts, n)[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "times": times})

    grams = cut(sample.mapInPandas(count, "lang string, gram long, times long").groupBy("lang", "gram").agg(F.sum("times").alias("times")))
    totals = grams.groupBy("lang").agg(F.sum("times").alias("total"))
    rated = grams.join(totals, "lang").withColumn("rate", F.col("times") / F.col("total"))
    highest = rated.groupBy("gram").agg(F.max("rate").alias("highest"))
    held = rated.join(highest, "gram").where((F.col("rate") >= share * F.col("highest")) & (F.col("times") >= least))
    ranked = held.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("times"), "gram"))).where(F.col("rank") <= profile)
    found = ranked.select("lang", "gram").toPandas()
    if found.empty:
        return None
    return Filters.build({lang: own["gram"].to_numpy(np.int64).view(np.uint64) for lang, own in found.groupby("lang")}, positions, hashes, n)


def identify(docs: DataFrame, filters: Filters | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    # without a letter there is nothing to look up
    read = docs.select(F.col(id_col).alias("id"), F.when(text.rlike(r"\p{L}"), letters_of(text)).alias("text"))
    if filters is None:
        return read.select(F.col("id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # a fixed number of bytes

    def predict(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            some = [i for i, t in enumerate(texts) if t is not None]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if some:
                found, score[some] = sent.value.predict([texts[i] for i in some])
                for i, name in zip(some, found, strict=True):
                    lang[i] = name
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    return read.mapInArrow(predict, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def learn_and_identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Per row: id, held_out, lang_pred, score; learns from the rows that are not held out."""
    filters = fit(docs.where(~held_out(F.col(id_col))), text_col, lang_col, id_col, **options)
    return identify(docs, filters, id_col, text_col).withColumn("held_out", held_out(F.col(id_col)))
