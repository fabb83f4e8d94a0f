"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join.

The list may be large. Its canonical URLs set bits in a filter of 64-byte blocks: a key picks one block and one bit in each
of its eight words, so a lookup reads one block. Spark ors the bits per block; the filter has a fixed upper size, whatever
the list, and is sent to the tasks. Pages it does not pass are certainly not listed and are never shuffled. The URLs of
the others join the list itself, which removes the false positives. URLs are joined once each, however many pages
share them; what is confirmed is copied to ``salts`` parts, so that pages with one and the same URL spread over as many tasks.

Rules of one's own (allow or block a host with all subdomains, from a path on) come before the list: the longest rule
that fits decides. They are a parameter, become one conditional expression, and are limited to ``MOST_RULES``.

Defined results: a null URL, or one without ``://``, has empty host and path, no canonical URL, and is allowed; ids may be
null or repeat; null entries of the list are left out and repeated ones count once; an empty list or table is fine; columns
of ``pages`` beyond id and URL are not read.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrid.plans.lineage import stage

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: query parameters that name where a visitor came from, not what the page is
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|msclkid|sessionid|sid)(=|$)"
MOST_RULES = 1000


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without trailing slashes and index page, query without tracking
    parameters and in order, no scheme and no fragment. Null where there is no host.
    """
    host = F.regexp_replace(host_of(url), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept))))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as ``host`` + ``path``, its verdict) of the longest of ``rules`` (verdict, host, path) that fits; else nulls."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules; put more into the list")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(own + start)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _bit(place: Column, word: int) -> Column:
    return F.shiftrightunsigned(place, 6 * word).bitwiseAND(63)


def bloom(listed: DataFrame, key_bits: int, most_bytes: int) -> np.ndarray:
    """Blocks of eight words of the canonical URLs ``url``. ``most_bytes`` bounds the size; beyond it more URLs pass."""
    blocks = max(1, min(math.ceil(listed.count() * key_bits / 512), most_bytes // 64))
    keyed = listed.select(F.pmod(F.xxhash64("url"), F.lit(blocks)).alias("block"), F.xxhash64(F.lit(1), "url").alias("place"))
    bits = keyed.select("block", *[_bit(F.col("place"), w).cast("int").alias(f"b{w}") for w in range(8)])
    words = bits.groupBy("block").agg(*[F.bit_or(F.expr(f"shiftleft(1L, b{w})")).alias(f"w{w}") for w in range(8)]).toArrow()  # a row per block
    made = np.zeros((blocks, 8), np.int64)
    for w in range(8):
        made[words["block"].to_numpy(), w] = words[f"w{w}"].to_numpy()
    return made.view(np.uint64)


def _passes(filtered: np.ndarray, block: np.ndarray, place: np.ndarray) -> np.ndarray:
    out, place = np.ones(len(block), bool), place.view(np.uint64)
    for w in range(8):
        out &= (filtered[block, w] >> (place >> np.uint64(6 * w) & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def possible_hits(pages: DataFrame, filtered: np.ndarray, url_col: str) -> DataFrame:
    """``pages`` with ``maybe``: whether the filter passes ``url_col`` (false where it is null)."""
    sent = pages.sparkSession.sparkContext.broadcast(filtered)
    keep = pages.columns
    keyed = pages.select("*", F.pmod(F.xxhash64(url_col), F.lit(len(filtered))).alias("_block"), F.xxhash64(F.lit(1), url_col).alias("_place"))

    def look(batches):
        for batch in batches:
            passed = _passes(sent.value, batch.column("_block").to_numpy(), batch.column("_place").to_numpy())
            passed &= np.asarray(batch.column(url_col).is_valid())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(passed)], [*keep, "maybe"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return keyed.mapInArrow(look, f"{kinds}, maybe boolean")


def with_listed(pages: DataFrame, listed: DataFrame, url_col: str, out: str = "listed", key_bits: int = 16, most_bytes: int = 16 << 20, salts: int = 32) -> DataFrame:
    """``pages`` with ``out``: whether ``url_col``, a canonical URL, stands in ``listed`` (a column ``url``)."""
    own = stage(listed.where("url is not null").select("url").distinct(), "listed")
    looked = stage(possible_hits(pages, bloom(own, key_bits, most_bytes), url_col), "looked")
    maybe = looked.where("maybe")
    confirmed = own.join(maybe.select(F.col(url_col).alias("url")).distinct(), "url")
    spread = confirmed.select(F.col("url").alias("_url"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_part"))
    # rows are dealt in turn, so equal rows spread as well
    parted = maybe.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    joined = parted.join(spread, (F.col(url_col) == F.col("_url")) & (F.col("_salt") == F.col("_part")), "left")
    return looked.where("not maybe").select(*pages.columns, F.lit(False).alias(out)).unionByName(joined.select(*pages.columns, F.col("_url").isNotNull().alias(out)))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """Per row: id, host, path, canonical_url, rule, listed, verdict (``allow`` or ``block``)."""
    url = F.col(url_col)
    read = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical_url"))
    found = with_listed(read, listed, "canonical_url", **options)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return found.select(
        F.col("id").alias(id_col), "host", "path", "canonical_url", rule.alias("rule"), "listed", F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )


def urls_on_hosts(pages: DataFrame, words: list[str], url_col: str = "url") -> DataFrame:
    """A list made of ``pages``: canonical URLs on hosts that have one of ``words`` between dots and hyphens."""
    named = F.arrays_overlap(F.split(host_of(F.col(url_col)), r"[.-]"), F.array(*[F.lit(w) for w in words]))
    return pages.where(named).select(canonical(F.col(url_col)).alias("url"))
