"""Queries of the corpus operators, with production parameters over whole tables, and their oracle SQL."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrid.llm import (
    collocations,
    exact_dedup,
    language_id,
    license_scan,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    simhash,
    suffix_dedup,
    token_alignment,
    url_filter,
)
from pagegrid.plans.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: file and split pattern of the byte-level vocabulary that documents are packed with
TOKENIZER = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query("op1_balanced_shards")
def shards(spark, sf_dir):
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op2_quality_classifier")
def classifier(spark, sf_dir):
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_suffix_dedup")
def suffixes(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op4_source_mixing")
def source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "slots")


@query("op5_license_scan")
def licenses(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op6_simhash")
def near(spark, sf_dir):
    grouped = simhash.near_groups(table(spark, sf_dir, "documents"))
    return grouped.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_packing")
def packed(spark, sf_dir):
    return packing.packed_documents(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op8_language_id")
def languages(spark, sf_dir):
    return language_id.learn_and_identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query("op9_quality_rules")
def rules(spark, sf_dir):
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query("op10_exact_dedup", """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d""")
def exact(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: rules of op11 (verdict, host, path), fixed by its contract
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: words in the names of hosts whose pages make up the list; no table holds a list of URLs
HOST_WORDS = ["ads", "adult", "bets", "betting", "casino", "gambling", "pills", "poker", "porn", "spam", "viagra", "xxx"]

_URL = "(SELECT page_id, url, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS h, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\\?([^#]*)', 1) AS q FROM pages)"


@query("op11_url_filter", rf"""
WITH u AS (SELECT *, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM {_URL}),
k AS (SELECT *, regexp_replace(host, '^www\.|:(80|443)$', '', 'g') AS ch, regexp_replace(regexp_replace(path, '/index\.html?$', ''), '/+$', '') AS cp,
  array_to_string(list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{url_filter.TRACKING}'))), '&') AS cq FROM u),
c AS (SELECT *, CASE WHEN ch <> '' THEN ch || CASE WHEN cp = '' THEN '/' ELSE cp END || CASE WHEN coalesce(cq, '') = '' THEN '' ELSE '?' || cq END END AS canonical_url FROM k),
listed AS (SELECT DISTINCT canonical_url AS url FROM c WHERE list_has_any(regexp_split_to_array(host, '[.-]'), {HOST_WORDS}) AND canonical_url IS NOT NULL),
r AS (SELECT c.*, listed.url IS NOT NULL AS listed, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM c LEFT JOIN listed ON c.canonical_url = listed.url)
SELECT page_id, host, path, canonical_url, rule, listed,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM r""")
def urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.urls_on_hosts(pages, HOST_WORDS), URL_RULES)


#: A: byte-level vocabulary and its split pattern; B: pieces
TOKENIZERS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_token_alignment")
def aligned(spark, sf_dir):
    return token_alignment.align_corpus(table(spark, sf_dir, "documents"), TOKENIZERS)


@query("op13_phrases", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]') AS pieces FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(unnest(pieces), '[ 	]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
f1 AS (SELECT lang, g, count(*)::BIGINT AS a FROM (SELECT lang, unnest(w) AS g FROM w) GROUP BY 1, 2),
f2 AS (SELECT lang, g, count(*)::BIGINT AS a FROM (SELECT lang, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1) GROUP BY 1, 2),
f3 AS (SELECT lang, g, count(*)::BIGINT AS a FROM (SELECT lang, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) > 2) GROUP BY 1, 2),
c2 AS (SELECT *, split_part(g, ' ', 1) AS w1, split_part(g, ' ', 2) AS w2 FROM f2 WHERE a >= 10),
c3 AS (SELECT *, split_part(g, ' ', 1) AS w1, split_part(g, ' ', 3) AS w3, split_part(g, ' ', 1) || ' ' || split_part(g, ' ', 2) AS p1, split_part(g, ' ', 2) || ' ' || split_part(g, ' ', 3) AS p2 FROM f3 WHERE a >= 10),
longest AS (SELECT lang, g, max(a) AS longer FROM (SELECT lang, p1 AS g, a FROM c3 UNION ALL SELECT lang, p2, a FROM c3) GROUP BY 1, 2),
cuts AS (
  SELECT c.lang, c.g, 1 AS j, c.a, x.a AS l, y.a AS r FROM c2 c JOIN f1 x ON x.lang = c.lang AND x.g = c.w1 JOIN f1 y ON y.lang = c.lang AND y.g = c.w2
    LEFT JOIN longest o ON o.lang = c.lang AND o.g = c.g WHERE o.longer IS NULL OR 100 * o.longer < 50 * c.a
  UNION ALL SELECT c.lang, c.g, 1, c.a, x.a, y.a FROM c3 c JOIN f1 x ON x.lang = c.lang AND x.g = c.w1 JOIN f2 y ON y.lang = c.lang AND y.g = c.p2
  UNION ALL SELECT c.lang, c.g, 2, c.a, x.a, y.a FROM c3 c JOIN f2 x ON x.lang = c.lang AND x.g = c.p1 JOIN f1 y ON y.lang = c.lang AND y.g = c.w3),
scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS turn FROM scored),
kept AS (SELECT lang, g AS phrase, a, l, r, score::BIGINT AS score FROM best WHERE turn = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN t ON t.lang = ranked.lang WHERE rank <= 2000""")
def phrases(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))
