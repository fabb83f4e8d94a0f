"""Link edges, bounded-depth crawl over stored pages, URL enrichment."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagegrid.functions import contacts
from pagegrid.functions.urls import harvestable, let, origin, parts, resolve_on, serialise
from pagegrid.plans.lineage import cut, stage

c = F.col
_HREF = r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']"""


def page_links(pages: DataFrame, same_host: bool = True, cap: int | None = None) -> DataFrame:
    """(url, link, pos): first distinct links of each page in document order, up to ``cap`` per page if given.

    All per-page work happens inside the row as array expressions; there is no shuffle.
    """

    def links(base: Column) -> Column:
        raw = F.regexp_extract_all(c("html"), F.lit(_HREF), F.lit(1))
        found = F.filter(F.transform(raw, lambda v: resolve_on(v, base)), lambda u: u != "")
        if same_host:
            found = F.filter(found, lambda u: let(parts(u), lambda p: (p["host"] == base["host"]) & (p["port"] == base["port"])))
        found = F.array_distinct(found)
        return F.slice(found, 1, max(1, cap)) if cap else found

    based = pages.withColumn("__base", parts(c("url"))).filter(c("__base").isNotNull())
    return based.select(serialise(c("__base")).alias("url"), F.posexplode(links(c("__base"))).alias("i", "link")).select(
        "url", "link", (c("i") + 1).cast("long").alias("pos")
    )


def crawl(seeds: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """Breadth-first reach (seed, url, depth) over stored edges, each url once per seed at its least depth.

    Each hop is an equi join on the page url followed by an anti join with what was
    reached before; hops are written to the shared folder so a lost executor costs one hop at most.
    """
    depth = max(1, int(depth))
    frontier = cut(seeds.select(c("url").alias("seed"), c("url")).distinct())
    reached = frontier.select("seed", "url", F.lit(0).alias("depth"))
    links = stage(edges.select("url", "link").distinct(), "edges")  # every hop joins it: extract links once
    for hop in range(1, depth + 1):
        step = frontier.join(links, "url").select("seed", c("link").alias("url")).distinct()
        frontier = cut(step.join(reached, ["seed", "url"], "left_anti"))
        reached = reached.unionByName(frontier.select("seed", "url", F.lit(hop).alias("depth")))
    return reached


#: a page that more links lead to than this is joined in parts; the number of such pages stays below ``_MOST_HUBS``
_HUB, _MOST_HUBS = 10_000, 1_000


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``id``, numbers that grow in ``order``, without gaps inside a range: neighbours share a word of 64 bits."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())


def _by_hub(edges: DataFrame, key: str, hubs: DataFrame, side: DataFrame) -> DataFrame:
    """``edges`` joined to ``side`` (column ``key``); the edges of a hub go to as many parts as it has (``hub``, ``parts``)."""
    sent = F.broadcast(hubs)  # fewer than _MOST_HUBS rows
    own = edges.join(sent, edges[key] == sent["hub"], "left").drop("hub")
    own = own.withColumn("part", F.pmod(F.xxhash64(*edges.columns), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    other = side.join(sent, side[key] == sent["hub"], "left").drop("hub")
    other = other.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)).cast("int") - 1))).drop("parts")
    return own.join(other, [key, "part"]).drop("part")


def _hubs(edges: DataFrame, key: str) -> DataFrame:
    """(hub, parts) of the keys that many rows of ``edges``, a staged table, share."""
    most = max(_HUB, edges.count() // _MOST_HUBS + 1)
    return edges.groupBy(c(key).alias("hub")).agg(F.count(F.lit(1)).alias("n")).filter(c("n") > most).select("hub", F.ceil(c("n") / most).alias("parts"))


def _marks(df: DataFrame, page: str, kind: int, mark: str) -> DataFrame:
    """Sets as words: (page, kind, word, bits)."""
    return df.select(c(page).alias("page"), F.lit(kind).alias("kind"), F.shiftright(mark, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), c(mark).bitwiseAND(63).cast("int")).alias("bits"))


def _united(sets: DataFrame) -> DataFrame:
    return sets.groupBy("page", "kind", "word").agg(F.bit_or("bits").alias("bits"))


def deep_scan(pages: DataFrame, depth: int = 1, cap: int | None = None, **options) -> DataFrame:
    """E-mails of each page joined by those of pages reachable within ``depth`` links of it: (url, scanned_pages,
    email_count), a row per distinct url.

    Pages outside the corpus are skipped like failed fetches and links are followed only from pages that are stored.

    What a page reaches, and the addresses found there, are sets of bits. Pages are numbered by host, and links stay on a
    host, so 64 neighbours share a word and no pair of pages is ever stored. A hop unites the sets of the pages linked to;
    it ends early when no set grows.
    """
    known = pages.withColumn("__p", parts(c("url"))).filter(c("__p").isNotNull()).withColumn("host", c("__p.host")).withColumn("url", serialise(c("__p")))
    numbered = stage(_numbered(known.select("host", "url").distinct(), "host", "url"), "numbered")
    links = stage(page_links(pages, cap=cap).select("url", "link").distinct(), "links")
    to = _by_hub(links, "link", _hubs(links, "link"), numbered.select(c("url").alias("link"), c("id").alias("dst")))
    edges = stage(to.join(numbered.select("url", c("id").alias("page")), "url").select("page", "dst").filter("page <> dst"), "edges")
    mails = stage(known.select("url", F.explode(contacts.emails(c("html"), **options)).alias("email")).join(numbered.select("url", "id"), "url").select(c("id").alias("page"), "email").distinct(), "mails")
    # addresses are numbered by the first page they stand on
    named = _numbered(mails.groupBy("email").agg(F.min("page").alias("first")), "first", "email")
    held = mails.join(stage(named.select("email", c("id").alias("mail")), "named"), "email")
    start = stage(_united(_marks(numbered, "id", 0, "id").unionByName(_marks(held, "page", 1, "mail"))), "reach")
    reach, size, hubs = start, None, stage(_hubs(edges, "dst"), "hubs")
    for _ in range(max(1, int(depth))):
        step = _by_hub(edges, "dst", hubs, reach.withColumnRenamed("page", "dst")).drop("dst")
        reach = stage(_united(start.unionByName(step.select(*start.columns))), "reach")
        before, size = size, reach.agg(F.sum(F.bit_count("bits"))).first()[0]
        if size == before:
            break
    bits = lambda kind: F.sum(F.when(c("kind") == kind, F.bit_count("bits")).otherwise(0))
    found = reach.groupBy("page").agg((bits(0) - 1).alias("scanned_pages"), bits(1).alias("email_count"))
    return found.join(numbered, c("page") == c("id")).select("url", c("scanned_pages").cast("long").alias("scanned_pages"), c("email_count").cast("long").alias("email_count"))


_URL = r"""(?i)https?://[^\s)"'<>]+"""


def row_urls(df: DataFrame, data: Column, source_url: Column | None = None, position: str | None = None) -> DataFrame:
    """Distinct normalised URLs in any value of the rows (search engines left out), first position kept."""
    values = F.map_values(data)
    if source_url is not None:
        values = F.concat(F.array(F.coalesce(source_url, F.lit(""))), values)
    found = F.flatten(
        F.transform(values, lambda v: let(F.regexp_extract_all(F.coalesce(v, F.lit("")), F.lit(_URL), F.lit(0)), lambda m: F.when(F.size(m) > 0, m).otherwise(F.array(F.coalesce(v, F.lit(""))))))
    )
    pos = c(position) if position else F.lit(0)
    urls = df.select(pos.alias("first_seen"), F.explode(found).alias("raw")).select("first_seen", harvestable(c("raw")).alias("url")).filter("url <> ''")
    return urls.groupBy("url").agg(F.min("first_seen").alias("first_seen"))


def enrich(urls: DataFrame, metadata: DataFrame, limit: int | None = None) -> DataFrame:
    """Join discovered urls to page metadata; the reference cap is a parameter."""
    picked = urls.orderBy("first_seen", "url").limit(limit) if limit else urls
    return picked.join(metadata, "url", "left")
