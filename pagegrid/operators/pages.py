"""Jobs over a corpus of stored pages (page_id, url, html): one pass of native expressions per row."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pagegrid.functions import contacts
from pagegrid.functions.jsonx import graph_objects
from pagegrid.functions.text import canonical_url, clean_text, count_tag, decode_entities, html_lang, meta_content, strip_html, tag_inner, tag_text, visible_text, word_count

c = F.col


def scan(pages: DataFrame, action: str, extract: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One record per page: ``url`` and ``action_type`` lead; a row's own url wins over the page's."""
    out = extract(pages) if extract else pages
    url = F.coalesce(F.nullif(c("row_url"), F.lit("")), c("url")) if "row_url" in out.columns else c("url")
    return out.select(url.alias("url"), F.lit(action).alias("action_type"), *[n for n in out.columns if n not in ("url", "row_url")])


def summary(pages: DataFrame, switches: dict[str, bool] | None = None, carry: Sequence[str] = ("page_id",)) -> DataFrame:
    """Page summary row. Each switch drops its columns; by default all are on. Reads whole texts."""
    on = {k: True for k in ("title", "meta_description", "canonical", "word_count", "headings", "links", "lang")} | (switches or {})
    h, plain = c("html"), c("__plain")
    cols: list[Column] = [c("url").alias("target_url")]
    if on["title"]:
        cols.append(tag_text(h, "title").alias("title"))
    if on["meta_description"]:
        cols.append(F.coalesce(F.nullif(meta_content(h, "description"), F.lit("")), meta_content(h, "og:description", "property")).alias("meta_description"))
    if on["canonical"]:
        cols.append(canonical_url(h).alias("canonical_url"))
    if on["word_count"]:
        cols += [word_count(plain).alias("word_count"), F.char_length(plain).cast("long").alias("char_count")]
    if on["headings"]:
        cols += [count_tag(h, t).alias(f"{t}_count") for t in ("h1", "h2", "h3")]
    if on["links"]:
        cols.append(count_tag(h, "a").alias("link_count"))
    if on["lang"]:
        cols.append(html_lang(h).alias("lang"))
    source = pages.withColumn("__plain", strip_html(h)) if on["word_count"] else pages
    return source.select(*carry, *cols)


def tag_counts(pages: DataFrame, tags: Sequence[str]) -> DataFrame:
    return pages.select("page_id", *[count_tag(c("html"), t).alias(f"{t}_count") for t in tags])


def _attr(tag: Column, name: str) -> Column:
    return decode_entities(F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*["']([^"']*)["']""", 1))


def first_attr(html: Column, tag: str, name: str) -> Column:
    """Attribute of the first ``tag`` element."""
    return clean_text(_attr(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>", 0), name))


def author(html: Column) -> Column:
    by_rel = F.regexp_extract(html, r"""(?is)<(\w+)\b[^>]*\brel\s*=\s*["']author["'][^>]*>(.*?)</\1>""", 2)
    return F.coalesce(F.nullif(clean_text(meta_content(html, "author")), F.lit("")), strip_html(by_rel))


def publish_date(html: Column) -> Column:
    return F.coalesce(F.nullif(clean_text(meta_content(html, "article:published_time", "property")), F.lit("")), first_attr(html, "time", "datetime"))


def main_text(html: Column) -> Column:
    """Text of main, else article, else the body; static stand-in for rendered text."""
    options = [F.nullif(strip_html(tag_inner(html, t)), F.lit("")) for t in ("main", "article")]
    return F.coalesce(*options, visible_text(html))


def text_rows(pages: DataFrame, metadata: bool = True, max_content: int | None = None, excerpt: int = 280) -> DataFrame:
    """Article text row with the first ``excerpt`` characters; the content is whole unless ``max_content`` cuts it."""
    h, body = c("html"), c("__main")
    meta = (lambda col: col) if metadata else (lambda col: F.lit(""))
    return pages.withColumn("__main", main_text(h)).select(
        "page_id", "url",
        clean_text(tag_text(h, "title")).alias("title"),
        clean_text(meta_content(h, "description")).alias("description"),
        meta(author(h)).alias("author"),
        meta(publish_date(h)).alias("publish_date"),
        meta(clean_text(canonical_url(h))).alias("canonical_url"),
        meta(html_lang(h)).alias("lang"),
        strip_html(tag_inner(h, "h1")).alias("h1"),
        count_tag(h, "h2").alias("h2_count"),
        count_tag(h, "p").alias("paragraph_count"),
        word_count(body).alias("word_count"),
        F.left(body, F.lit(excerpt)).alias("excerpt"),
        (body if max_content is None else F.left(body, F.lit(max_content))).alias("content"),
    )


def email_rows(pages: DataFrame, mailto: bool = True, **options) -> DataFrame:
    h = c("html")
    found = contacts.emails(visible_text(h), contacts.mailto_links(h) if mailto else None, **options)
    rows = pages.select("page_id", "url", found.alias("emails"))
    return rows.select("page_id", "url", "emails", F.size("emails").cast("long").alias("email_count"), contacts.email_domains(c("emails")).alias("email_domains"))


def phone_rows(pages: DataFrame, **options) -> DataFrame:
    rows = pages.select("page_id", "url", contacts.phones(visible_text(c("html")), **options).alias("phones"))
    return rows.select("page_id", "url", "phones", F.size("phones").cast("long").alias("phone_count"))


# -- JSON-LD and page metadata -----------------------------------------------------------------

_LD = r"""(?is)<script\b[^>]*\btype\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""


def jsonld_nodes(pages: DataFrame) -> DataFrame:
    """Flattened JSON-LD nodes (page_id, path, node); bad JSON is skipped.

    Arrays and ``@graph`` lists open at any depth, inside the row and in one pass.
    """
    scripts = pages.select("page_id", F.posexplode(F.regexp_extract_all(c("html"), F.lit(_LD), F.lit(1))).alias("s", "body"))
    opened = scripts.select("page_id", "s", F.explode(graph_objects(F.try_parse_json("body"))).alias("x"))
    return opened.select("page_id", F.concat(F.array("s"), c("x.path")).alias("path"), F.parse_json("x.node").alias("node"))


def _types(node: Column) -> Column:
    many = F.try_variant_get(node, "$['@type']", "array<string>")
    one = F.try_variant_get(node, "$['@type']", "string")
    raw = F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
    return F.filter(F.transform(raw, clean_text), lambda x: x != "")


def jsonld_rollup(pages: DataFrame, keep: int | None = None) -> DataFrame:
    """Per page: script and node counts, sorted types, review count, rating count, nodes (all, or the first ``keep``)."""
    n = jsonld_nodes(pages).select("page_id", "path", "node", _types(c("node")).alias("types"))
    count = F.coalesce(
        F.try_variant_get("node", "$.aggregateRating.reviewCount", "string"), F.try_variant_get("node", "$.aggregateRating.ratingCount", "string")
    ).try_cast("double")
    placed = F.sort_array(F.collect_list(F.struct("path", F.to_json("node").alias("j"))))
    first = F.transform(placed if keep is None else F.slice(placed, 1, keep), lambda x: x["j"])
    per_page = n.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("node_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("schema_types"),
        F.count_if(F.exists("types", lambda x: F.lower(x) == "review")).alias("review_count"),
        F.coalesce(F.sum(count), F.lit(0.0)).alias("rating_count"),
        first.alias("first_nodes"),
    )
    scripts = pages.select("page_id", F.regexp_count("html", F.lit(_LD)).cast("long").alias("script_count"))
    zero = lambda name: F.coalesce(name, F.lit(0))
    return scripts.join(per_page, "page_id", "left").select(
        "page_id", "script_count", zero("node_count").alias("node_count"),
        F.coalesce("schema_types", F.array().cast("array<string>")).alias("schema_types"),
        zero("review_count").alias("review_count"), F.coalesce("rating_count", F.lit(0.0)).alias("rating_count"),
        F.coalesce("first_nodes", F.array().cast("array<string>")).alias("first_nodes"),
    )


def metadata_rows(pages: DataFrame, meta: bool = True, jsonld: bool = True, reviews: bool = True, contact: bool = True, raw: bool = False) -> DataFrame:
    """Page metadata row: meta, Open Graph and card tags, JSON-LD roll-up, contact signals, language."""
    h = c("html")

    def tag(key: str, by: str = "name") -> Column:
        return clean_text(meta_content(h, key, by)) if meta else F.lit("")

    mails, numbers = contacts.signal_counts(c("__text"))
    base = pages.withColumn("__text", visible_text(h) if contact else F.lit("")).select(
        "page_id", "url",
        clean_text(tag_text(h, "title")).alias("title"),
        tag("description").alias("description"),
        (author(h) if meta else F.lit("")).alias("author"),
        (publish_date(h) if meta else F.lit("")).alias("publish_date"),
        (clean_text(canonical_url(h)) if meta else F.lit("")).alias("canonical_url"),
        tag("og:title", "property").alias("og_title"),
        tag("og:description", "property").alias("og_description"),
        tag("og:type", "property").alias("og_type"),
        tag("og:image", "property").alias("og_image"),
        tag("twitter:card").alias("twitter_card"),
        (count_tag(h, "meta") if meta else F.lit(0).cast("long")).alias("meta_tag_count"),
        mails.alias("email_count"), numbers.alias("phone_count"),
        html_lang(h).alias("detected_lang"),
    )
    if jsonld:
        roll = jsonld_rollup(pages)
        base = base.join(roll, "page_id").select(
            *base.columns, F.array_join("schema_types", " | ").alias("schema_types"), F.size("schema_types").cast("long").alias("schema_type_count"),
            c("script_count").alias("jsonld_scripts"), c("node_count").alias("jsonld_nodes"),
            (c("review_count") if reviews else F.lit(0)).cast("long").alias("review_count"),
            (c("rating_count") if reviews else F.lit(0.0)).alias("rating_count"),
            *([F.left(F.concat(F.lit("["), F.array_join("first_nodes", ","), F.lit("]")), F.lit(6000)).alias("jsonld_preview")] if raw else []),
        )
    else:
        zero = F.lit(0).cast("long")
        base = base.select(
            *base.columns, F.lit("").alias("schema_types"), zero.alias("schema_type_count"), zero.alias("jsonld_scripts"),
            zero.alias("jsonld_nodes"), zero.alias("review_count"), F.lit(0.0).alias("rating_count"),
        )
    return base


#: the built-in runners and the row job each one names
RUNNERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "EXTRACT_PAGES_EMAIL": email_rows,
    "EXTRACT_PAGES_PHONE": phone_rows,
    "EXTRACT_PAGES_TEXT": text_rows,
    "EXTRACT_METADATA": metadata_rows,
    "EXTRACT_SUMMARY": summary,
}


def run(name: str, pages: DataFrame) -> DataFrame:
    if name not in RUNNERS:
        raise KeyError(f"unknown runner {name}; have {sorted(RUNNERS)}")
    return pages.transform(RUNNERS[name])
