"""Link graph of the stored pages and URL enrichment."""
from __future__ import annotations

from pyspark.sql import functions as F

from pagegrid.functions.text import tag_text
from pagegrid.operators import links, rows
from pagegrid.plans.registry import query
from pagegrid.queries import sqltext as s

c = F.col

_CAP = f"""WITH l AS (SELECT page_id, url, list_transform(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1), lambda h: {s.absolute('h', 'url')}) AS raw FROM pages),
  k AS (SELECT {s.url_full('url')} AS url, list_filter(raw, lambda u: u <> '' AND {s.url_host('u')} = {s.url_host('url')}) AS ok FROM l),
  f AS (SELECT url, list_slice({s.first_of_each('ok')}, 1, 3) AS top FROM k) SELECT url, unnest(top) AS link, CAST(generate_subscripts(top, 1) AS BIGINT) AS pos FROM f"""


@query("t07_link_cap", _CAP)
def _(t):
    return links.page_links(t.pages, same_host=True, cap=3)


#: the stored pages never link to each other, so the walk runs on the order graph: each customer
#: page links to the customer pages of its suppliers' keys
_EDGES = "SELECT DISTINCT o_custkey AS src, (o_orderkey * 7) % 1500 AS dst FROM orders"


@query(
    "j10_crawl",
    f"""WITH RECURSIVE e AS ({_EDGES}), seeds AS (SELECT DISTINCT s_suppkey AS seed FROM supplier),
      w AS (SELECT seed, seed AS node, 0 AS depth FROM seeds UNION SELECT w.seed, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 2)
      SELECT seed, node, CAST(min(depth) AS INT) AS depth FROM w GROUP BY 1, 2""",
)
def _(t):
    e = t.orders.select(c("o_custkey").alias("url"), ((c("o_orderkey") * 7) % 1500).alias("link"))
    r = links.crawl(t.supplier.select(c("s_suppkey").alias("url")), e, depth=2)
    return r.select("seed", c("url").alias("node"), "depth")


@query(
    "j10_deep_scan",
    f"SELECT {s.url_full('url')} AS url, CAST(0 AS BIGINT) AS scanned_pages, CAST(len(list_distinct({s.emails('html')})) AS BIGINT) AS email_count FROM pages",
)
def _(t):
    return links.deep_scan(t.pages, depth=2)


#: customer pages that link to each other, with addresses that several of them share
@query(
    "j10_linked_scan",
    f"""WITH RECURSIVE e AS ({_EDGES}), p AS (SELECT DISTINCT src FROM e), k AS (SELECT e.src, e.dst FROM e JOIN p ON p.src = e.dst),
      w AS (SELECT src AS seed, src AS node, 0 AS depth FROM p UNION SELECT w.seed, k.dst, w.depth + 1 FROM w JOIN k ON k.src = w.node WHERE w.depth < 2)
      SELECT concat('https://h.example/c/', CAST(seed AS VARCHAR)) AS url, count(DISTINCT node) - 1 AS scanned_pages, count(DISTINCT node % 40) AS email_count FROM w GROUP BY seed""",
)
def _(t):
    link = F.concat(F.lit('<a href="/c/'), (c("o_orderkey") * 7) % 1500, F.lit('">x</a>'))
    made = t.orders.select(c("o_custkey").alias("page_id"), link.alias("link")).groupBy("page_id").agg(F.array_join(F.collect_set("link"), "").alias("links"))
    html = F.concat(F.lit("<body>mail"), c("page_id") % 40, F.lit("@h.example "), c("links"), F.lit("</body>"))
    return links.deep_scan(made.select("page_id", F.concat(F.lit("https://h.example/c/"), "page_id").alias("url"), html.alias("html")), depth=2)


_ROW_URLS = f"""WITH v AS (SELECT page_id, url AS v FROM pages UNION ALL SELECT page_id, 'see ' || replace(url, 'http:', 'https:') || ' or "https://www.google.com/search?q=' || page_id || '" now' FROM pages),
  e AS (SELECT page_id, unnest(regexp_extract_all(v, '(?i)https?://[^\\s)"''<>]+')) AS raw FROM v), n AS (SELECT page_id, {s.url_full('raw')} AS url FROM e WHERE NOT contains({s.url_host('raw')}, 'google.'))
  SELECT url, min(page_id) AS first_seen FROM n GROUP BY url"""


def _row_urls(t):
    note = F.concat(F.lit("see "), F.replace("url", F.lit("http:"), F.lit("https:")), F.lit(' or "https://www.google.com/search?q='), "page_id", F.lit('" now'))
    return links.row_urls(t.pages.select("page_id", "url", note.alias("note")), rows.as_map(["note"]), c("url"), "page_id")


@query("f21_row_urls", _ROW_URLS)
def _(t):
    return _row_urls(t)


@query("j13_enrichment", f"WITH u AS (SELECT * FROM ({_ROW_URLS})), m AS (SELECT {s.url_full('url')} AS url, {s.tag_text('html', 'title')} AS title FROM pages) SELECT u.url, first_seen, title FROM u LEFT JOIN m ON m.url = u.url")
def _(t):
    from pagegrid.functions.urls import parts, let, serialise

    meta = t.pages.select(let(parts(c("url")), lambda p: serialise(p)).alias("url"), tag_text(c("html"), "title").alias("title"))
    return links.enrich(_row_urls(t), meta)
