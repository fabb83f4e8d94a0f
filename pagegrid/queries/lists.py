"""Node table, selectors, list extraction and auto-detection over the stored pages."""
from __future__ import annotations

from pyspark.sql import functions as F

from pagegrid.operators import autodetect as auto
from pagegrid.operators import nodes as nt
from pagegrid.plans.lineage import stage, stage_by
from pagegrid.plans.registry import query
from pagegrid.plans.tables import spread
from pagegrid.queries import sqltext as s

c = F.col


def _nodes(t):
    return stage(nt.node_table(t.pages), "nodes")


_TAGS = ("a", "article", "b", "body", "br", "div", "footer", "h1", "head", "html", "li", "meta", "nav", "p", "title", "ul")


@query("x01_node_table", " UNION ALL ".join(f"SELECT page_id, '{k}' AS tag, {s.count_tag('html', k)} AS n FROM pages WHERE regexp_matches(html, {s.q(rf'(?i)<{k}' + chr(92) + 'b')})" for k in _TAGS))
def _(t):
    return nt.elements(nt.node_table(t.pages)).filter(c("tag").isin(*_TAGS)).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


_LI = """WITH l AS (SELECT page_id, url, regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a></li>', 1) AS hrefs, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS names FROM pages), e AS (SELECT page_id, url, unnest(hrefs) AS href, unnest(names) AS name FROM l)"""


@query("x02_list_rows", f"{_LI} SELECT page_id, name, href AS raw, {s.absolute('href', 'url')} AS link, count(*) AS n FROM e WHERE trim(name) <> '' GROUP BY ALL")
def _(t):
    rows = nt.extract_list(
        t.pages, "nav > ul > li",
        [{"name": "name", "selector": "a"}, {"name": "raw", "selector": "a", "extractMode": "attribute", "attribute": "href"}, {"name": "link", "relativeSelector": "a[href]", "extractMode": "link_url"}],
    )
    return rows.groupBy("page_id", "name", "raw", "link").agg(F.count(F.lit(1)).alias("n"))


# selector -> how many of the n list items of a page it names
_SELECTORS = {
    "nav li:not(:first-child)": "len(hrefs) - 1", "nav li + li > a": "len(hrefs) - 1", "nav li ~ li": "len(hrefs) - 1", "nav li:nth-child(2n+1)": "(len(hrefs) + 1) // 2",
    "nav li:last-child, nav li:nth-child(1)": "least(len(hrefs), 2)", "nav li:nth-of-type(2) a[href]": "least(len(hrefs) - 1, 1)",
}


@query("x02_selector_counts", f"""{_LI}, k AS ({" UNION ALL ".join(f"SELECT page_id, '{k}' AS selector, CAST({v} AS BIGINT) AS n FROM l WHERE len(hrefs) > 0" for k, v in _SELECTORS.items())}) SELECT * FROM k WHERE n > 0""")
def _(t):
    n = stage(nt.node_table(t.pages), "nodes")
    counts = [nt.select(n, k).groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).withColumn("selector", F.lit(k)) for k in _SELECTORS]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


@query("x02_scoped_rows", f"{_LI} SELECT page_id, name, count(*) AS n FROM e WHERE trim(name) <> '' GROUP BY ALL")
def _(t):
    rows = nt.extract_list(t.pages, "nav > ul > li", [{"name": "name", "selector": ":scope > a"}, {"name": "none", "selector": ":scope > li"}])
    return rows.filter("none = ''").groupBy("page_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query("x02_page_fields", f"SELECT page_id, url, {s.tag_text('html', 'h1')} AS headline, regexp_extract(html, '<li><a href=\"([^\"]*)\"', 1) AS first_link FROM pages")
def _(t):
    return nt.extract_fields(t.pages, [{"name": "headline", "selector": "article h1"}, {"name": "first_link", "selector": "nav li a", "extractMode": "attribute", "attribute": "href"}])


@query("x06_link_selector", f"{_LI}, k AS (SELECT url, {s.absolute('href', 'url')} AS link, row_number() OVER () AS rn FROM e) SELECT DISTINCT url, link FROM k")
def _(t):
    return nt.selected_links(t.pages, "nav a[href]").select("url", "link")


@query("x03_selectors", "SELECT page_id, 'body > nav > ul > li:nth-of-type(2) > a' AS selector, 'body > nav > ul > li > a' AS general FROM pages WHERE html LIKE '%</li><li>%'")
def _(t):
    n = _nodes(t)
    return nt.absolute_selectors(n, nt.select(n, "li:nth-of-type(2) a")).select("page_id", "selector", nt.generalise(c("selector")).alias("general"))


@query(
    "x03_attribute_hints",
    """SELECT page_id, 'a' AS tag, 'link_url' AS mode, '' AS attribute, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS n FROM pages WHERE contains(html, '<a href=')
      UNION ALL SELECT page_id, 'div', 'attribute', 'class', CAST(len(regexp_extract_all(html, '<div class=')) AS BIGINT) FROM pages WHERE contains(html, '<div class=')""",
)
def _(t):
    n = nt.elements(nt.node_table(t.pages)).select("page_id", "tag", F.explode(nt.attribute_hints()).alias("h"))
    return n.groupBy("page_id", "tag", "h.mode", "h.attribute").agg(F.count(F.lit(1)).alias("n"))


# -- paged lists: each customer's pages lead from one to the next, and every other list leads back to its first page


def _steps(t):
    return spread(t.customer, "c_custkey").select(c("c_custkey").alias("run_id"), F.explode(F.sequence(F.lit(1), (c("c_custkey") % 5 + 2).cast("int"))).alias("step"), (c("c_custkey") % 5 + 2).cast("int").alias("last"))


def _paged(t):
    after = F.when(c("step") < c("last"), c("step") + 1).when(c("run_id") % 2 == 0, F.lit(1))
    link = F.when(after.isNotNull(), F.concat(F.lit('<li class="next"><a href="/c/'), "run_id", F.lit("/"), after, F.lit('">on</a></li>'))).otherwise("")
    html = F.concat(F.lit('<body><ul><li><a href="/c/'), "run_id", F.lit('">all</a></li>'), link, F.lit("</ul></body>"))
    return _steps(t).select((c("run_id") * 10 + c("step")).alias("page_id"), F.concat(F.lit("https://shop.example.com/c/"), "run_id", F.lit("/"), "step").alias("url"), html.alias("html"), "run_id", "step")


_PAGED = "SELECT c_custkey AS run_id, unnest(range(1, c_custkey % 5 + 3)) AS step, c_custkey % 5 + 2 AS last FROM customer"
_AFTER = "CASE WHEN step < last THEN step + 1 WHEN run_id % 2 = 0 THEN 1 END"


@query("x04_next_links", f"SELECT run_id * 10 + step AS page_id, 'https://shop.example.com/c/' || run_id || '/' || ({_AFTER}) AS next_url FROM ({_PAGED}) WHERE ({_AFTER}) IS NOT NULL")
def _(t):
    pages = _paged(t)
    return auto.next_links(pages, stage(nt.node_table(pages), "nodes"))


@query("w09_next_link_cycles", f"SELECT run_id, CAST(last AS INT) AS step, 'next_link_cycle' AS stop_reason FROM ({_PAGED}) WHERE step = last AND run_id % 2 = 0")
def _(t):
    pages = stage(_paged(t), "paged")
    found = auto.next_links(pages, stage(nt.node_table(pages), "nodes"))
    return auto.navigation_cycle(pages.join(found, "page_id", "left").select("run_id", "step", "url", "next_url"))


# -- order pages: each order's lines as a card list, since the stored pages hold no cards ------------------

_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def _lines(t):
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", c("l_quantity").cast("int").alias("qty"), "l_returnflag", "l_linestatus")
    # an order's lines are few by nature, so one row per order holds them; the explicit partition
    # count keeps the page parsing that follows spread out
    n = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    return t.lineitem.repartition(n, "l_orderkey").groupBy(c("l_orderkey").alias("page_id")).agg(F.sort_array(F.collect_list(one)).alias("lines"))


def _order_pages(t):
    card = F.transform("lines", lambda x: F.concat(F.lit('<li class="card hot x'), x["l_returnflag"], F.lit('"><a href="/p/'), x["l_partkey"], F.lit('">Part '), x["l_partkey"], F.lit("</a><b>"), x["qty"], F.lit(" pcs</b></li>")))
    button = F.when(c("page_id") % 2 == 0, F.lit("<button> Load  more</button>")).otherwise("")
    html = F.concat(F.lit("<html><body><nav><ul><li>One</li><li>Two</li><li>Three</li></ul></nav><div><ul>"), F.array_join(card, ""), F.lit("</ul></div>"), button, F.lit('<a href="/n">Next page</a></body></html>'))
    return _lines(t).select("page_id", F.lit("https://shop.example.com/o").alias("url"), html.alias("html"))


def _order_nodes(t):
    return nt.nodes_by_page(_order_pages(t))


_CARDS = f"""WITH l AS (SELECT l_orderkey AS page_id, l_partkey, CAST(l_quantity AS INT) AS qty, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}, CAST(l_quantity AS INT), l_returnflag, l_linestatus) AS pos FROM lineitem),
  g AS (SELECT page_id, count(*) AS n, avg(length('Part ' || l_partkey || ' ' || qty || ' pcs')) FILTER (WHERE pos <= 6) AS chars, least(8, count(*)) AS sampled,
    count(DISTINCT l_partkey) FILTER (WHERE pos <= 3) AS ua, count(DISTINCT qty) FILTER (WHERE pos <= 3) AS ub, max('https_shop_example_com_p_' || l_partkey) FILTER (WHERE pos = 1) AS na, max(qty || '_pcs') FILTER (WHERE pos = 1) AS nb FROM l GROUP BY 1),
  f AS (SELECT page_id, n, 2 * sampled + ua AS sa, 2 * sampled + ub + 0.5 AS sb, na, nb FROM g WHERE n >= 3),
  r AS (SELECT page_id, na AS name, 'a' AS selector, 'link_url' AS mode, CASE WHEN sa >= sb THEN 0 ELSE 1 END AS rank FROM f UNION ALL SELECT page_id, nb, 'b', 'text', CASE WHEN sa >= sb THEN 1 ELSE 0 END FROM f)"""
_NAV_SCORE = "6 + (11.0 / 3) / 8 - 0.6"


@query("x04_load_more", "SELECT DISTINCT l_orderkey AS page_id, CASE WHEN l_orderkey % 2 = 0 THEN 'click_button' ELSE 'navigate' END AS method, CASE WHEN l_orderkey % 2 = 0 THEN 'body > button' ELSE '' END AS button_selector, CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE 'body > a' END AS next_link_selector, CAST(1 AS DOUBLE) / 3 AS confidence FROM lineitem")
def _(t):
    return auto.load_more(_order_pages(t), _order_nodes(t))


@query("a26_repeating_groups", f"{_CARDS} SELECT page_id, 'li|card.hot' AS signature, n AS item_count, {s.round2('2 * least(40, n) + least(35, chars / 8) + 1 - 0.6', 4)} AS score, CAST(1 AS INT) AS place FROM g WHERE n >= 3 UNION ALL SELECT page_id, 'li|', 3, {s.round2(_NAV_SCORE, 4)}, CASE WHEN n >= 3 THEN 2 ELSE 1 END FROM g")
def _(t):
    from pagegrid.functions.numbers import round_half_up

    groups, _items = auto.repeating_groups(_order_nodes(t))
    return groups.select("page_id", "signature", "item_count", round_half_up(c("score"), 4).alias("score"), "place")


def _fields(t, **options):
    pages, nodes = _order_pages(t), _order_nodes(t)
    groups, items = auto.repeating_groups(nodes)
    best = stage_by(auto.best_group(groups, items), "best", "page_id")
    return auto.group_fields(pages, nodes, best, items, **options)[0]


@query("a27_field_coverage", f"{_CARDS} SELECT page_id, CAST(rank AS INT) AS rank, name, selector, mode, CAST(1 AS DOUBLE) AS confidence FROM r")
def _(t):
    return _fields(t).select("page_id", "rank", "name", "selector", "mode", "confidence")


@query("t05_top_fields", f"{_CARDS} SELECT page_id, name, selector, mode FROM r WHERE rank = 0")
def _(t):
    return _fields(t, max_fields=1).select("page_id", "name", "selector", "mode")


@query(
    "a28_autodetect",
    f"""{_CARDS} SELECT page_id, n >= 3 AS ok, CASE WHEN n < 3 THEN 'Container detected but no stable repeating fields were found.' END AS error, CASE WHEN n >= 3 THEN 'body > div > ul > li.card.hot' ELSE 'body > nav > ul > li' END AS container_selector,
      CASE WHEN n >= 3 THEN n ELSE 3 END AS item_count, CASE WHEN n >= 3 THEN least(5, n) ELSE 0 END AS previews, CASE WHEN page_id % 2 = 0 THEN 'click_button' ELSE 'navigate' END AS load_more, CASE WHEN n >= 3 THEN {s.round2('(least(1, n / 12.0) + 2 / 6.0) / 2', 4)} END AS confidence FROM g""",
)
def _(t):
    from pagegrid.functions.numbers import round_half_up

    d = auto.detect(_order_pages(t))
    return d.select(
        "page_id", "ok", "error", "container_selector", "item_count", F.coalesce(F.when(c("preview_rows").isNotNull(), F.size("preview_rows")), F.lit(0)).cast("long").alias("previews"), "load_more", round_half_up(c("confidence"), 4).alias("confidence")
    )


@query("j11_anchor_group", f"{_CARDS} SELECT page_id, 'li|' AS signature FROM g")
def _(t):
    nodes = _order_nodes(t)
    groups, items = auto.repeating_groups(nodes)
    hit = nt.select(nodes, "nav li")
    anchors = hit.join(nt.first_match(hit), ["page_id", "node_id"]).select("page_id", c("node_id").alias("anchor_id"), c("post").alias("anchor_post"))
    return auto.best_group(groups, items, anchors).select("page_id", "signature")


@query(
    "u05_shared_classes",
    f"""{_CARDS}, k AS (SELECT page_id, count(DISTINCT l_returnflag) AS a, count(DISTINCT l_linestatus) AS b, count(DISTINCT qty % 3) AS d, max(l_returnflag) FILTER (WHERE pos = 1) AS fa, max(l_linestatus) FILTER (WHERE pos = 1) AS fb, max('q' || (qty % 3)) FILTER (WHERE pos = 1) AS fd FROM l WHERE pos <= 8 GROUP BY 1)
      SELECT page_id, array_to_string(list_slice(list_filter([CASE WHEN a = 1 THEN fa END, CASE WHEN b = 1 AND (a > 1 OR fa <> fb) THEN fb END, CASE WHEN d = 1 THEN fd END], lambda x: x IS NOT NULL), 1, 2), '.') AS shared FROM k""",
)
def _(t):
    x = _lines(t).select("page_id", F.posexplode("lines").alias("i", "x"))
    items = x.select("page_id", F.lit(0).alias("parent_id"), F.lit("li|").alias("signature"), (c("i") + 1).alias("pos"), F.array("x.l_returnflag", "x.l_linestatus", F.concat(F.lit("q"), c("x.qty") % 3)).alias("classes"))
    return auto.shared_classes(items).select("page_id", F.array_join("shared", ".").alias("shared"))


@query("w06_unique_names", f"{_CARDS}, u AS (SELECT page_id, pos, l_returnflag, row_number() OVER (PARTITION BY page_id, l_returnflag ORDER BY pos) AS k FROM l) SELECT page_id, string_agg(l_returnflag || CASE WHEN k = 1 THEN '' ELSE '_' || k END, ',' ORDER BY pos) AS names FROM u GROUP BY 1")
def _(t):
    return _lines(t).select("page_id", F.array_join(auto.unique_names(F.transform("lines", lambda x: x["l_returnflag"])), ",").alias("names"))


@query(
    "p09_blank_rows",
    """SELECT l_orderkey AS page_id, CASE WHEN l_linestatus = 'F' THEN CAST(l_partkey AS VARCHAR) ELSE '' END AS part, CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END AS flag, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' OR l_returnflag <> 'A' GROUP BY ALL""",
)
def _(t):
    li = F.transform(
        "lines",
        lambda x: F.concat(F.lit("<li><i>"), F.when(x["l_linestatus"] == "F", x["l_partkey"].cast("string")).otherwise("  "), F.lit("</i><b>"), F.when(x["l_returnflag"] == "A", "").otherwise(x["l_returnflag"]), F.lit("</b></li>")),
    )
    pages = _lines(t).select("page_id", F.lit("https://shop.example.com/o").alias("url"), F.concat(F.lit("<body><ul>"), F.array_join(li, ""), F.lit("</ul></body>")).alias("html"))
    rows = nt.extract_list(pages, "ul li", [{"name": "part", "selector": "li > i"}, {"name": "flag", "selector": "b"}])
    return rows.groupBy("page_id", "part", "flag").agg(F.count(F.lit(1)).alias("n"))


def _rounds(t):
    # days are ranked once each, so a run of any size has as many rows in a task as it has days
    rows = t.events.select(c("user_id").alias("run_id"), (F.dayofmonth("ts") - 1).alias("day"), (c("event_id") % 40).alias("row_key"))
    ranked = rows.select("run_id", "day").distinct().selectExpr("run_id", "day", "row_number() OVER (PARTITION BY run_id ORDER BY day) - 1 AS round")
    return rows.distinct().join(ranked, ["run_id", "day"]).select("run_id", "row_key", "round")


_ROUNDS = """WITH r AS (SELECT user_id AS run_id, event_id % 40 AS row_key, dense_rank() OVER (PARTITION BY user_id ORDER BY day(ts)) - 1 AS round FROM events), f AS (SELECT run_id, row_key, min(round) AS round FROM r GROUP BY 1, 2),
  n AS (SELECT run_id, round, (SELECT count(*) FROM f WHERE f.run_id = q.run_id AND f.round = q.round) AS new_rows FROM (SELECT DISTINCT run_id, round FROM r) q),
  s AS (SELECT *, CAST(sum(new_rows) OVER w AS BIGINT) AS total_rows, round - coalesce(max(CASE WHEN new_rows > 0 THEN round END) OVER w, -1) AS streak FROM n WINDOW w AS (PARTITION BY run_id ORDER BY round ROWS UNBOUNDED PRECEDING)),
  x AS (SELECT *, CASE WHEN total_rows >= 38 THEN 'row_cap' WHEN streak >= 2 THEN 'no_change' WHEN round >= 24 THEN 'attempt_limit' END AS stop_reason FROM s)"""


@query("w09_round_history", f"{_ROUNDS} SELECT run_id, CAST(round AS INT) AS round, new_rows, total_rows, CAST(streak AS INT) AS streak, stop_reason FROM x")
def _(t):
    return auto.round_history(_rounds(t), max_rounds=25, threshold=2, max_rows=38).select("run_id", "round", "new_rows", "total_rows", c("streak").cast("int").alias("streak"), "stop_reason")


@query("w09_run_stops", f"{_ROUNDS}, m AS (SELECT run_id, min(round) AS round FROM x WHERE stop_reason IS NOT NULL GROUP BY 1) SELECT DISTINCT x.run_id, CAST(m.round AS INT) AS round, y.stop_reason, y.total_rows FROM x LEFT JOIN m ON m.run_id = x.run_id LEFT JOIN x y ON y.run_id = m.run_id AND y.round = m.round")
def _(t):
    return auto.run_stops(auto.round_history(_rounds(t), max_rounds=25, threshold=2, max_rows=38))
