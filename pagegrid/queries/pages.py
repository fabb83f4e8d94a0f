"""Extraction over the stored page corpus."""
from __future__ import annotations

from pyspark.sql import functions as F

from pagegrid.functions import text
from pagegrid.operators import images, pages, places
from pagegrid.plans.registry import query
from pagegrid.plans.tables import spread
from pagegrid.queries import sqltext as s

c = F.col


@query("s01_page_scan", "SELECT url, 'EXTRACT_PAGES' AS action_type, page_id, CAST(length(html) AS BIGINT) AS html_chars FROM pages")
def _(t):
    return pages.scan(t.pages, "EXTRACT_PAGES", lambda p: p.select("url", "page_id", F.char_length("html").cast("long").alias("html_chars")))


_SUMMARY = f"""SELECT page_id, url AS target_url, {s.tag_text('html', 'title')} AS title, '' AS meta_description, '' AS canonical_url, {s.words('plain')} AS word_count, CAST(length(plain) AS BIGINT) AS char_count,
  {s.count_tag('html', 'h1')} AS h1_count, {s.count_tag('html', 'h2')} AS h2_count, {s.count_tag('html', 'h3')} AS h3_count, {s.count_tag('html', 'a')} AS link_count, {s.lang('html')} AS lang FROM (SELECT *, {s.strip('html')} AS plain FROM pages)"""


@query("f09_page_summary", _SUMMARY)
def _(t):
    return pages.summary(t.pages)


@query("a30_tag_counts", f"SELECT page_id, {', '.join(s.count_tag('html', k) + f' AS {k}_count' for k in ('a', 'p', 'li', 'b', 'h1', 'meta'))} FROM pages")
def _(t):
    return pages.tag_counts(t.pages, ["a", "p", "li", "b", "h1", "meta"])


_ARTICLE = f"""regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1)"""
_MAIN = f"coalesce(nullif({s.strip(_ARTICLE)}, ''), {s.visible('html')})"
_H1 = "regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)"


@query(
    "f10_text_rows",
    f"""SELECT page_id, url, {s.tag_text('html', 'title')} AS title, '' AS description, '' AS author, '' AS publish_date, '' AS canonical_url, {s.lang('html')} AS lang, {s.strip(_H1)} AS h1, {s.count_tag('html', 'h2')} AS h2_count,
      {s.count_tag('html', 'p')} AS paragraph_count, {s.words('main')} AS word_count, left(main, 280) AS excerpt, main AS content FROM (SELECT *, {_MAIN} AS main FROM pages)""",
)
def _(t):
    return pages.text_rows(t.pages)


@query(
    "f14_metadata_rows",
    f"""SELECT page_id, url, {s.tag_text('html', 'title')} AS title, '' AS description, '' AS author, '' AS publish_date, '' AS canonical_url, '' AS og_title, '' AS og_description, '' AS og_type, '' AS og_image, '' AS twitter_card, {s.count_tag('html', 'meta')} AS meta_tag_count,
      CAST(len(list_distinct(list_transform(regexp_extract_all(body, {s.q(s.EMAIL)}), lambda m: lower(m)))) AS BIGINT) AS email_count,
      CAST(len(list_distinct(list_filter(list_transform(regexp_extract_all(body, {s.q(s.PHONE)}), lambda m: trim(regexp_replace(m, {s.q(s.WS + '+')}, ' ', 'g'), ' ')), lambda x: length(x) >= 7))) AS BIGINT) AS phone_count,
      {s.lang('html')} AS detected_lang, 'Article | Review | WebPage' AS schema_types, CAST(3 AS BIGINT) AS schema_type_count, CAST(2 AS BIGINT) AS jsonld_scripts, CAST(3 AS BIGINT) AS jsonld_nodes, CAST(1 AS BIGINT) AS review_count, CAST(page_id AS DOUBLE) AS rating_count
      FROM (SELECT *, {s.visible('html')} AS body FROM pages)""",
)
def _(t):
    # JSON-LD derived from each page is added, since the stored pages carry none
    ld = F.concat(
        F.lit('<script type="application/ld+json">{"@graph":[{"@type":"WebPage","url":"'), c("url"), F.lit('"},{"@type":["Review"," Article "],"aggregateRating":{"ratingCount":"'),
        c("page_id"), F.lit('"}}],"name":"x"}</script><script type=\'application/ld+json\'>{broken</script>'),
    )
    return pages.metadata_rows(t.pages.withColumn("html", F.concat("html", ld)))


@query(
    "a29_jsonld_rollup",
    f"""SELECT page_id, CAST(3 AS BIGINT) AS script_count, CAST(4 AS BIGINT) AS node_count, 'Offer|Review|Shop' AS schema_types, CAST(2 AS BIGINT) AS review_count, CAST(page_id + length(html) AS DOUBLE) AS rating_count, '{{"@type":"Shop","aggregateRating":{{"reviewCount":' || page_id || '}}}}' AS first_node FROM pages""",
)
def _(t):
    ld = F.concat(
        F.lit('<script type="application/ld+json">{"aggregateRating":{"reviewCount":'), c("page_id"), F.lit('},"@type":"Shop"}</script>'),
        F.lit('<script type="application/ld+json">[{"@type":"Review"'), F.lit('},[{"@type":["Offer","Review"],"aggregateRating":{"ratingCount":'), F.char_length("html"),
        F.lit('}}]]</script><script type="application/ld+json">[{"name":"'), c("page_id"), F.lit('"}, 5, null]</script>'),
    )
    r = pages.jsonld_rollup(t.pages.withColumn("html", F.concat("html", ld)))
    return r.select("page_id", "script_count", "node_count", F.array_join("schema_types", "|").alias("schema_types"), "review_count", "rating_count", F.get("first_nodes", F.lit(0)).alias("first_node"))


_PLACE = "'https://www.google.com/maps/place/' || replace(p_name, ' ', '+') || '/@' || (p_size % 90) || '.25,-' || (p_partkey % 180) || '.5,17z?entry=ttu&cid=' || p_partkey || '&g_ep=x'"


def _place_url():
    return F.concat(
        F.lit("https://www.google.com/maps/place/"), F.replace("p_name", F.lit(" "), F.lit("+")), F.lit("/@"), c("p_size") % 90, F.lit(".25,-"), c("p_partkey") % 180,
        F.lit(".5,17z?entry=ttu&cid="), "p_partkey", F.lit("&g_ep=x"),
    )


@query(
    "f15_coordinates",
    "SELECT p_partkey, (p_size % 90) || '.25' AS latitude, '-' || (p_partkey % 180) || '.5' AS longitude, p_size || '.0' AS place_latitude, '' AS missing FROM part",
)
def _(t):
    alt = F.concat(F.lit("https://x.example/data=!3d"), "p_size", F.lit(".0!4d-1.5"))
    return t.part.select("p_partkey", places.coordinates(_place_url()).alias("a"), places.coordinates(alt).alias("b"), places.coordinates(c("p_name")).alias("n")).select(
        "p_partkey", "a.latitude", "a.longitude", c("b.latitude").alias("place_latitude"), c("n.latitude").alias("missing")
    )


@query("f16_number_text", "SELECT p_partkey, CAST(p_partkey * 1000 + p_size AS DOUBLE) AS reviews, CAST(0 AS DOUBLE) AS none FROM part")
def _(t):
    grouped = F.format_number(c("p_partkey") * 1000 + c("p_size"), 0)
    return t.part.select("p_partkey", text.number_in_text(F.concat(F.lit("  ("), grouped, F.lit(" reviews)"))).alias("reviews"), text.number_in_text(c("p_name")).alias("none"))


@query(
    "f18_place_urls",
    """SELECT p_partkey, 'https://www.google.com/maps/place/' || replace(p_name, ' ', '+') || '/@' || (p_size % 90) || '.25,-' || (p_partkey % 180) || '.5,17z?cid=' || p_partkey AS result_url,
      'https://www.google.com/maps/search/' || replace(p_name, ' ', '+') || '?q=1' AS scope_url, '' AS no_scope FROM part""",
)
def _(t):
    search = F.concat(F.lit("https://www.google.com/maps/search/"), F.replace("p_name", F.lit(" "), F.lit("+")), F.lit("/@1.5,2.5,12z?entry=ttu&q=1#x"))
    return spread(t.part, "p_partkey").select("p_partkey", places.result_url(_place_url(), F.lit("https://www.google.com/")).alias("result_url"), places.scope_url(search).alias("scope_url"), places.scope_url(_place_url()).alias("no_scope"))


@query(
    "f19_entity_keys",
    f"""SELECT p_partkey, CASE WHEN p_size > 25 THEN 'cid:' || p_partkey WHEN p_size > 10 THEN 'path:https://www.example.com/p/' || p_partkey ELSE
      CASE WHEN p_retailprice > 950 THEN 'name_addr:' || p_name || '|' || lower(regexp_replace(p_brand, '[^A-Za-z0-9_:/?&.=+-]+', '_', 'g')) ELSE 'name:' || p_name END END AS entity_key
      FROM (SELECT p_partkey, p_size, p_retailprice, p_brand, regexp_replace(p_name, ' ', '_', 'g') AS p_name FROM part)""",
)
def _(t):
    url = F.when(c("p_size") > 25, _place_url()).when(c("p_size") > 10, F.concat(F.lit("https://WWW.example.com/p/"), "p_partkey", F.lit("?x=1"))).otherwise("")
    address = F.when(c("p_retailprice") > 950, c("p_brand")).otherwise("")
    return t.part.select("p_partkey", places.entity_key(url, F.upper("p_name"), address, F.lit(None)).alias("entity_key"))


@query("p21_place_selection", f"SELECT url, min(p_partkey) AS pos FROM (SELECT {_PLACE} AS url, p_partkey FROM part) GROUP BY url")
def _(t):
    u = t.part.select(_place_url().alias("url"), "p_partkey").unionByName(t.part.select(F.concat(F.lit("https://example.com/"), "p_name").alias("url"), "p_partkey"))
    return places.place_urls(u, "url", "p_partkey")


_IMG_EXT = "CASE p_partkey % 3 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' ELSE 'img' END"


def _with_images(t):
    """Part rows as small pages holding images, the corpus having none."""
    ext = F.element_at(F.array(*[F.lit(x) for x in (".JPG?v=1", ".png", "")]), (c("p_partkey") % 3 + 1).cast("int"))
    tag = F.concat(F.lit('<p><img src="/i/'), "p_partkey", ext, F.lit('" alt="'), F.when(c("p_size") > 20, c("p_name")).otherwise(""), F.lit('" width="'), c("p_size") * 20, F.lit('" height="'), c("p_size") * 15, F.lit('"><img alt="x" src="data:image/png;base64,AA"></p>'))
    return spread(t.part, "p_partkey").select(c("p_partkey").alias("page_id"), F.lit("https://shop.example.com/list/").alias("url"), F.concat(tag, tag).alias("html"))


_IMG = f"""SELECT p_partkey AS page_id, CAST(0 AS INT) AS pos, 'https://shop.example.com/i/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.JPG?v=1' WHEN 1 THEN '.png' ELSE '' END AS url, CASE WHEN p_size > 20 THEN p_name ELSE '' END AS alt,
  p_size * 20 AS width, p_size * 15 AS height, {_IMG_EXT} AS ext, CASE WHEN p_size * 20 * p_size * 15 < 50000 THEN 'small' WHEN p_size * 20 * p_size * 15 < 250000 THEN 'medium' ELSE 'large' END AS size_class FROM part"""


@query("f26_image_inventory", _IMG)
def _(t):
    return images.inventory(_with_images(t))


@query("f25_image_facts", f"SELECT p_partkey, {_IMG_EXT} AS ext, CASE WHEN p_size * 20 * p_size * 15 < 50000 THEN 'small' WHEN p_size * 20 * p_size * 15 < 250000 THEN 'medium' ELSE 'large' END AS size_class FROM part")
def _(t):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".a.JP-G?v=1.gif", ".png#x.y", "")]), (c("p_partkey") % 3 + 1).cast("int"))
    return t.part.select("p_partkey", images.image_ext(F.concat(F.lit("http://a.example.com/x.y/"), "p_partkey", ext)).alias("ext"), images.size_class(c("p_size") * 20, c("p_size") * 15).alias("size_class"))


@query("p10_image_filter", f"SELECT page_id, url FROM ({_IMG}) WHERE contains(lower(alt), 'ring') AND width >= 500 AND height >= 400 AND ext = 'jpg' AND size_class = 'large' AND alt <> ''")
def _(t):
    return images.filter_images(images.inventory(_with_images(t)), " RING", 500, 400, "JPG", "large", "has").select("page_id", "url")


@query("f27_file_names", f"""SELECT page_id, 'shop.example.com_' || coalesce(nullif(regexp_replace(alt, ' ', '_', 'g'), ''), 'image') || '_1_' || width || 'x' || height || '.' || ext AS file_name FROM ({_IMG})""")
def _(t):
    return images.name_files(images.inventory(_with_images(t)), "{host}/{alt}:{index} {width}x{height}").select("page_id", "file_name")


@query("x07_runner_registry", f"SELECT page_id, {s.count_tag('html', 'a')} AS link_count, {s.words(s.strip('html'))} AS word_count FROM pages")
def _(t):
    return pages.run("EXTRACT_SUMMARY", t.pages).select("page_id", "link_count", "word_count")


@query("f30_jsonld_nodes", "SELECT page_id, '0' AS path, CAST(NULL AS VARCHAR) AS kind FROM pages UNION ALL SELECT page_id, '0.0', 'WebPage' FROM pages UNION ALL SELECT page_id, '0.1', CAST(page_id AS VARCHAR) FROM pages UNION ALL SELECT page_id, '2.0.0', 'Deep' FROM pages")
def _(t):
    ld = F.concat(
        F.lit('<script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":"'), c("page_id"), F.lit('"}, 7]}</script><script type="application/ld+json">{bad</script>'),
        F.lit("<script data-x type='application/ld+json'>[[{\"@type\":\"Deep\"}],null]</script>"),
    )
    n = pages.jsonld_nodes(t.pages.withColumn("html", F.concat("html", ld)))
    return n.select("page_id", F.array_join(F.transform("path", lambda i: i.cast("string")), ".").alias("path"), F.try_variant_get("node", "$['@type']", "string").alias("kind"))


_USER = r"[A-Z][a-z]+ [a-z]+ing\b"


@query(
    "x05_user_patterns",
    f"""WITH m AS (SELECT doc_id, list_concat(list_transform(regexp_extract_all(text, {s.q(s.PHONE)}), lambda m: trim(regexp_replace(m, {s.q(s.WS + '+')}, ' ', 'g'), ' ')), regexp_extract_all(text, {s.q(_USER)})) AS found FROM documents)
      SELECT doc_id, array_to_string({s.first_of_each('found')}, '|') AS phones FROM m""",
)
def _(t):
    from pagegrid.functions import contacts

    return t.documents.select("doc_id", F.array_join(contacts.phones(c("text"), patterns=["([", _USER], validate=False), "|").alias("phones"))


#: pages that are parsed and put together by one task
_TASK_PAGES = 20_000


def _place_tasks(t) -> int:
    """Nodes take few bytes in a file and many in a sort: a task gets a bounded number of pages, however many there are."""
    return max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-t.part.count() // _TASK_PAGES))


def _place_pages(t):
    """Part rows as place pages: even keys are detail pages, odd keys search pages with one card."""
    name, price = c("p_name"), F.format_number(c("p_partkey") * 7 + 1000, 0)
    detail = F.concat(
        F.lit("<html><body><h1>"), name, F.lit("</h1><span aria-label='4."), c("p_size") % 10, F.lit(" stars'></span><button jsaction='pane.reviewChart.moreReviews'>"), price, F.lit(" reviews</button><button jsaction='x.category'>"), "p_type",
        F.lit("</button><button data-item-id='address'>"), "p_brand", F.lit(" St</button><button data-item-id='phone:tel:1'> +1 555 </button><a data-item-id='authority' href='/w/"), "p_partkey", F.lit("'>site</a><div aria-label='Hours'>Mon <b>9-5</b></div><img src='a'><img src='b'></body></html>"),
    )
    card = F.concat(
        F.lit("<html><body><div role='feed'><div role='article' class='Nv2PK'><a aria-label='"), name, F.lit("' href='/maps/place/"), "p_partkey", F.lit("/@1.25,-2.5?entry=ttu&amp;x=1'></a><span class='MW4etd'>4.5</span>("), price, F.lit(") · "), "p_type", F.lit(" · "), "p_brand",
        F.lit("<img src='i'></div></div></body></html>"),
    )
    even = c("p_partkey") % 2 == 0
    url = F.when(even, F.concat(F.lit("https://maps.example.com/maps/place/"), "p_partkey", F.lit("/@3.5,-"), c("p_partkey") % 90, F.lit(".25,17z"))).otherwise("https://maps.example.com/maps/search/x")
    return spread(t.part, "p_partkey").select(c("p_partkey").alias("page_id"), url.alias("url"), F.when(even, detail).otherwise(card).alias("html"))


@query(
    "f17_place_details",
    """SELECT p_partkey AS page_id, p_name AS map_name, '4.' || (p_size % 10) || ' stars' AS map_rating, p_type AS map_category, p_brand || ' St' AS map_address, '3.5' AS map_latitude, '-' || (p_partkey % 90) || '.25' AS map_longitude, '+1 555' AS map_phone, 'https://maps.example.com/w/' || p_partkey AS map_website,
      'Mon 9-5' AS map_hours, CAST(p_partkey * 7 + 1000 AS DOUBLE) AS map_review_count, CAST(2 AS BIGINT) AS map_image_count FROM part WHERE p_partkey % 2 = 0""",
)
def _(t):
    from pagegrid.operators import nodes as nt
    from pagegrid.plans.lineage import stage_by

    p, n = _place_pages(t).filter("page_id % 2 = 0"), _place_tasks(t)
    return stage_by(places.detail_rows(p, nt.nodes_by_page(p, n)).drop("url"), "details", "page_id", parts=n)


@query(
    "f17_place_cards",
    """SELECT p_partkey AS page_id, 'https://maps.example.com/maps/place/' || p_partkey || '/@1.25,-2.5?x=1' AS url, p_name AS map_name, '4.5' AS map_rating, p_type || ' · ' || p_brand AS map_address, '1.25' AS map_latitude,
      CAST(p_partkey * 7 + 1000 AS DOUBLE) AS map_review_count, CAST(1 AS BIGINT) AS map_image_count FROM part WHERE p_partkey % 2 = 1""",
)
def _(t):
    from pagegrid.operators import nodes as nt
    from pagegrid.plans.lineage import stage_by

    p, n = _place_pages(t).filter("page_id % 2 = 1"), _place_tasks(t)
    r = stage_by(places.result_cards(p, nt.nodes_by_page(p, n)), "cards", "page_id", parts=n)
    return r.select("page_id", "url", "map_name", "map_rating", "map_address", "map_latitude", "map_review_count", "map_image_count")
