"""Place records: coordinates, URL normalisation, entity keys."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagegrid.functions.text import WS, to_text, trim_ws
from pagegrid.functions.urls import absolute, drop_query_keys, let, origin, parts, query_value

c = F.col

# Tracking parameters dropped from place URLs.
TRACKING = ["entry", "g_ep"]


def coordinates(url: Column) -> Column:
    """Struct (latitude, longitude) as text, '' when absent: ``@lat,lng`` first, then ``!3d..!4d..``."""
    u = to_text(url)
    view, place = r"@(-?\d+\.\d+),(-?\d+\.\d+)", r"!3d(-?\d+\.\d+)!4d(-?\d+\.\d+)"

    def pick(group: int) -> Column:
        return F.when(u.rlike(view), F.regexp_extract(u, view, group)).otherwise(F.regexp_extract(u, place, group))

    return F.struct(pick(1).alias("latitude"), pick(2).alias("longitude"))


def result_url(raw: Column, base: Column) -> Column:
    return F.coalesce(drop_query_keys(absolute(raw, base), TRACKING), F.lit(""))


def scope_url(raw: Column) -> Column:
    """Search scope of a place search URL: no tracking, viewport or trailing slashes; '' for other paths."""
    is_search = F.lower(parts(raw)["path"]).contains("/maps/search/")
    return F.when(F.coalesce(is_search, F.lit(False)), drop_query_keys(raw, TRACKING, drop_viewport=True)).otherwise("")


def normal_key(value: Column) -> Column:
    v = F.regexp_replace(F.lower(trim_ws(to_text(value))), f"{WS}+", " ")
    return F.regexp_replace(v, r"[^A-Za-z0-9_:/?&.=+-]+", "_")


def entity_key(url: Column, name: Column, address: Column, phone: Column) -> Column:
    """Identity of a place: cid, then page path, then raw url, then name with address, phone or alone."""
    raw = trim_ws(to_text(url))
    cid = trim_ws(query_value(raw, "cid"))
    by_url = let(
        parts(raw),
        lambda p: F.when(p.isNull(), F.concat(F.lit("url:"), normal_key(raw)))
        .when(cid != "", F.concat(F.lit("cid:"), normal_key(cid)))
        .otherwise(F.concat(F.lit("path:"), normal_key(F.concat(origin(p), p["path"])))),
    )
    n, a, ph = normal_key(name), normal_key(address), normal_key(phone)
    by_name = (
        F.when((n != "") & (a != ""), F.concat(F.lit("name_addr:"), n, F.lit("|"), a))
        .when((n != "") & (ph != ""), F.concat(F.lit("name_phone:"), n, F.lit("|"), ph))
        .when(n != "", F.concat(F.lit("name:"), n))
        .otherwise("")
    )
    return F.when(raw != "", by_url).otherwise(by_name)


def place_urls(urls: DataFrame, url: str, position: str, limit: int | None = None) -> DataFrame:
    """Distinct place page URLs in input order."""
    kept = urls.select(trim_ws(c(url)).alias("url"), c(position).alias("pos")).filter(c("url").rlike(r"(?i)google\.[^/]+/maps/place/"))
    first = kept.groupBy("url").agg(F.min("pos").alias("pos"))
    return first.orderBy("pos", "url").limit(limit) if limit else first


def unseen(rows: DataFrame, seen: DataFrame, scope: str = "scope", key: str = "entity_key") -> DataFrame:
    """Rows whose entity is new to its scope; rows without a key always pass."""
    fresh = rows.filter(c(key) != "").join(seen.select(scope, key).distinct(), [scope, key], "left_anti")
    rest = [n for n in rows.columns if n not in (scope, key)]
    once = fresh.groupBy(scope, key).agg(F.min(F.struct(*rest)).alias("r")).select(scope, key, "r.*").select(*rows.columns)
    return once.unionByName(rows.filter(c(key) == ""))


# -- place rows from stored pages -------------------------------------------------------------------------

# Place column -> (selector, what to read) tried in order.
DETAIL_SOURCES = {
    "map_name": [("h1", "text")],
    "map_rating": [("[aria-label*='stars']", "aria-label"), ("[data-value='Rating']", "text")],
    "review_text": [("button[jsaction*='pane.reviewChart.moreReviews']", "text"), ("[aria-label*='reviews']", "aria-label")],
    "map_category": [("button[jsaction*='category']", "text"), ("[aria-label*='Category']", "text")],
    "map_address": [("button[data-item-id*='address']", "text"), ("[data-item-id='address']", "text")],
    "map_phone": [("button[data-item-id*='phone']", "text"), ("[data-item-id='phone:tel']", "text")],
    "map_website": [("a[data-item-id='authority']", "href"), ("a[data-item-id*='authority']", "href")],
    "map_hours": [("[aria-label*='Hours']", "text"), ("[data-item-id*='oh']", "text")],
}
# Which switch blanks which columns.
SWITCHES = {
    "basic": ["map_name", "map_rating", "map_category"],
    "contact": ["map_phone", "map_website"],
    "hours": ["map_hours"],
    "location": ["map_address", "map_latitude", "map_longitude"],
}


def _switched(df: DataFrame, switches: dict[str, bool] | None) -> DataFrame:
    on = {"basic": True, "contact": True, "hours": True, "location": True, "reviews": True, "images": True} | (switches or {})
    for switch, columns in SWITCHES.items():
        if not on[switch]:
            df = df.withColumns({n: F.lit("") for n in columns})
    if not on["reviews"]:
        df = df.withColumn("map_review_count", F.lit(0.0))
    if not on["images"]:
        df = df.withColumn("map_image_count", F.lit(0).cast("long"))
    return df


def detail_rows(pages: DataFrame, nodes: DataFrame, switches: dict[str, bool] | None = None) -> DataFrame:
    """One place row per page. All selectors are tested in one scan of the node table."""
    from pagegrid.functions.text import clean_text, number_in_text
    from pagegrid.operators import nodes as nt

    tests = [
        F.when(nt.compound(sel), F.struct(F.lit(field).alias("field"), F.lit(i).alias("prio"), F.lit(read).alias("read")))
        for field, sources in DETAIL_SOURCES.items()
        for i, (sel, read) in enumerate(sources)
    ]
    hits = nt.elements(nodes).select("page_id", "node_id", "attrs", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("m"))
    first = hits.groupBy("page_id", "m.field", "m.prio").agg(F.min_by(F.struct("node_id", "m.read", c("attrs")["aria-label"].alias("label"), c("attrs")["href"].alias("href")), "node_id").alias("h"))
    first = first.select("page_id", "field", "prio", "h.*")
    texts = nt.subtree_texts(nodes, first.filter("read = 'text'"))
    urls = pages.select("page_id", c("url").alias("page_url"))
    v = first.join(texts, ["page_id", "node_id"], "left").join(urls, "page_id")
    value = F.when(c("read") == "text", F.coalesce("content", F.lit(""))).when(c("read") == "href", absolute(c("href"), c("page_url"))).otherwise(clean_text(c("label")))
    picked = v.withColumn("value", value).filter("value <> ''").groupBy("page_id", "field").agg(F.min_by("value", "prio").alias("value"))
    wide = picked.groupBy("page_id").agg(*[F.max(F.when(c("field") == n, c("value"))).alias(n) for n in DETAIL_SOURCES])
    images = nt.elements(nodes).filter("tag = 'img'").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    at = coordinates(c("url"))
    j = pages.select("page_id", "url").join(wide, "page_id", "left").join(images, "page_id", "left")
    blank = lambda n: F.coalesce(c(n), F.lit("")).alias(n)
    out = j.select(
        "page_id", "url", blank("map_name"), blank("map_rating"), blank("map_category"), blank("map_address"), at["latitude"].alias("map_latitude"), at["longitude"].alias("map_longitude"),
        blank("map_phone"), blank("map_website"), blank("map_hours"), number_in_text(c("review_text")).alias("map_review_count"), F.coalesce("n", F.lit(0)).alias("map_image_count"),
    )
    return _switched(out, switches)


def result_cards(pages: DataFrame, nodes: DataFrame, switches: dict[str, bool] | None = None, max_results: int | None = None) -> DataFrame:
    """Place rows of the result cards in the feed of search pages; first card per place and page."""
    from pyspark.sql import Window

    from pagegrid.functions.text import clean_text
    from pagegrid.operators import nodes as nt

    el = nt.elements(nodes)
    feed_rank = F.when(nt.compound("[role='feed']"), 0).when(nt.compound("div[aria-label*='Results']"), 1).when(nt.compound("div[aria-label*='results']"), 2)
    feeds = el.withColumn("r", feed_rank).filter("r IS NOT NULL").groupBy("page_id").agg(F.min(F.struct("r", "node_id", "post")).alias("f"))
    feeds = feeds.select("page_id", c("f.node_id").alias("feed"), c("f.post").alias("feed_post"))
    anchors = el.filter(nt.compound("a[href*='/maps/place/']")).select("page_id", c("node_id").alias("anchor"), "parent_id", "attrs")
    inside = anchors.join(feeds, "page_id").filter((c("feed") < c("anchor")) & (c("anchor") <= c("feed_post")))
    # closest card by kind: article role first, then the two known card forms, then the parent
    kind = F.when(nt.compound("[role='article']"), 0).when(nt.compound(".Nv2PK"), 1).when(nt.compound("div[jsaction*='mouseover:pane']"), 2)
    boxes = el.withColumn("kind", kind).filter("kind IS NOT NULL").select("page_id", c("node_id").alias("box"), "post", "kind")
    around = nt.enclosed(inside.select("page_id", c("anchor").alias("node_id")), boxes.select("page_id", c("box").alias("node_id"), "post"), or_self=True)
    up = around.select("page_id", c("node_id").alias("anchor"), c("holder").alias("box")).join(boxes.drop("post"), ["page_id", "box"]).groupBy("page_id", "anchor").agg(F.min(F.struct("kind", (-c("box")).alias("b")))["b"].alias("b"))
    cards = inside.join(up, ["page_id", "anchor"], "left").withColumn("card", F.coalesce(-c("b"), "parent_id"))

    text = nt.subtree_texts(nodes, cards.select("page_id", c("card").alias("node_id")).unionByName(cards.select("page_id", c("anchor").alias("node_id"))))
    parts_ = {
        "star": "[role='img'][aria-label*='star']", "stars": "[aria-label*='stars']", "labelled": "[aria-label]", "headline": ".qBF1Pd", "small": ".fontHeadlineSmall", "score": ".MW4etd", "img": "img",
    }
    found = el.select(
        "page_id", "node_id", c("attrs")["aria-label"].alias("label"),
        F.filter(F.array(*[F.when(nt.compound(s), F.lit(k)) for k, s in parts_.items()]), lambda x: x.isNotNull()).alias("roles"),
    ).filter(F.size("roles") > 0)
    wanted = cards.select("page_id", c("card").alias("node_id")).unionByName(cards.select("page_id", c("anchor").alias("node_id"))).distinct()
    wanted = el.join(wanted, ["page_id", "node_id"], "left_semi")
    held = nt.enclosed(found, wanted).join(found, ["page_id", "node_id"]).select("page_id", "node_id", "label", "holder", F.explode("roles").alias("role"))
    held_text = nt.subtree_texts(nodes, held.filter(c("role").isin("headline", "small", "score")))
    h = held.join(held_text, ["page_id", "node_id"], "left").groupBy("page_id", "holder").agg(
        *[F.min_by("label", F.when(c("role") == r, c("node_id"))).alias(r) for r in ("star", "stars", "labelled")],
        *[F.min_by("content", F.when(c("role") == r, c("node_id"))).alias(r) for r in ("headline", "small", "score")],
        F.count_if(c("role") == "img").alias("images"),
    )
    of_card = h.select("page_id", c("holder").alias("card"), "star", "stars", "headline", "small", "score", "images")
    of_anchor = h.select("page_id", c("holder").alias("anchor"), c("labelled").alias("inner_label"))
    card_text = text.select("page_id", c("node_id").alias("card"), c("content").alias("card_text"))
    anchor_text = text.select("page_id", c("node_id").alias("anchor"), c("content").alias("anchor_text"))
    j = cards.join(of_card, ["page_id", "card"], "left").join(of_anchor, ["page_id", "anchor"], "left").join(card_text, ["page_id", "card"], "left").join(anchor_text, ["page_id", "anchor"], "left")
    j = j.join(pages.select("page_id", c("url").alias("page_url")), "page_id")

    def first_of(*options: Column) -> Column:
        return F.coalesce(*[F.nullif(clean_text(o), F.lit("")) for o in options], F.lit(""))

    body = F.coalesce("card_text", F.lit(""))
    info = F.filter(F.transform(F.split(F.when(body.contains("·"), body).otherwise(""), "·", -1), clean_text), lambda x: x != "")
    reviews = F.regexp_replace(F.regexp_extract(body, r"\(([0-9][0-9,.]*)\)", 1), ",", "").try_cast("double")
    rows = j.withColumn("url", result_url(c("attrs")["href"], c("page_url"))).filter("url <> ''").withColumn("info", info)
    at = coordinates(c("url"))
    rows = rows.select(
        "page_id", "anchor", "url", first_of(c("attrs")["aria-label"], c("inner_label"), c("headline"), c("small"), c("anchor_text")).alias("map_name"),
        first_of(c("star"), c("stars"), c("score")).alias("map_rating"), F.coalesce(F.get("info", F.lit(0)), F.lit("")).alias("map_category"),
        F.array_join(F.slice("info", F.lit(2), F.size("info")), " · ").alias("map_address"), at["latitude"].alias("map_latitude"), at["longitude"].alias("map_longitude"),
        F.lit("").alias("map_phone"), F.lit("").alias("map_website"), F.lit("").alias("map_hours"), F.coalesce(reviews, F.lit(0.0)).alias("map_review_count"), F.coalesce("images", F.lit(0)).alias("map_image_count"),
    )
    rest = [n for n in rows.columns if n not in ("page_id", "url", "anchor")]
    once = rows.groupBy("page_id", "url").agg(F.min_by(F.struct("anchor", *rest), "anchor").alias("r")).select("page_id", "url", "r.*")
    if max_results:
        w = Window.partitionBy("page_id").orderBy("anchor")
        once = once.withColumn("__n", F.row_number().over(w)).filter(c("__n") <= max_results).drop("__n")
    return _switched(once.drop("anchor"), switches)
