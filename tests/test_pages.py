"""Page fixtures: tags, contacts, JSON-LD, images, places, links, node table, lists."""
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from pagegrid.functions import contacts, labels, text, urls
from pagegrid.operators import autodetect, images, links, nodes, pages, places
from pagegrid.plans import lineage
from pagegrid.plans.lineage import stage

c = F.col


def page(spark, html, url="https://e.example/dir/p.html", page_id=1):
    return spark.createDataFrame([(page_id, url, html)], "page_id long, url string, html string")


def one(df):
    return df.first().asDict()


def test_meta_tags(spark):
    html = """<html lang='en'><head><title> A  &amp; B</title><meta content="rev 'cut" name=description><meta content="rev" name="description">
      <META property='og:title' content='OG'><meta name="twitter:card" content="summary"><link href=" https://c.example/x " rel="canonical"></head>
      <body><time datetime="2024-01-01">x</time><a rel="author" href="/me">Ann <b>Lee</b></a><script>var e="no@x.example"</script></body></html>"""
    row = one(pages.metadata_rows(page(spark, html)))
    assert (row["title"], row["description"], row["og_title"], row["twitter_card"]) == ("A & B", "rev", "OG", "summary")
    assert (row["canonical_url"], row["publish_date"], row["author"], row["meta_tag_count"]) == ("https://c.example/x", "2024-01-01", "Ann Lee", 4)
    assert row["detected_lang"] == "en" and row["email_count"] == 0
    stop = page(spark, """<meta name="description" content="it's short">""").select(text.meta_content(c("html"), "description").alias("v"))
    assert one(stop)["v"] == "it" or one(stop)["v"] == ""


def test_switches_blank_columns(spark):
    p = page(spark, "<title>t</title><meta name='author' content='x'>")
    assert one(pages.text_rows(p, metadata=False))["author"] == ""
    assert "title" not in pages.summary(p, {"title": False}).columns


def test_contacts(spark):
    t = "Mail A.B@Example.com, a.b@example.com; x@y.org) bad@host +1 (555) 010-2030 and 12 34 567 or 1234567 tel +44 20 7946 0958."
    df = page(spark, f"<body>{t}<a href='mailto:Me@Site.net?subject=x'>m</a><a href=\"mailto:Me@Site.net\">n</a></body>")
    row = one(pages.email_rows(df))
    assert row["emails"] == ["a.b@example.com", "x@y.org", "me@site.net"]
    assert row["email_domains"] == ["example.com", "y.org", "site.net"]
    assert one(pages.email_rows(df, mailto=False, domains=["example.com"]))["emails"] == ["a.b@example.com"]
    phones = one(pages.phone_rows(df))["phones"]
    assert "+1 (555) 010-2030" in phones and "+44 20 7946 0958" in phones
    assert contacts.usable_patterns(["([", " \\d+ ", ""]) == ["\\d+"]


def test_email_scan_equals_plain_pattern(spark):
    import re

    texts = ["a@b.com1@c.de x", "..a@b.co", "aaa" * 50 + "@x.yy", "a@b@c.com", "@x.com", "%+-@d-e.fg.hij9", "a@b.c a@b.cd-e@f.gh"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", contacts.email_matches(c("t")).alias("m"))
    for r in df.collect():
        assert r["m"] == re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r["t"]), r["t"]


def test_jsonld(spark):
    html = """<script type="application/ld+json">[{"@type":["Product"," Thing "],"aggregateRating":{"reviewCount":"12"}},{"@type":"review"}]</script>
      <script type='application/ld+json'>{"@graph":[{"@type":"Org","aggregateRating":{"ratingCount":3}},[{"name":"n"}]]}</script><script type="application/ld+json">{oops</script>"""
    r = one(pages.jsonld_rollup(page(spark, html)))
    assert (r["script_count"], r["node_count"], r["review_count"], r["rating_count"]) == (3, 5, 1, 15.0)
    assert r["schema_types"] == ["Org", "Product", "Thing", "review"]
    full = one(pages.metadata_rows(page(spark, html), raw=True))
    assert full["schema_types"] == "Org | Product | Thing | review" and full["jsonld_preview"].startswith("[{")


def test_images(spark):
    html = """<img src='/a/B.PNG?x=1' width=500 height="100"><img alt=' Cat ' src="/a/B.PNG?x=1" width='500' height='100'><img src="data:image/png;base64,AA"><img src="https://e.example/x" width="500" height="500" alt="a/b">"""
    inv = images.inventory(page(spark, html)).orderBy("pos").collect()
    assert [(r["url"], r["ext"], r["size_class"]) for r in inv] == [("https://e.example/a/B.PNG?x=1", "png", "small"), ("https://e.example/x", "img", "large")]
    area = spark.createDataFrame([(49999, "small"), (50000, "medium"), (249999, "medium"), (250000, "large")], "a int, want string")
    assert area.filter(images.size_class(c("a"), F.lit(1)) != c("want")).count() == 0
    names = [r["file_name"] for r in images.name_files(images.inventory(page(spark, html)), "{alt} {index}").orderBy("pos").collect()]
    assert names == ["image_1.png", "a_b_2.img"]


def test_url_rules(spark):
    base = "https://E.example:8443/a/b/c.html?q=1#f"
    cases = [
        ("../x/./y?z#w", "https://e.example:8443/a/x/y?z#w"), ("//o.example/p", "https://o.example/p"), ("/r", "https://e.example:8443/r"), ("?k=v", "https://e.example:8443/a/b/c.html?k=v"),
        ("#t", "https://e.example:8443/a/b/c.html?q=1#t"), ("", "https://e.example:8443/a/b/c.html?q=1"), ("mailto:x@y.z", ""), ("HTTP://U.example:80", "http://u.example/"),
        ("/a b/ü", "https://e.example:8443/a%20b/%C3%BC"), ("../../../..", "https://e.example:8443/"), ("ftp://x", ""), ("http://", ""),
    ]
    df = spark.createDataFrame([(a, b, base) for a, b in cases], "raw string, want string, base string").withColumn("got", urls.absolute(c("raw"), c("base")))
    assert [(r["raw"], r["got"]) for r in df.collect()] == cases
    guard = [("http://10.1.2.3/", "BLOCKED_TARGET_HOST"), ("https://172.32.0.1/", None), ("https://172.31.0.1/", "BLOCKED_TARGET_HOST"), ("http://[::1]/", "BLOCKED_TARGET_HOST"), ("https://a.internal", "BLOCKED_TARGET_HOST"),
             ("ftp://a.example", "X"), ("", "X"), ("https://100.64.0.1", "BLOCKED_TARGET_HOST"), ("https://8.8.8.8/p", None)]
    g = spark.createDataFrame(guard, "u string, want string").withColumn("got", urls.public_target(c("u"), "X")["code"])
    assert [(r["u"], r["got"]) for r in g.collect()] == guard


def test_entity_keys(spark):
    rows = [
        ("https://maps.example/p/x?cid= 12 &a=1", "N", "", "", "cid:12"), ("https://Maps.example/P X/", "N", "", "", "path:https://maps.example/p%20x/".replace("%", "_")), ("not a url", "N", "", "", "url:not_a_url"),
        ("", "The  Cafe!", "1 Road", "", "name_addr:the_cafe_|1_road"), ("", "Cafe", "", "+1 5", "name_phone:cafe|+1_5"), ("", "Cafe", "", "", "name:cafe"), ("", "", "x", "y", ""),
    ]
    df = spark.createDataFrame(rows, "u string, n string, a string, p string, want string").withColumn("got", places.entity_key(c("u"), c("n"), c("a"), c("p")))
    assert [r["got"] for r in df.collect()] == [r[4] for r in rows]


def test_crawl_depth_cycle_and_missing_pages(spark):
    pages_ = spark.createDataFrame(
        [
            (1, "https://h.example/", '<body>root@h.example <a href="/a">a</a><a href="/gone">g</a><a href="https://other.example/x">o</a><a href="/a">again</a></body>'),
            (2, "https://h.example/a", '<a href="/">home</a><a href="/b">b</a> a@h.example'),
            (3, "https://h.example/b", '<a href="/c">c</a> b@h.example'),
            (4, "https://h.example/c", "c@h.example"),
        ],
        "page_id long, url string, html string",
    )
    assert [r["link"] for r in links.page_links(pages_).filter("url = 'https://h.example/'").orderBy("pos").collect()] == ["https://h.example/a", "https://h.example/gone"]
    got = {d: {r["url"]: (r["scanned_pages"], r["email_count"]) for r in links.deep_scan(pages_, depth=d).collect()} for d in (1, 3, 9)}
    assert got[1]["https://h.example/"] == (1, 2) and got[3]["https://h.example/"] == (3, 4) and got[9] == got[3]


def test_deep_scan_query_follows_every_link(spark):
    from types import SimpleNamespace

    from pagegrid.plans import registry

    registry.load()
    names = [f"https://h.example/p{i}" for i in range(30)]
    body = "".join(f'<a href="{n}">x</a>' for n in names)
    pages_ = spark.createDataFrame([(i, n, f"<body>{body} mail{i}@h.example</body>") for i, n in enumerate(names)], "page_id long, url string, html string")
    got = registry._QUERIES["j10_deep_scan"](SimpleNamespace(pages=pages_))
    assert {(r["scanned_pages"], r["email_count"]) for r in got.collect()} == {(29, 30)}
    assert {r["scanned_pages"] for r in links.deep_scan(pages_, cap=20).collect()} == {19, 20}


def test_deep_scan_with_hubs_equals_a_walk(spark, monkeypatch):
    monkeypatch.setattr(links, "_HUB", 5)
    monkeypatch.setattr(links, "_MOST_HUBS", 10)
    rng = random.Random(11)
    out = {i: {0, *(rng.randrange(130) for _ in range(rng.randrange(4)))} for i in range(120)}  # every page links to 0; pages over 119 are not stored
    rows = [(i, f"https://h{i % 2}.example/p{i}", f"<body>m{i % 7}@h.example " + "".join(f'<a href="https://h{j % 2}.example/p{j}">x</a>' for j in sorted(to)) + "</body>") for i, to in out.items()]
    pages_ = spark.createDataFrame(rows + rows[:5], "page_id long, url string, html string")
    for depth in (1, 2, 4):
        want = {}
        for seed in out:
            seen, front = {seed}, {seed}
            for _ in range(depth):
                front = {j for i in front for j in out[i] if j in out and j % 2 == i % 2} - seen
                seen |= front
            want[f"https://h{seed % 2}.example/p{seed}"] = (len(seen) - 1, len({i % 7 for i in seen}))
        assert {r["url"]: (r["scanned_pages"], r["email_count"]) for r in links.deep_scan(pages_, depth=depth).collect()} == want


CARDS = "".join(f'<article class="result-card x{i % 2}"><h2>Name {i}</h2><p>City <em>{i}</em></p><a href="/item/{i}">more</a></article>' for i in range(1, 7))
LIST = f"<html><body><div id='main'><section>{CARDS}</section></div><p hidden>secret<p style='display: none'>also<footer><button>Show more</button><a class=next href='?page=2'>Next</a></footer></body></html>"


def test_node_table_visibility_and_repair(spark):
    n = nodes.node_table(page(spark, LIST + "</div></nope>"))
    vis = {(r["tag"], r["visible"]) for r in n.filter("tag = 'p'").select("tag", "visible").distinct().collect()}
    assert vis == {("p", True), ("p", False)}
    assert nodes.elements(n).filter("tag = 'article'").count() == 6
    nested = n.join(n.select("page_id", c("node_id").alias("parent_id"), c("post").alias("up_post")), ["page_id", "parent_id"])
    assert nested.filter("node_id <= parent_id OR post > up_post").count() == 0


def test_list_extraction_and_selectors(spark):
    p = page(spark, LIST)
    fields = [{"name": "name", "selector": "h2"}, {"selector": "a", "extractMode": "link_url"}, {"name": "n", "relativeSelector": "p > em"}, {"name": "none", "selector": ".zip"}]
    rows = nodes.extract_list(p, "section > article.result-card", fields).orderBy("container").collect()
    assert len(rows) == 6 and rows[1].asDict() == {"page_id": 1, "container": rows[1]["container"], "name": "Name 2", "field_2": "https://e.example/item/2", "n": "2", "none": ""}
    n = nodes.node_table(p)
    assert nodes.select(n, "article:nth-of-type(2) h2, a[href^='/item'], a[class~=next]").count() == 8
    assert one(autodetect.next_links(p, n))["next_url"] == "https://e.example/dir/p.html?page=2"
    sel = nodes.absolute_selectors(n, nodes.elements(n).filter("tag = 'em'")).orderBy("node_id").first()["selector"]
    assert sel == "body > div > section > article:nth-of-type(1) > p > em"
    assert one(nodes.absolute_selectors(n, nodes.elements(n).filter("id = 'main'")))["selector"] == "#main"


def test_deep_and_wide_pages_stay_linear(spark):
    deep = "<body>" + "".join(f"<div><b>{i}</b>" for i in range(5000)) + "</div>" * 5000 + "</body>"
    wide = "<body><ul>" + "".join(f"<li><a href='/{i}'>n{i}</a></li>" for i in range(5000)) + "</ul></body>"
    both = page(spark, deep).unionByName(page(spark, wide, page_id=2))
    start = time.time()
    n = stage(nodes.node_table(both), "nodes")
    assert nodes.select(n, "div div > b").count() == 4999 and nodes.select(n, "body div + b, li + li > a").count() == 4999
    rows = nodes.extract_list(both, "li", [{"name": "name", "selector": "a"}, {"name": "link", "selector": ":scope > a", "extractMode": "link_url"}])
    assert rows.filter("name = 'n4999' AND link = 'https://e.example/4999'").count() == 1 and rows.count() == 5000
    texts = nodes.subtree_texts(n, nodes.select(n, "body > div > div"))
    assert one(texts)["content"] == " ".join(map(str, range(1, 5000)))
    assert time.time() - start < 60


def test_enclosed_and_first_match(spark):
    rng = random.Random(5)
    parts, opened = ["<body>"], []
    for i in range(300):
        if opened and rng.random() < 0.45:
            parts.append(f"</{opened.pop()}>")
        else:
            opened.append(rng.choice(["i", "b", "u"]))
            parts.append(f"<{opened[-1]}>t{i}")
    n = stage(nodes.node_table(page(spark, "".join(parts))), "nodes")
    rows = nodes.elements(n).collect()
    span = {r["node_id"]: (r["tag"], r["post"]) for r in rows}
    inside = {(p, h) for p, (tp, _) in span.items() for h, (th, end) in span.items() if tp == "b" and th == "i" and h < p <= end}
    pick = lambda tag: nodes.elements(n).filter(c("tag") == tag)
    assert {(r["node_id"], r["holder"]) for r in nodes.enclosed(pick("b"), pick("i")).collect()} == inside
    assert {(r["node_id"], r["holder"]) for r in nodes.enclosed(pick("b"), pick("b"), or_self=True).collect() if r["node_id"] == r["holder"]} == {(p, p) for p, (t, _) in span.items() if t == "b"}
    first = {(r["container"], r["node_id"]) for r in nodes.first_match(pick("b"), pick("i")).collect()}
    assert first == {(h, min(p for p, x in inside if x == h)) for _, h in inside}
    assert {r["node_id"] for r in nodes.select(n, "i b").collect()} == {p for p, _ in inside}
    parent = {r["node_id"]: r["parent_id"] for r in rows}
    assert {r["node_id"] for r in nodes.select(n, "i > b").collect()} == {p for p, h in inside if parent[p] == h}


def test_attribute_hints(spark):
    n = nodes.node_table(page(spark, '<body><a href="/x" title="t" class="k">x</a><img alt="p"><p data-id="7">y</p></body>'))
    got = {r["tag"]: [(h["mode"], h["attribute"]) for h in r["hints"]] for r in nodes.elements(n).select("tag", nodes.attribute_hints().alias("hints")).collect()}
    assert got["a"] == [("link_url", ""), ("attribute", "title"), ("attribute", "class")] and got["img"] == [("image_url", ""), ("attribute", "alt")]
    assert got["p"] == [("attribute", "data-id")] and got["body"] == []


def test_autodetect(spark):
    p = page(spark, LIST).unionByName(page(spark, "<body><p>nothing here</p></body>", page_id=2))
    d = {r["page_id"]: r.asDict() for r in autodetect.detect(p).collect()}
    assert not d[2]["ok"] and d[2]["error"].startswith("No repeating")
    assert d[1]["ok"] and d[1]["item_count"] == 6 or d[1]["item_count"] == 3
    assert d[1]["load_more"] == "click_button" and d[1]["button_selector"] == "body > footer > button"
    names = [f["name"] for f in d[1]["fields"]]
    assert len(names) == len(set(names)) and len(d[1]["preview_rows"]) <= 5
    dup = spark.range(1).select(autodetect.unique_names(F.array(*[F.lit(x) for x in ("a", "a", "a_2", "a", "b")])).alias("n"))
    assert one(dup)["n"] == ["a", "a_2", "a_2_2", "a_3", "b"]


def test_anchor_prefers_containing_group(spark):
    html = f"<body><div><ul>{''.join(f'<li>item {i}</li>' for i in range(3))}</ul></div><div><section>{CARDS}</section></div></body>"
    n = nodes.node_table(page(spark, html))
    groups, items = autodetect.repeating_groups(n)
    hit = nodes.select(n, "ul li:nth-of-type(2)").select("page_id", c("node_id").alias("anchor_id"), c("post").alias("anchor_post"))
    assert one(autodetect.best_group(groups, items, hit))["signature"] == "li|"
    assert one(autodetect.best_group(groups, items))["signature"].startswith("article|")


def test_pagination_rounds_and_cycle(spark):
    data = [(1, r, f"row{i}") for r in range(30) for i in range(min(6 * (r + 1), 144))]
    h = autodetect.round_history(spark.createDataFrame(data, "run_id int, round int, row_key string"), threshold=3)
    stop = one(autodetect.run_stops(h))
    assert (stop["stop_reason"], stop["round"], stop["total_rows"]) == ("no_change", 26, 144)
    capped = one(autodetect.run_stops(autodetect.round_history(spark.createDataFrame(data, "run_id int, round int, row_key string"), max_rows=60)))
    assert (capped["stop_reason"], capped["total_rows"]) == ("row_cap", 60)
    visits = [(1, i, f"https://s.example/{i}/", f"https://s.example/{i + 1 if i < 24 else 1}#x") for i in range(1, 25)]
    cyc = one(autodetect.navigation_cycle(spark.createDataFrame(visits, "run_id int, step int, url string, next_url string")))
    assert (cyc["step"], cyc["stop_reason"]) == (24, "next_link_cycle")


def test_goal_texts(spark):
    texts = ["I want info for home services in Miami latest", "latest ai market news", "export json", "enable all access", "top 25 plumbers near me", "scrape https://x.example/a for emails"]
    f = labels.goal_flags(c("t"))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[v.alias(k) for k, v in f.items()]).withColumn("q", labels.goal_query(c("t")))
    named = {k: c(k) for k in f}
    df = df.withColumn("url", labels.goal_discovery_url(c("q"), named))
    r = {x["t"]: x for x in df.withColumn("s", labels.goal_strategy(named, c("url"))).collect()}
    first = r[texts[0]]
    assert first["wants_local_leads"] and first["wants_fresh"] and first["s"] == "maps_autopilot" and first["url"] == "https://www.google.com/maps/search/home+services+in+Miami+latest"
    assert r[texts[1]]["url"].endswith("&tbs=qdr:d") or r[texts[1]]["s"] == "idle"
    assert (r[texts[2]]["s"], r[texts[2]]["export_format"], r[texts[3]]["s"]) == ("export_only", "json", "access_only")
    assert r[texts[4]]["result_target"] == 25 and r[texts[5]]["explicit_url"] == "https://x.example/a"


def test_seen_entities(spark):
    rows = spark.createDataFrame([("s", "a", 1), ("s", "a", 2), ("s", "b", 3), ("s", "", 4), ("s", "", 5)], "scope string, entity_key string, n int")
    seen = spark.createDataFrame([("s", "b"), ("z", "a")], "scope string, entity_key string")
    assert sorted(r["n"] for r in places.unseen(rows, seen).collect()) == [1, 4, 5]


def test_selector_forms(spark):
    html = """<body><div id=d><p class="a b" lang=en-US>1</p><span>2</span><p lang=en>3</p><p data-x="">4</p><p class=c><em>5</em></p></div><div><p>6</p></div></body>"""
    n = nodes.node_table(page(spark, html))
    texts = nodes.elements(n).filter("tag in ('p', 'span', 'em')").orderBy("node_id").select("node_id").collect()
    order = {r["node_id"]: i for i, r in enumerate(texts, 1)}

    def named(selector):
        return sorted(order[r["node_id"]] for r in nodes.select(n, selector).select("node_id").collect())

    # places of p and span in document order; the em inside the fifth counts as sixth
    assert named("p[lang|=en]") == [1, 3] and named("p[lang=en]") == [3]
    assert named("p[data-x*='']") == [] and named("p[data-x^='']") == [] and named("p[data-x$='']") == [] and named("p[data-x]") == [4]
    assert named("#d > p:not(.a):not([lang|='en'])") == [4, 5] and named("#d > :not(p, span)") == []
    assert named("#d > :nth-child(2)") == [2] and named("#d > p:nth-child(odd)") == [1, 3, 5] and named("#d > :nth-child(-n+2)") == [1, 2]
    assert named("span + p") == [3] and named("span ~ p") == [3, 4, 5] and named("span ~ p em") == [6] and named(".a + span + p") == [3]
    assert named("p:last-child") == [5, 7] and named("p:only-child") == [7] and named("p:first-of-type") == [1, 7] and named("p:nth-last-of-type(1)") == [5, 7]
    scope = nodes.elements(n).filter("id = 'd'").select("page_id", "node_id")
    assert sorted(order[r["node_id"]] for r in nodes.select(n, ":scope > span, :scope > p.c > em", scope).collect()) == [2, 6]
    for bad in ("p >", "a:hover", "p:nth-child(x)", ""):
        with pytest.raises(ValueError):
            nodes.select(n, bad)


def test_long_lists_are_found(spark):
    html = "<body><div><ul>" + "".join(f'<li class="row"><a href="/i/{i}">Item {i}</a><b>price {i}</b></li>' for i in range(260)) + "</ul></div></body>"
    groups, items = autodetect.repeating_groups(nodes.node_table(page(spark, html)))
    best = autodetect.best_group(groups, items).first()
    assert best["item_count"] == 260 and best["signature"] == "li|row"


def test_small_tables_of_pages_are_spread(spark, tmp_path):
    # F6, F8, F10, F13, F14, F17: the pages made of one small file were read in one task
    from pagegrid.plans.tables import Tables
    from pagegrid.queries import lists, pages

    spark.createDataFrame([(k, f"ring {k}", "b", "t", 40, 1.0) for k in range(50)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k,) for k in range(50)], "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    t = Tables(spark, str(tmp_path))
    cores = spark.sparkContext.defaultParallelism
    assert t.part.rdd.getNumPartitions() < cores
    for df in (pages._with_images(t), pages._place_pages(t), lists._paged(t)):
        assert df.rdd.getNumPartitions() >= cores


def test_plain_pages_take_no_tolerant_parser(monkeypatch):
    # every tag went through the tolerant parser
    from pagegrid.operators import nodes as nt

    fields = lambda tree: [(n["tag"], n["attrs"], n["parent"], n["text"], n["post"]) for n in tree.nodes]

    def tolerant(html):
        tree = nt._Tree()
        tree.feed(html)
        tree.close()
        tree._close(0)
        return fields(tree)

    odd = ["<p>a<b>c</p> x", "a &amp; b<li>1<li>2", "<ul><LI Class='x'>y</ul>", "<title>a<b>c</title><i>d", "x<br/>y<!-- <p> --><p hidden>z", "<a b=\"1\"c=\"2\">t</a >", "<", "</ul><p>é</p", "<script>if(a<b){}</script>q", "a <b & c", "<titled>x</titled>"]
    plain = '<html><body class="a  b"><ul><li id="x" DATA-a="1">one<li>two</ul><img src="/i">\n<P>three > two</p></body></html>'
    for html in [*odd, plain, *[plain + x for x in odd]]:
        assert fields(nt._read(nt._Tree(), html)) == tolerant(html)
    want = tolerant(plain)

    def refused(self, data):
        raise AssertionError(data)

    monkeypatch.setattr(nt._Tree, "feed", refused)
    assert fields(nt._read(nt._Tree(), plain)) == want


def _card_pages(spark, pages):
    html = "concat('<body><div><ul>', array_join(transform(sequence(1, 4), k -> concat('<li><a href=\"/p/', id * 10 + k, '\">Part ', k, '</a><b>', k, ' pcs</b></li>')), ''), '</ul></div></body>')"
    return spark.range(pages).selectExpr("CASE WHEN id < 39 THEN id END AS page_id", "'https://shop.example.com/o' AS url", f"{html} AS html")


def test_nodes_by_page_need_no_exchange(spark):
    pages = _card_pages(spark, 40)
    n = nodes.nodes_by_page(pages)
    assert sorted(map(repr, n.collect())) == sorted(map(repr, nodes.node_table(pages).collect()))  # a page without an id too
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = nodes.elements(n).join(n.filter("tag = 'a'").select("page_id", "node_id", "attrs"), ["page_id", "node_id"]).groupBy("page_id", "parent_id").count()
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert both.count() == 39 * 4
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_detection_from_nodes_by_page(spark):
    pages = _card_pages(spark, 39)
    plain, laid = (autodetect.detect(pages, n).orderBy("page_id").collect() for n in (stage(nodes.node_table(pages), "nodes"), nodes.nodes_by_page(pages)))
    assert plain == laid and len(laid) == 39 and all(r["ok"] and len(r["fields"]) == 2 for r in laid)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"  # as it was


def test_released_buckets_are_gone(spark, monkeypatch):
    monkeypatch.setattr(lineage, "_STAGED", [])
    monkeypatch.setattr(lineage, "_TABLES", [])
    kept = lineage.stage_by(spark.range(10), "kept", "id", parts=3)
    assert kept.rdd.getNumPartitions() <= 3 and kept.count() == 10
    (_, name), (_, path) = lineage._TABLES[0], lineage._STAGED[0]
    lineage.release()
    assert not spark.catalog.tableExists(name) and not os.path.exists(path)


def test_place_pages_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    from pagegrid.plans.tables import Tables
    from pagegrid.queries import pages as place_queries

    spark.range(1, 101).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(place_queries, "_TASK_PAGES", 7)
    assert place_queries._place_tasks(Tables(spark, str(tmp_path))) == 15


def test_staged_pages_are_never_broadcast(spark):
    """Rows of repeating keys lie in small files: joins by page must not take them for small tables."""
    kept = lineage.stage_by(spark.range(1000), "kept", "id", parts=3)
    some = kept.filter("id > 5").groupBy("id").agg(F.max("id").alias("most"))
    plan = spark.range(50).join(some, "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan

    lists = spark.createDataFrame(
        [(i, "https://e.example/p", f"<body><div><ul>{''.join(f'<li class=card><a href=/p/{k}>Part {k}</a><b>{k} pcs</b></li>' for k in range(i, i + 4))}</ul></div><button>Load more</button></body>") for i in range(1, 6)],
        "page_id long, url string, html string",
    )
    made = {}
    staged = lineage.stage_by

    def noted(df, label, *rest, **options):
        made[label] = df._jdf.queryExecution().executedPlan().toString()
        return staged(df, label, *rest, **options)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(autodetect, "stage_by", noted)
        found = autodetect.detect(lists)
        nodes_ = nodes.nodes_by_page(lists)
        groups, items = autodetect.repeating_groups(nodes_)
        hit = nodes.select(nodes_, "li")
        anchors = hit.join(nodes.first_match(hit), ["page_id", "node_id"]).select("page_id", c("node_id").alias("anchor_id"), c("post").alias("anchor_post"))
        made["anchored"] = autodetect.best_group(groups, items, anchors)._jdf.queryExecution().executedPlan().toString()
        made["detected"] = found._jdf.queryExecution().executedPlan().toString()
    assert {"items", "held", "inside", "candidates", "targets", "values", "best", "groups", "fields", "controls"} <= set(made)
    assert [label for label, plan in made.items() if "Broadcast" in plan] == []
    rows = found.orderBy("page_id").collect()
    assert [(r["ok"], r["container_selector"], r["item_count"], r["load_more"]) for r in rows] == [(True, "body > div > ul > li.card", 4, "click_button")] * 5


def test_texts_of_known_spans(spark):
    n = stage(nodes.node_table(page(spark, "<body><ul><li>é <b>two</b></li><li hidden>no</li><li></li></ul><button> Load  more</button></body>")), "nodes")
    known = nodes.elements(n).filter("tag IN ('li', 'button')")
    found = {(r["node_id"], r["content"]) for r in nodes.span_texts(n, known).collect()}
    assert found == {(r["node_id"], r["content"]) for r in nodes.subtree_texts(n, known).collect()}
    assert {text for _, text in found} == {"é two", "Load more"}
