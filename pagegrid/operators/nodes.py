"""Node table of stored pages and selector extraction over it.

Parsing is the one step that needs Python: a tolerant standard-library parser turns each page
into rows inside Arrow batches. A node is an interval of document order, ``node_id`` to ``post`` (its last
descendant); intervals of a page are nested or apart. What stands inside what is therefore a running maximum over the
page (selectors) or one merge with a stack (``enclosed``), never a comparison of pairs, and no node stores its
ancestors. ``t0`` and ``t1`` are the bytes of a node in the visible text of its page. There is no layout: a node counts as visible unless it or an ancestor
is ``hidden``, has an inline ``display:none`` / ``visibility:hidden``, or sits in head-like tags.
"""
from __future__ import annotations

import itertools
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagegrid.functions.text import clean_text
from pagegrid.functions.urls import absolute
from pagegrid.plans.lineage import stage, stage_by

c = F.col

NODE_SCHEMA = (
    "page_id long, node_id int, parent_id int, post int, depth int, body int, tag string, id string, classes array<string>, "
    "attrs map<string,string>, visible boolean, nth int, same_tag int, child int, siblings int, t0 long, t1 long, text string"
)
# Fixed values of the page format: elements without content, and start tags that close an open element.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSED_BY = {
    "li": {"li"},
    "p": {"p", "div", "ul", "ol", "table", "section", "article", "header", "footer", "nav", "h1", "h2", "h3", "h4", "h5", "h6", "form", "blockquote", "pre", "main", "aside"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "option": {"option"},
}
UNSEEN = {"head", "script", "style", "noscript", "template", "title", "meta", "link"}
_HIDING = re.compile(r"(display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


class _Tree(HTMLParser):
    """Collects nodes of one page in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.tags: dict[str, int] = {}  # how many of each tag are open

    def _add(self, tag: str, attrs: dict, text: str | None = None) -> int:
        parent = self.open[-1] if self.open else None
        node = {"tag": tag, "attrs": attrs, "parent": parent, "text": text, "post": len(self.nodes)}
        self.nodes.append(node)
        return len(self.nodes) - 1

    def _close(self, upto: int) -> None:
        while len(self.open) > upto:
            node = self.nodes[self.open.pop()]
            node["post"] = len(self.nodes) - 1
            self.tags[node["tag"]] -= 1

    def handle_starttag(self, tag, attrs):
        while self.open and tag in CLOSED_BY.get(self.nodes[self.open[-1]]["tag"], ()):
            self._close(len(self.open) - 1)
        index = self._add(tag, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self.open.append(index)
            self.tags[tag] = self.tags.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.tags.get(tag):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[i]]["tag"] == tag:
                self._close(i)
                return

    def handle_data(self, data):
        if self.open and data.strip() and self.nodes[self.open[-1]]["tag"] not in ("script", "style"):
            self._add("#text", {}, data)


_NAME, _GAP = r"[a-zA-Z][a-zA-Z0-9]*", r"[ \t\n\r]"
# Tokens that need no tolerance: texts without references, plain tags, attributes in double quotes. What elements of raw
# text hold is left to the parser.
_RAW = "script|style|textarea|title|plaintext|xmp|iframe|noembed|noframes|noscript"
_TOKEN = re.compile(rf"""([^<&]+)|<(?!(?i:{_RAW})(?![a-zA-Z0-9]))({_NAME})((?:{_GAP}+[a-zA-Z_][-\w:.]*="[^"<>&]*")*+){_GAP}*+>|</(?!(?i:{_RAW})(?![a-zA-Z0-9]))({_NAME})>""", re.A)
_PAIR = re.compile(r"""([a-zA-Z_][-\w:.]*)="([^"]*)\"""", re.A)


def _read(tree: _Tree, html: str) -> _Tree:
    """Feeds a page to the tree: by plain tokens from its start, and by the tolerant parser from the first other one on."""
    at = 0
    for token in iter(_TOKEN.scanner(html).match, None):
        text, tag, attrs, end = token.groups()
        if text is not None:
            if token.end() == len(html) or html[token.end()] == "&":
                break  # the text may go on
            tree.handle_data(text)
        elif tag is not None:
            tree.handle_starttag(tag.lower(), [(k.lower(), v) for k, v in _PAIR.findall(attrs)] if attrs else [])
        else:
            tree.handle_endtag(end.lower())
        at = token.end()
    if at < len(html):
        tree.feed(html[at:])
    tree.close()
    tree._close(0)
    return tree


_COLUMNS = ["page_id", "node_id", "parent_id", "post", "depth", "body", "tag", "id", "classes", "attrs", "visible", "nth", "same_tag", "child", "siblings", "t0", "t1", "text"]


def _append(out: dict[str, list], page_id: int, html: str) -> None:
    """Add one page's nodes to column lists, in time proportional to the page."""
    nodes = _read(_Tree(), html or "").nodes
    totals: dict[tuple, int] = {}
    children: dict[int | None, int] = {}
    depth, body, seen, before, after, child, nth, kinds, length = [], [], [], [], [], [], [], [], 0
    for n in nodes:
        parent, tag, a = n["parent"], n["tag"], n["attrs"]
        element = tag != "#text"
        if element:
            children[parent] = children.get(parent, 0) + 1
        child.append(children.get(parent, 0))
        kind = parent, tag
        kinds.append(kind)
        totals[kind] = count = totals.get(kind, 0) + 1
        nth.append(count)
        shown = not a or ("hidden" not in a and not ("style" in a and _HIDING.search(a["style"])))
        shown = shown and tag not in UNSEEN
        if parent is None:
            depth.append(0)
            body.append(0 if tag == "body" else None)
        else:
            deep, above = depth[parent] + 1, body[parent]
            depth.append(deep)
            body.append(deep if above is None and tag == "body" else above)
            shown = shown and seen[parent]
        seen.append(shown)
        before.append(length)
        if shown and not element:
            length += len(n["text"].encode("utf-8", "replace")) + 1  # a blank between two texts
        after.append(length)
    ends = [n["post"] for n in nodes]
    held = [n["attrs"] for n in nodes]
    out["child"] += child
    out["nth"] += nth
    out["same_tag"] += [totals[k] for k in kinds]
    out["siblings"] += [children.get(p, 0) for p, _ in kinds]
    out["parent_id"] += [p for p, _ in kinds]
    out["post"] += ends
    out["tag"] += [t for _, t in kinds]
    out["id"] += [a.get("id", "") if a else "" for a in held]
    out["classes"] += [a["class"].split() if "class" in a else [] for a in held]
    out["attrs"] += [list(a.items()) for a in held]
    out["text"] += [n["text"] for n in nodes]
    out["t1"] += [after[e] for e in ends]
    out["page_id"] += [page_id] * len(nodes)
    out["node_id"] += range(len(nodes))
    out["depth"] += depth
    out["body"] += body
    out["visible"] += seen
    out["t0"] += before


_ARROW = pa.schema(
    [
        ("page_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("post", pa.int32()), ("depth", pa.int32()), ("body", pa.int32()), ("tag", pa.string()), ("id", pa.string()),
        ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("visible", pa.bool_()), ("nth", pa.int32()), ("same_tag", pa.int32()), ("child", pa.int32()), ("siblings", pa.int32()),
        ("t0", pa.int64()), ("t1", pa.int64()), ("text", pa.string()),
    ]
)
_FLUSH = 5_000


def _ends(lists: list[list]) -> pa.Array:
    return pa.array([0, *itertools.accumulate(map(len, lists))], pa.int32())


def node_table(pages: DataFrame) -> DataFrame:
    """One row per element and per text run of each page; batches are flushed by node count."""

    def parse(batches):
        def flush(columns):
            # lists and maps from their parts, which takes less time than from nested objects
            made = {"classes": pa.ListArray.from_arrays(_ends(columns["classes"]), pa.array([x for l in columns["classes"] for x in l], pa.string()))}
            pairs = [x for l in columns["attrs"] for x in l]
            made["attrs"] = pa.MapArray.from_arrays(_ends(columns["attrs"]), pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string()))
            return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.array(columns[f.name], type=f.type) for f in _ARROW], schema=_ARROW)

        pending = {n: [] for n in _COLUMNS}
        for batch in batches:
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                _append(pending, page_id, html)
                if len(pending["tag"]) >= _FLUSH:
                    yield flush(pending)
                    pending = {n: [] for n in _COLUMNS}
        if pending["tag"]:
            yield flush(pending)

    return pages.select(c("page_id").cast("long").alias("page_id"), "html").mapInArrow(parse, NODE_SCHEMA)


def nodes_by_page(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """The node table, staged in buckets of pages; pages are exchanged before they are parsed, when rows are few."""
    n = parts or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage_by(node_table(pages.select(c("page_id").cast("long").alias("page_id"), "html").repartition(n, "page_id")), "nodes", "page_id", laid=True, parts=n)


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.filter("tag <> '#text'")


def page_texts(nodes: DataFrame) -> DataFrame:
    """(page_id, whole): the visible texts of a page in order, with a blank between them, as bytes."""
    runs = nodes.filter("tag = '#text' AND visible").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "text"))).alias("l"))
    return runs.select("page_id", F.array_join(F.transform("l", lambda x: x["text"]), " ").cast("binary").alias("whole"))


def text_between(whole: Column, t0: Column, t1: Column) -> Column:
    """Cleaned text of a node from the bytes of its page."""
    return clean_text(F.substring(whole, (t0 + 1).cast("int"), (t1 - t0 - 1).cast("int")).cast("string"))


def subtree_texts(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, node_id, content) of the wanted nodes that hold visible text: its runs in order, cleaned."""
    return span_texts(nodes, nodes.join(wanted.select("page_id", "node_id").distinct(), ["page_id", "node_id"], "left_semi"))


def span_texts(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """As ``subtree_texts``, of rows of the node table that still have their ``t0`` and ``t1``."""
    spans = wanted.filter("t1 > t0").select("page_id", "node_id", "t0", "t1")
    return spans.join(page_texts(nodes), "page_id").select("page_id", "node_id", text_between(c("whole"), c("t0"), c("t1")).alias("content"))


def enclosed(points: DataFrame, holders: DataFrame, or_self: bool = False) -> DataFrame:
    """(page_id, node_id, holder) for each point (page_id, node_id) and each holder (page_id, node_id, post) around it.

    A merge with a stack: the points and holders of a page come in document order, the holders open at a point are those
    around it. Its time is that of the sort and of what it returns, however deep or wide pages are nested.
    """
    both = holders.select("page_id", "node_id", "post", F.lit(0).alias("role")).distinct().unionByName(points.select("page_id", "node_id", F.lit(None).cast("int").alias("post"), F.lit(1).alias("role")).distinct())
    # a point that is a holder itself comes before the holder, or after it if it counts as inside
    laid = both.repartition("page_id").sortWithinPartitions("page_id", "node_id", c("role") if or_self else -c("role"))

    def merge(batches):
        page, around = None, []
        for batch in batches:
            out = ([], [], [])
            for p, at, end, role in zip(*(batch.column(n).to_pylist() for n in ("page_id", "node_id", "post", "role")), strict=True):
                if p != page:
                    page, around = p, []
                while around and around[-1][1] < at:
                    around.pop()
                if role == 0:
                    around.append((at, end))
                else:
                    out[0].extend([p] * len(around)), out[1].extend([at] * len(around)), out[2].extend(h for h, _ in around)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["page_id", "node_id", "holder"])

    return laid.mapInArrow(merge, "page_id long, node_id int, holder int")


def places(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, node_id, trail, spots) of the wanted nodes (page_id, node_id, top): the steps that lead to them from below
    depth ``top``, as selector parts and as ``tag:position``. Only these nodes get arrays.
    """
    asked = wanted.select("page_id", "node_id", "top").distinct().withColumn("asked", F.lit(True))
    rows = elements(nodes).select("page_id", "node_id", "depth", "tag", "nth", "same_tag").join(asked, ["page_id", "node_id"], "left")
    laid = rows.repartition("page_id").sortWithinPartitions("page_id", "node_id")

    def walk(batches):
        page, trail, spots = None, [], []
        for batch in batches:
            out = ([], [], [], [])
            for p, at, depth, tag, nth, same, top, want in zip(*(batch.column(n).to_pylist() for n in ("page_id", "node_id", "depth", "tag", "nth", "same_tag", "top", "asked")), strict=True):
                if p != page:
                    page, trail, spots = p, [], []
                del trail[depth:], spots[depth:]
                trail.append(tag if depth == 0 or same <= 1 else f"{tag}:nth-of-type({nth})")
                spots.append(f"{tag}:{nth}")
                if want:
                    out[0].append(p), out[1].append(at), out[2].append(trail[top + 1 :]), out[3].append(spots[top + 1 :])
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["page_id", "node_id", "trail", "spots"])

    return laid.mapInArrow(walk, "page_id long, node_id int, trail array<string>, spots array<string>")


# -- selectors ---------------------------------------------------------------------------------------

_COMPOUND = re.compile(
    r"""(?P<tag>^[a-zA-Z*][\w-]*|^\*)|\#(?P<id>(?:[\w-]|\\.)+)|\.(?P<cls>(?:[\w-]|\\.)+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*["']?(?P<val>[^"'\]]*)["']?)?\s*\]|:(?P<pseudo>[a-z-]+)(?P<open>\()?"""
)


def _outside(text: str, marks: str) -> list[tuple[int, str]]:
    """Places of ``marks`` outside brackets, parentheses and quotes."""
    found, deep, quote = [], 0, ""
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "([":
            deep += 1
        elif ch in ")]":
            deep -= 1
        elif not deep and ch in marks:
            found.append((i, ch))
    return found


def _parts(text: str, marks: str) -> list[str]:
    edges = [-1, *[i for i, _ in _outside(text, marks)], len(text)]
    return [text[a + 1 : b].strip() for a, b in zip(edges, edges[1:], strict=False)]


def split_selector(selector: str) -> list[list[tuple[str, str]]]:
    """Alternatives of (combinator, compound) steps. Supports tag, id, class and attribute tests, ``:not()``, ``:scope``,
    child and type positions, all four combinators and commas."""
    out = []
    for alternative in _parts(selector, ","):
        steps, combinator, at = [], " ", 0
        for i, ch in [*_outside(alternative, " \t\n>+~"), (len(alternative), " ")]:
            if alternative[at:i].strip():
                steps.append((combinator, alternative[at:i].strip()))
                combinator = " "
            if ch in ">+~":
                combinator = ch
            at = i + 1
        if not steps or combinator != " ":
            raise ValueError(f"incomplete selector: {selector!r}")
        out.append(steps)
    return out


def _position(place: Column, rule: str) -> Column:
    """an+b, ``odd``, ``even`` or a number, tested on a 1-based place."""
    rule = {"odd": "2n+1", "even": "2n"}.get(rule.strip().lower(), rule.strip().lower().replace(" ", ""))
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", rule)
    if not m or not rule:
        raise ValueError(f"unsupported position: {rule!r}")
    step = 0 if m[1] is None else int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
    start = int(m[2] or 0)
    if step == 0:
        return place == start
    return ((place - start) % step == 0) & ((place >= start) if step > 0 else (place <= start))


def compound(token: str, scope: Column | None = None) -> Column:
    """Predicate of one compound selector over node columns; ``scope`` says which nodes ``:scope`` names."""
    test, at = F.lit(True), 0
    while at < len(token):
        m = _COMPOUND.match(token[at:]) if at else _COMPOUND.match(token)
        if not m or m.end() == 0:
            raise ValueError(f"unsupported selector part: {token[at:]!r}")
        g = {k: v for k, v in m.groupdict().items() if v is not None}
        plain = lambda v: re.sub(r"\\(.)", r"\1", v)
        at += m.end()
        if "tag" in g and g["tag"] != "*":
            test = test & (c("tag") == g["tag"].lower())
        if "id" in g:
            test = test & (c("id") == plain(g["id"]))
        if "cls" in g:
            test = test & F.array_contains("classes", plain(g["cls"]))
        if "pseudo" in g:
            inner = ""
            if "open" in g:
                close, deep = at, 1
                while deep:
                    if close >= len(token):
                        raise ValueError(f"unclosed selector part: {token!r}")
                    deep += {"(": 1, ")": -1}.get(token[close], 0)
                    close += 1
                inner, at = token[at : close - 1], close
            test = test & _pseudo(g["pseudo"], inner, scope)
        if "attr" in g:
            value = c("attrs")[g["attr"].lower()]
            op, want = g.get("op"), g.get("val", "")
            empty = F.lit(want != "")  # an empty value is inside nothing
            test = test & (
                value.isNotNull() if op is None
                else (value == want) if op == "="
                else value.contains(want) & empty if op == "*="
                else value.startswith(want) & empty if op == "^="
                else value.endswith(want) & empty if op == "$="
                else ((value == want) | value.startswith(want + "-")) if op == "|="
                else F.array_contains(F.split(value, r"\s+"), want) & empty & F.lit(not re.search(r"\s", want))
            )
    return F.coalesce(test, F.lit(False))


def _pseudo(name: str, inner: str, scope: Column | None) -> Column:
    from_end = c("siblings") - c("child") + 1
    type_end = c("same_tag") - c("nth") + 1
    if name == "not":
        test = F.lit(False)
        for part in _parts(inner, ","):
            test = test | compound(part, scope)
        return ~test
    if name == "scope":
        # without a scope it is the root of the page
        return c("parent_id").isNull() if scope is None else scope
    fixed = {"first-child": (c("child"), "1"), "last-child": (from_end, "1"), "first-of-type": (c("nth"), "1"), "last-of-type": (type_end, "1")}
    if name in fixed:
        return _position(*fixed[name])
    if name == "only-child":
        return c("siblings") == 1
    if name == "only-of-type":
        return c("same_tag") == 1
    places = {"nth-child": c("child"), "nth-last-child": from_end, "nth-of-type": c("nth"), "nth-last-of-type": type_end}
    if name not in places:
        raise ValueError(f"unsupported pseudo-class: {name!r}")
    return _position(places[name], inner)


_UP_TO_HERE = (Window.unboundedPreceding, -1)


class _Selection:
    """Selectors over one frame of elements, partitioned by page once. Each selector becomes a boolean column."""

    def __init__(self, nodes: DataFrame, selectors: list[str], scoped: bool = False):
        self.parsed = {x: split_selector(x) for x in dict.fromkeys(selectors)}
        tokens = [token for steps in self.parsed.values() for alternative in steps for _, token in alternative]
        # rows that no step names take no part; inside a scope any node may be the scope
        named = F.lit(False)
        for token in dict.fromkeys(tokens):
            named = named | (F.lit(True) if ":scope" in token and scoped else compound(token))
        self.frame = elements(nodes).filter(named).repartition("page_id").withColumn("family", F.coalesce("parent_id", F.lit(-1)))

    def add(self, name: str, selector: str, scope: Column | None = None) -> None:
        """Adds the column ``name``: whether the element matches ``selector``."""
        alternatives = self.parsed[selector]
        states = [f"{name}_{k}" for k in range(len(alternatives))] if len(alternatives) > 1 else [name]
        for state, steps in zip(states, alternatives, strict=True):
            self.frame = self.frame.withColumn(state, compound(steps[0][1], scope))
            for combinator, token in steps[1:]:
                self._step(state, combinator, compound(token, scope))
        if len(states) > 1:
            found = F.lit(False)
            for state in states:
                found = found | c(state)
            self.frame = self.frame.withColumn(name, found)

    def _step(self, state: str, combinator: str, hit: Column) -> None:
        if combinator == " ":
            # intervals are nested or apart: one that began before and ends at or after here is around
            page = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(*_UP_TO_HERE)
            around = F.max(F.when(c(state), c("post"))).over(page) >= c("node_id")
        elif combinator == ">":
            # parents join the family of their children for this step
            roles = F.array(F.struct(F.lit(False).alias("up"), c("family").alias("of")), F.when(c(state), F.struct(F.lit(True).alias("up"), c("node_id").alias("of"))))
            self.frame = self.frame.withColumn("role", F.explode(F.filter(roles, lambda r: r.isNotNull())))
            around = F.max(c("role.up")).over(Window.partitionBy("page_id", "role.of"))
        else:
            family = Window.partitionBy("page_id", "family").orderBy("child").rowsBetween(*_UP_TO_HERE)
            last = F.max(F.when(c(state), c("child"))).over(family)
            around = (last == c("child") - 1) if combinator == "+" else last.isNotNull()
        self.frame = self.frame.withColumn(state, hit & F.coalesce(around, F.lit(False)))
        if combinator == ">":
            self.frame = self.frame.filter(~c("role.up"))


def select(nodes: DataFrame, selector: str, scope: DataFrame | None = None) -> DataFrame:
    """Elements matching a selector, each once. Steps are taken from left to right as windows over the rows of a page that
    some step names, after one exchange by page. ``scope``: (page_id, node_id) that ``:scope`` names.
    """
    here = scope is not None and ":scope" in selector
    made = _Selection(nodes, [selector], here)
    if here:
        marked = scope.select("page_id", "node_id").distinct().withColumn("in_scope", F.lit(True))
        made.frame = made.frame.join(marked, ["page_id", "node_id"], "left").withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))
    made.add("matched", selector, c("in_scope") if here else None)
    return made.frame.filter("matched").select(*nodes.columns)


def first_match(matches: DataFrame, containers: DataFrame | None = None) -> DataFrame:
    """First match in document order per container (strict descendants), or per page. ``containers`` have their ``post``."""
    if containers is None:
        return matches.groupBy("page_id").agg(F.min("node_id").alias("node_id"))
    return enclosed(matches, containers).groupBy("page_id", c("holder").alias("container")).agg(F.min("node_id").alias("node_id"))


def node_values(nodes: DataFrame, pages: DataFrame, picked: DataFrame, mode: str, attribute: str = "") -> DataFrame:
    """(page_id, node_id, value) of picked nodes by mode: text, link_url, image_url or attribute."""
    mode = (mode or "text").lower()
    picked = picked.select("page_id", "node_id").distinct()
    if mode == "text":
        return subtree_texts(nodes, picked).select("page_id", "node_id", c("content").alias("value"))
    name = _attribute(mode, attribute)
    held = nodes.join(picked, ["page_id", "node_id"], "left_semi").select("page_id", "node_id", c("attrs")[name].alias("raw"))
    if mode == "attribute":
        return held.select("page_id", "node_id", F.coalesce("raw", F.lit("")).alias("value"))
    based = held.join(pages.select("page_id", "url"), "page_id")
    full = absolute(c("raw"), c("url"))
    return based.select("page_id", "node_id", F.when(c("raw").isNull(), "").when(full == "", c("raw")).otherwise(full).alias("value"))


def field_names(fields: list[dict]) -> list[str]:
    return [(str(f.get("name") or "").strip() or f"field_{i + 1}") for i, f in enumerate(fields)]


def _attribute(mode: str, attribute: str) -> str:
    return {"link_url": "href", "image_url": "src"}.get(mode, attribute.strip().lower())


def extract_list(pages: DataFrame, container: str, fields: list[dict], nodes: DataFrame | None = None) -> DataFrame:
    """One row per container with one column per field; rows whose fields are all blank are dropped.

    Containers and all fields are matched in one frame. Read backwards, the last match seen before a container is the next
    one behind it; it stands inside the container or no match does.
    """
    if not container.strip():
        raise ValueError("containerSelector is required")
    nodes = stage(node_table(pages), "nodes") if nodes is None else nodes
    names = field_names(fields)
    sought = [str(f.get("relativeSelector") or f.get("selector") or "").strip() for f in fields]
    modes = [str(f.get("extractMode", "text") or "text").lower() for f in fields]
    made = _Selection(nodes, [container, *filter(None, sought)], any(":scope" in x for x in sought))
    made.add("box", container)
    for k, selector in enumerate(sought):
        if selector:
            made.add(f"field{k}", selector, c("box"))
    back = Window.partitionBy("page_id").orderBy(c("node_id").desc()).rowsBetween(*_UP_TO_HERE)
    hits = {}
    for k, selector in enumerate(sought):
        if selector:
            raw = c("attrs")[_attribute(modes[k], fields[k].get("attribute", ""))] if modes[k] != "text" else F.lit(None).cast("string")
            hit = F.struct("node_id", "t0", "t1", raw.alias("raw"))
            hits[f"hit{k}"] = F.last(F.when(c(f"field{k}"), hit), ignorenulls=True).over(back)
    found = made.frame.withColumns(hits) if hits else made.frame
    used = [k for k, selector in enumerate(sought) if selector]
    boxes = found.filter("box").select("page_id", c("node_id").alias("container"), *[F.when(c(f"hit{k}.node_id") <= c("post"), c(f"hit{k}")).alias(f"hit{k}") for k in used])
    if any(modes[k] == "text" for k in used):
        boxes = boxes.join(page_texts(nodes), "page_id", "left")
    if any(modes[k] in ("link_url", "image_url") for k in used):
        boxes = boxes.join(pages.select("page_id", c("url").alias("page_url")), "page_id")
    values = []
    for k, name in enumerate(names):
        if k not in used:
            values.append(F.lit("").alias(name))
            continue
        hit = c(f"hit{k}")
        full = absolute(hit["raw"], c("page_url")) if modes[k] in ("link_url", "image_url") else None
        value = (
            F.when(hit["t1"] > hit["t0"], text_between(c("whole"), hit["t0"], hit["t1"])) if modes[k] == "text"
            else hit["raw"] if full is None
            else F.when(hit["raw"].isNull(), "").when(full == "", hit["raw"]).otherwise(full)
        )
        values.append(F.coalesce(value, F.lit("")).alias(name))
    out = boxes.select("page_id", "container", *values)
    keep = F.lit(False)
    for name in names:
        keep = keep | (F.trim(c(name)) != "")
    return out.filter(keep)


def extract_fields(pages: DataFrame, fields: list[dict], nodes: DataFrame | None = None) -> DataFrame:
    """One row per page: the first match of each field's selector."""
    nodes = stage(node_table(pages), "nodes") if nodes is None else nodes
    out = pages.select("page_id", "url")
    for name, f in zip(field_names(fields), fields):
        selector = str(f.get("selector") or "").strip()
        if not selector:
            out = out.withColumn(name, F.lit(""))
            continue
        first = first_match(select(nodes, selector))
        values = node_values(nodes, pages, first, f.get("extractMode", "text"), f.get("attribute", ""))
        out = out.join(values.select("page_id", c("value").alias(name)), "page_id", "left").withColumn(name, F.coalesce(c(name), F.lit("")))
    return out


def selected_links(pages: DataFrame, selector: str, cap: int | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(url, link, pos): links of the elements a user selector names, distinct per page, the first ``cap`` if given."""
    nodes = stage(node_table(pages), "nodes") if nodes is None else nodes
    hits = select(nodes, selector).select("page_id", "node_id", c("attrs")["href"].alias("href")).filter("href IS NOT NULL")
    links = hits.join(pages.select("page_id", "url"), "page_id").select("url", "node_id", absolute(c("href"), c("url")).alias("link")).filter("link <> ''")
    first = links.groupBy("url", "link").agg(F.min("node_id").alias("at"))
    listed = F.sort_array(F.collect_list(F.struct("at", "link")))
    ordered = first.groupBy("url").agg((F.slice(listed, 1, max(1, cap)) if cap else listed).alias("l"))
    return ordered.select("url", F.posexplode("l").alias("i", "x")).select("url", c("x.link").alias("link"), (c("i") + 1).cast("long").alias("pos"))


# -- selector writing ---------------------------------------------------------------------------------------


def absolute_selectors(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, node_id, selector) of the wanted nodes: from a node's own id, else its place below body."""
    picked = elements(nodes).join(wanted.select("page_id", "node_id").distinct(), ["page_id", "node_id"], "left_semi").select("page_id", "node_id", "id", F.coalesce("body", F.lit(-1)).alias("top"))
    placed = picked.filter("id = ''")
    below = F.when(F.size("trail") == 0, F.lit("body")).otherwise(F.concat(F.lit("body > "), F.array_join("trail", " > ")))
    escaped = F.regexp_replace("id", r"([^A-Za-z0-9_-])", r"\\$1")
    named = picked.filter("id <> ''").select("page_id", "node_id", F.concat(F.lit("#"), escaped).alias("selector"))
    return places(nodes, placed).select("page_id", "node_id", below.alias("selector")).unionByName(named)


def relative_selector(trail: Column) -> Column:
    """Selector of a node from the steps below an anchor; ':scope' for the anchor itself."""
    return F.when(F.size(trail) <= 0, F.lit(":scope")).otherwise(F.array_join(trail, " > "))


# Attributes that are offered for reading.
HINTED = ["data-id", "data-testid", "aria-label", "title", "alt", "class"]


def attribute_hints() -> Column:
    """What may be read of a node, in order: (mode, attribute)."""
    held = lambda name: c("attrs")[name].isNotNull()
    hint = lambda mode, name="": F.struct(F.lit(mode).alias("mode"), F.lit(name).alias("attribute"))
    offered = [F.when(held("href") | (c("tag") == "a"), hint("link_url")), F.when(held("src") | (c("tag") == "img"), hint("image_url")), *[F.when(held(n), hint("attribute", n)) for n in HINTED]]
    return F.filter(F.array(*offered), lambda h: h.isNotNull())


def generalise(selector: Column) -> Column:
    """A picked selector without its positions."""
    return F.trim(F.regexp_replace(F.regexp_replace(selector, r":nth-of-type\(\d+\)", ""), r"\s{2,}", " "))
