"""URL column expressions following the web URL standard closely enough for stored pages.

Written as native expressions (regex parts, array folds); no Python runs per row.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagegrid.functions.text import to_text, trim_ws

_HTTP = r"(?i)^(https?):/*([^/?#\\]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_HOST = r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$"
_UNSAFE = r"""[^!-~]|["<>`{}^]"""


def _percent_encode(part: Column) -> Column:
    encoded = F.concat_ws(
        "",
        F.transform(
            F.split(part, ""),
            lambda ch: F.when(ch.rlike(_UNSAFE), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))).otherwise(ch),
        ),
    )
    return F.when(part.rlike(_UNSAFE), encoded).otherwise(part)


def _resolve_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/", -1)
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.concat_ws("/", folded)
    trailing = path.rlike(r"/\.\.?$") & ~joined.endswith("/")
    joined = F.when(trailing, F.concat(joined, F.lit("/"))).otherwise(joined)
    joined = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), joined).otherwise(path)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body`` without repeating its expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parts(url: Column) -> Column:
    """Struct (scheme, host, port, path, query, fragment) of an http(s) URL; null when it does not parse.

    Scheme and host are lower case, default ports dropped, path percent-encoded with dot segments
    resolved. ``query`` keeps its '?', ``fragment`` its '#'.
    """

    def split_up(raw: Column) -> Column:
        authority = F.regexp_extract(raw, _HTTP, 2)
        return F.struct(
            raw.rlike(_HTTP).alias("matched"),
            F.lower(F.regexp_extract(raw, _HTTP, 1)).alias("scheme"),
            authority.rlike(_HOST).alias("authority_ok"),
            F.regexp_extract(authority, r"^([^@]*@)", 1).alias("userinfo"),
            F.lower(F.regexp_extract(authority, _HOST, 1)).alias("host"),
            F.regexp_extract(authority, _HOST, 2).alias("port"),
            F.replace(F.regexp_extract(raw, _HTTP, 3), F.lit("\\"), F.lit("/")).alias("path"),
            F.regexp_extract(raw, _HTTP, 4).alias("query"),
            F.regexp_extract(raw, _HTTP, 5).alias("fragment"),
        )

    def assemble(g: Column) -> Column:
        default = ((g["scheme"] == "http") & (g["port"] == "80")) | ((g["scheme"] == "https") & (g["port"] == "443"))
        ok = g["matched"] & g["authority_ok"] & (g["host"] != "") & ~g["host"].rlike(r"""[\s"<>\\^`{|}%]""")
        ok = ok & ((g["port"] == "") | (F.coalesce(g["port"].try_cast("int"), F.lit(99999)) <= 65535))
        path = let(_percent_encode(g["path"]), _resolve_dots)
        return F.when(
            ok,
            F.struct(
                g["scheme"].alias("scheme"),
                g["userinfo"].alias("userinfo"),
                g["host"].alias("host"),
                F.when(default, F.lit("")).otherwise(g["port"]).alias("port"),
                F.when(g["path"] == "", F.lit("/")).otherwise(path).alias("path"),
                _percent_encode(g["query"]).alias("query"),
                _percent_encode(g["fragment"]).alias("fragment"),
            ),
        )

    return let(trim_ws(to_text(url)), lambda raw: let(split_up(raw), assemble))


def origin(p: Column) -> Column:
    return F.concat(p["scheme"], F.lit("://"), p["host"], F.when(p["port"] == "", F.lit("")).otherwise(F.concat(F.lit(":"), p["port"])))


def serialise(p: Column, fragment: bool = True) -> Column:
    query = F.when(p["query"] == "?", F.lit("?")).otherwise(p["query"])
    port = F.when(p["port"] == "", F.lit("")).otherwise(F.concat(F.lit(":"), p["port"]))
    base = F.concat(p["scheme"], F.lit("://"), p["userinfo"], p["host"], port, p["path"], query)
    return F.concat(base, p["fragment"]) if fragment else base


def is_http(url: Column) -> Column:
    return parts(url).isNotNull()


def absolute(value: Column, base: Column) -> Column:
    """Resolve ``value`` against the page URL; '' unless the result is http(s)."""
    return let(parts(base), lambda b: resolve_on(value, b))


def resolve_on(value: Column, b: Column) -> Column:
    """As ``absolute`` with the base already split, so a page's base is parsed once for all its links."""

    def full(v: Column) -> Column:
        return (
            F.when(v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), v)
            .when(b.isNull(), F.lit(None).cast("string"))
            .when(v == "", serialise(b, fragment=False))
            .when(v.rlike(r"^[/\\]{2}"), F.concat(b["scheme"], F.lit(":"), v))
            .when(v.rlike(r"^[/\\]"), F.concat(origin(b), v))
            .when(v.startswith("?"), F.concat(origin(b), b["path"], v))
            .when(v.startswith("#"), F.concat(serialise(b, fragment=False), v))
            .otherwise(F.concat(origin(b), F.regexp_extract(b["path"], r"^(.*/)", 1), v))
        )

    joined = let(trim_ws(to_text(value)), full)
    return F.coalesce(let(parts(joined), lambda p: serialise(p)), F.lit(""))


def signature(url: Column) -> Column:
    """Page identity for cycle checks: fragment and trailing slashes dropped; unparsable text kept."""
    raw = trim_ws(to_text(url))
    return F.regexp_replace(F.coalesce(let(parts(raw), lambda p: serialise(p, fragment=False)), raw), "/+$", "")


def target_signature(url: Column) -> Column:
    """Lower scheme and host, keep port, path and query, drop the fragment; unparsable text lower-cased."""
    raw = trim_ws(to_text(url))
    text = let(parts(raw), lambda p: F.concat(origin(p), p["path"], F.when(p["query"] == "?", F.lit("")).otherwise(p["query"])))
    return F.coalesce(text, F.lower(raw))


def host_key(url: Column) -> Column:
    """Host without ``www.`` and trailing dots; '' when the URL or host is not usable."""
    host = F.regexp_replace(F.regexp_replace(parts(url)["host"], r"^www\.", ""), r"\.+$", "")
    return F.when(host.rlike("^[a-z0-9.-]+$"), host).otherwise("")


# Search engines recognised in a host name.
SEARCH_HOSTS = ["google.", "bing.com", "duckduckgo.com", "yahoo.", "yandex."]


def is_search_host(host: Column) -> Column:
    h = F.lower(trim_ws(to_text(host)))
    found = F.lit(False)
    for token in SEARCH_HOSTS:
        found = found | h.contains(token)
    return found


def is_search_results(url: Column) -> Column:
    def judge(p: Column) -> Column:
        host, path = p["host"], F.lower(p["path"])
        has_query = p["query"].rlike(r"[?&](q|query|keyword)(=|&|$)")
        return (
            (host.contains("google.") & path.startswith("/search"))
            | (host.contains("bing.com") & path.contains("/search"))
            | host.contains("duckduckgo.com")
            | (host.contains("yahoo.") & path.contains("/search"))
            | host.contains("yandex.")
            | (has_query & (path.contains("/search") | (path == "/") | path.startswith("/results")))
        )

    return F.coalesce(let(parts(url), judge), F.lit(False))


def harvestable(url: Column) -> Column:
    """Normalised http(s) URL outside the search engines, or ''."""
    return let(parts(url), lambda p: F.when(p.isNotNull() & ~is_search_host(p["host"]), serialise(p)).otherwise(""))


def is_private_ipv4(host: Column) -> Column:
    octets = F.transform(F.split(host, r"\.", -1), lambda s: F.when(s.rlike("^[0-9]{1,3}$"), s.cast("int")))
    valid = (F.size(octets) == 4) & F.forall(octets, lambda o: o.isNotNull() & (o <= 255))
    a, b = F.get(octets, F.lit(0)), F.get(octets, F.lit(1))
    private = (
        a.isin(10, 127, 0)
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 100) & b.between(64, 127))
        | ((a == 198) & b.isin(18, 19))
    )
    return F.coalesce(valid & private, F.lit(False))


def is_blocked_host(host: Column, block_local: bool = False) -> Column:
    h = F.lower(F.regexp_replace(to_text(host), r"^\[|\]$", ""))
    blocked = (h == "") | h.isin("localhost", "::1") | h.endswith(".localhost") | h.endswith(".internal") | is_private_ipv4(h)
    return blocked | h.endswith(".local") if block_local else blocked


def public_target(url: Column, code: str, block_local: bool = False) -> Column:
    """Struct (ok, code, url): guard against private targets, one code per reason."""

    def judge(p: Column) -> Column:
        reason = F.when(p.isNull(), F.lit(code)).when(is_blocked_host(p["host"], block_local), F.lit("BLOCKED_TARGET_HOST"))
        return F.struct(reason.isNull().alias("ok"), reason.alias("code"), F.when(reason.isNull(), serialise(p)).alias("url"))

    return let(parts(url), judge)


def encode_component(c: Column) -> Column:
    """Percent-encode one URL component, leaving the marks script engines leave."""
    out = F.url_encode(c)
    # Characters left alone by component encoding, and the space.
    for coded, plain in [("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")]:
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def drop_query_keys(url: Column, keys: list[str], drop_viewport: bool = False) -> Column:
    """Normalised URL without the named query parameters; null when it does not parse."""

    def rebuild(p: Column) -> Column:
        pairs = F.filter(F.split(F.substring(p["query"], F.lit(2), F.char_length(p["query"])), "&", -1), lambda kv: (kv != "") & ~F.split_part(kv, F.lit("="), F.lit(1)).isin(*keys))
        query = let(F.concat_ws("&", pairs), lambda text: F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))
        if not drop_viewport:
            return F.concat(origin(p), p["path"], query, p["fragment"])
        path = F.regexp_replace(F.regexp_replace(p["path"], r"/@[^/]+$", ""), "/+$", "")
        return F.concat(origin(p), path, query)

    return let(parts(url), rebuild)


def query_value(url: Column, key: str) -> Column:
    """Decoded value of the first query parameter of that name, '' when absent."""
    raw = F.regexp_extract(F.coalesce(parts(url)["query"], F.lit("")), rf"[?&]{key}=([^&]*)", 1)
    return F.coalesce(F.try_url_decode(raw), raw)
