"""Shared fragments of oracle text (regular expressions in the common subset)."""
from pagegrid.functions.contacts import EMAIL_VALID, PHONE_SCAN
from pagegrid.functions.text import ENTITIES, WS

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = PHONE_SCAN
EMAIL_OK = EMAIL_VALID


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sub(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(to)}, 'g')"


def trim_ws(expr: str) -> str:
    return sub(expr, f"^{WS}+|{WS}+$", "")


def clean(expr: str) -> str:
    return f"trim({sub(f'coalesce(CAST({expr} AS VARCHAR), {q('')})', WS + '+', ' ')}, ' ')"


def decode(expr: str) -> str:
    for entity, plain in ENTITIES:
        expr = sub(expr, f"(?i){entity}", plain)
    return expr


def strip(expr: str) -> str:
    for tag in ("script", "style", "noscript"):
        expr = sub(expr, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    expr = sub(expr, r"<[^>]+>", " ")
    return decode(f"trim({sub(expr, WS + '+', ' ')}, ' ')")


def visible(expr: str) -> str:
    return strip(sub(sub(expr, r"(?is)<head\b[^>]*>.*?</head>", " "), r"(?s)<!--.*?-->", " "))


def tag_text(expr: str, tag: str) -> str:
    inner = f"regexp_extract({expr}, {q(rf'(?is)<{tag}\b[^>]*>(.*?)</{tag}>')}, 1)"
    return decode(f"trim({sub(inner, WS + '+', ' ')}, ' ')")


def count_tag(expr: str, tag: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, {q(rf'(?i)<{tag}\b')})) AS BIGINT)"


def lang(expr: str) -> str:
    pattern = r"""(?i)<html\b[^>]*\blang\s*=\s*["']([^"']+)["']"""
    return f"regexp_extract({expr}, {q(pattern)}, 1)"


def words(expr: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, {q('[^' + WS[1:-1] + ']+')})) AS BIGINT)"


def round2(expr: str, digits: int = 2) -> str:
    scale = f"{10**digits}.0"
    return f"(floor(CAST({expr} AS DOUBLE) * {scale} + 0.5) / CAST({scale} AS DOUBLE))"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return round2(f"(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0)) * 100", digits)


def path_encoded(expr: str) -> str:
    bad = r"""[^!-~]|["<>`{}^]"""
    return (
        f"array_to_string(list_transform(string_split({expr}, ''), lambda ch: CASE WHEN regexp_matches(ch, {q(bad)}) "
        f"THEN replace(url_encode(ch), '+', '%20') ELSE ch END), '')"
    )


URL_HTTP = r"(?i)^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def url_part(expr: str, group: int) -> str:
    return f"regexp_extract({expr}, {q(URL_HTTP)}, {group})"


def url_host(expr: str) -> str:
    return f"lower(regexp_extract({url_part(expr, 2)}, '^([^:]*)', 1))"


def url_path(expr: str) -> str:
    return f"coalesce(nullif({path_encoded(url_part(expr, 3))}, ''), '/')"


def url_full(expr: str, fragment: bool = True) -> str:
    tail = f" || {path_encoded(url_part(expr, 5))}" if fragment else ""
    return (
        f"(lower({url_part(expr, 1)}) || '://' || lower({url_part(expr, 2)}) || {url_path(expr)} || "
        f"{path_encoded(url_part(expr, 4))}{tail})"
    )


def absolute(href: str, base: str) -> str:
    """Resolve the link kinds of the stored pages: absolute, root-relative, query, fragment, plain relative."""
    origin = f"lower({url_part(base, 1)}) || '://' || lower({url_part(base, 2)})"
    no_frag = url_full(base, fragment=False)
    full = (
        f"CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href} WHEN {href} = '' THEN {no_frag} "
        f"WHEN starts_with({href}, '//') THEN lower({url_part(base, 1)}) || ':' || {href} "
        f"WHEN starts_with({href}, '/') THEN {origin} || {href} WHEN starts_with({href}, '#') THEN {no_frag} || {href} "
        f"WHEN starts_with({href}, '?') THEN {origin} || {url_path(base)} || {href} "
        f"ELSE {origin} || regexp_extract({url_path(base)}, '^(.*/)', 1) || {href} END"
    )
    return f"CASE WHEN regexp_matches({full}, {q(URL_HTTP)}) THEN {url_full(f'({full})')} ELSE '' END"


def emails(expr: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({expr}, {q(EMAIL)}), lambda m: lower(m)), lambda e: regexp_matches(e, {q(EMAIL_OK)}))"


def phones(expr: str) -> str:
    one = f"trim(regexp_replace(m, {q(WS + '+')}, ' ', 'g'), ' ')"
    found = f"list_filter(list_transform(regexp_extract_all({expr}, {q(PHONE)}), lambda m: {one}), lambda x: x <> '')"
    return f"list_filter({found}, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 7)"


def first_of_each(expr: str) -> str:
    """Distinct items of a list, first occurrence first."""
    return (
        f"list_transform(list_filter(list_transform({expr}, lambda v, i: struct_pack(v := v, first := list_position({expr}, v) = i)), "
        f"lambda p: p.first), lambda p: p.v)"
    )
