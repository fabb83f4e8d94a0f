"""Text and raw-HTML column expressions. All of them stay in the JVM."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the characters script engines count as white space (ASCII class plus NBSP and friends).
WS_CHARS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{WS_CHARS}]"

# Entities decoded, in the order they are decoded.
ENTITIES = [
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
]


def to_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def clean_text(c: Column) -> Column:
    """Null to empty, white-space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(to_text(c), f"{WS}+", " "))


def is_blank(c: Column) -> Column:
    return ~to_text(c).rlike(f"[^{WS_CHARS}]")


def field_slug(c: Column, fallback: Column | str) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(to_text(c)), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(fallback) if isinstance(fallback, str) else fallback)


def decode_entities(c: Column) -> Column:
    for entity, plain in ENTITIES:
        c = F.regexp_replace(c, f"(?i){entity}", plain)
    return c


def strip_html(html: Column) -> Column:
    """Drop script/style/noscript bodies, tags to spaces, collapse, trim, decode last."""
    c = to_text(html)
    for tag in ("script", "style", "noscript"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    return decode_entities(F.trim(F.regexp_replace(c, f"{WS}+", " ")))


def visible_text(html: Column) -> Column:
    """Static stand-in for rendered body text: head, comments and script-like bodies removed first."""
    c = F.regexp_replace(to_text(html), r"(?is)<head\b[^>]*>.*?</head>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    return strip_html(c)


def tag_inner(html: Column, tag: str) -> Column:
    """Raw inner markup of the first ``tag`` element, '' when absent."""
    return F.regexp_extract(to_text(html), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)


def tag_text(html: Column, tag: str) -> Column:
    return decode_entities(F.trim(F.regexp_replace(tag_inner(html, tag), f"{WS}+", " ")))


def count_tag(html: Column, tag: str) -> Column:
    return F.regexp_count(to_text(html), F.lit(rf"(?i)<{tag}\b")).cast("long")


def _quote_key(key: str) -> str:
    return "".join("\\" + ch if ch in ".*+?^${}()|[]\\" else ch for ch in key)


def meta_content(html: Column, key: str, by: str = "name") -> Column:
    """Content of a meta tag, attributes in either order; the value ends at the first quote of any kind."""
    k = _quote_key(key)
    forward = rf"""(?i)<meta\b[^>]*{by}\s*=\s*["']{k}["'][^>]*content\s*=\s*["']([^"']*)["'][^>]*>"""
    backward = rf"""(?i)<meta\b[^>]*content\s*=\s*["']([^"']*)["'][^>]*{by}\s*=\s*["']{k}["'][^>]*>"""
    h = to_text(html)
    value = F.when(h.rlike(forward), F.regexp_extract(h, forward, 1)).otherwise(F.regexp_extract(h, backward, 1))
    return decode_entities(trim_ws(value))


def canonical_url(html: Column) -> Column:
    forward = r"""(?i)<link\b[^>]*rel\s*=\s*["']canonical["'][^>]*href\s*=\s*["']([^"']*)["'][^>]*>"""
    backward = r"""(?i)<link\b[^>]*href\s*=\s*["']([^"']*)["'][^>]*rel\s*=\s*["']canonical["'][^>]*>"""
    h = to_text(html)
    return trim_ws(F.when(h.rlike(forward), F.regexp_extract(h, forward, 1)).otherwise(F.regexp_extract(h, backward, 1)))


def html_lang(html: Column) -> Column:
    return trim_ws(F.regexp_extract(to_text(html), r"""(?i)<html\b[^>]*\blang\s*=\s*["']([^"']+)["']""", 1))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{WS_CHARS}]+")).cast("long")


def number_in_text(c: Column) -> Column:
    """First number of a text with thousands commas removed; 0 when there is none or it is malformed."""
    digits = F.regexp_replace(F.regexp_extract(clean_text(c), r"([0-9][0-9,.]*)", 1), ",", "")
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def csv_cell(c: Column) -> Column:
    t = to_text(c)
    quoted = F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(t.rlike(r'[",\r\n]'), quoted).otherwise(t)


def tsv_cell(c: Column) -> Column:
    return F.regexp_replace(to_text(c), r"\r?\n|\t", " ")
