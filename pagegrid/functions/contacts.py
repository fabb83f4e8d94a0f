"""E-mail and phone extraction expressions."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from pagegrid.functions.text import WS_CHARS, clean_text, to_text, trim_ws

_LOCAL = "[A-Za-z0-9._%+-]"
# possessive local part, and no restart inside a run already tried: linear on long unbroken text
EMAIL_SCAN = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}"
EMAIL_VALID = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
PHONE_SCAN = rf"(?:\+?\d[\d{WS_CHARS}().-]{{6,}}\d)"


def email_matches(text: Column) -> Column:
    return F.regexp_extract_all(to_text(text), F.lit(EMAIL_SCAN), F.lit(0))


def normalise_email(c: Column, lower: bool = True, validate: bool = True, domains: list[str] | None = None) -> Column:
    """Clean one candidate; '' when it is rejected. Domain filters are suffix tests."""
    e = F.regexp_replace(trim_ws(to_text(c)), "(?i)^mailto:", "")
    e = trim_ws(F.regexp_replace(e, r"[<>()\[\]{};,]+$", ""))
    if lower:
        e = F.lower(e)
    ok = e != ""
    if validate:
        ok = ok & e.rlike(EMAIL_VALID)
    if domains:
        domain = F.split_part(e, F.lit("@"), F.lit(2))
        allowed = F.lit(False)
        for suffix in domains:
            allowed = allowed | domain.endswith(suffix.lower())
        ok = ok & allowed
    return F.when(ok, e).otherwise("")


def emails(text: Column, mailto: Column | None = None, distinct: bool = True, **options) -> Column:
    """Array of addresses in text, then those of mailto links, first occurrence first."""
    found = email_matches(text)
    if mailto is not None:
        found = F.concat(found, mailto)
    found = F.filter(F.transform(found, lambda m: normalise_email(m, **options)), lambda e: e != "")
    return F.array_distinct(found) if distinct else found


def mailto_links(html: Column) -> Column:
    return F.regexp_extract_all(to_text(html), F.lit(r"""(?i)<a\b[^>]*\bhref\s*=\s*["'](mailto:[^"']*)["']"""), F.lit(1))


def email_domains(addresses: Column) -> Column:
    parts = F.transform(addresses, lambda e: F.split_part(e, F.lit("@"), F.lit(2)))
    return F.array_distinct(F.filter(parts, lambda d: d != ""))


def usable_patterns(patterns: list[str]) -> list[str]:
    """User patterns that compile; broken ones are skipped."""
    good = []
    for p in patterns:
        p = (p or "").strip()
        if not p:
            continue
        try:
            re.compile(p)
        except re.error:
            continue
        good.append(p)
    return good


def phones(text: Column, patterns: list[str] | None = None, validate: bool = True, distinct: bool = True) -> Column:
    found = F.regexp_extract_all(to_text(text), F.lit(PHONE_SCAN), F.lit(0))
    for p in usable_patterns(patterns or []):
        found = F.concat(found, F.regexp_extract_all(to_text(text), F.lit(p), F.lit(0)))
    found = F.filter(F.transform(found, clean_text), lambda x: x != "")
    if validate:
        found = F.filter(found, lambda x: F.length(F.regexp_replace(x, r"\D", "")) >= 7)
    return F.array_distinct(found) if distinct else found


def signal_counts(text: Column) -> tuple[Column, Column]:
    """(distinct e-mails, distinct phones of length >= 7): the looser rule of page metadata."""
    mails = F.array_distinct(F.transform(email_matches(text), lambda e: F.lower(clean_text(e))))
    raw = F.regexp_extract_all(to_text(text), F.lit(PHONE_SCAN), F.lit(0))
    numbers = F.array_distinct(F.filter(F.transform(raw, clean_text), lambda p: F.length(p) >= 7))
    return F.size(mails).cast("long"), F.size(numbers).cast("long")
