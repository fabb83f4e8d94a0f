"""Small numeric and collection expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_half_up(c: Column, digits: int = 2) -> Column:
    scale = float(10**digits)
    return F.floor(c.cast("double") * scale + 0.5) / scale


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Rounded share in percent; null when the whole is zero."""
    return round_half_up(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits)


def clamp_int(c: Column, low: int, high: int, fallback: int) -> Column:
    """Floor and bound a loose number; non-numbers read as the fallback."""
    n = c.cast("string").try_cast("double")
    bad = n.isNull() | F.isnan(n) | n.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(fallback)).otherwise(F.least(F.greatest(F.floor(n), F.lit(low)), F.lit(high))).cast("long")


def distinct_texts(items: Column, lower: bool = False) -> Column:
    """Trim, drop blanks, keep first occurrences."""
    from pagegrid.functions.text import trim_ws

    done = F.filter(F.transform(items, trim_ws), lambda x: x != "")
    return F.array_distinct(F.transform(done, F.lower) if lower else done)


def drop_key(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def rename_key(m: Column, source: str, target: str) -> Column:
    """Move a map entry to another name, replacing an entry already there."""
    kept = F.map_filter(m, lambda k, _: ~k.isin(source, target))
    moved = F.map_concat(kept, F.create_map(F.lit(target), F.element_at(m, F.lit(source))))
    return F.when(F.map_contains_key(m, F.lit(source)) & F.lit(source != target), moved).otherwise(m)
