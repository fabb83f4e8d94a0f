"""Column profile and cleanup of row tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagegrid.functions.text import is_blank, to_text, trim_ws

# Words that mark a column as holding images.
IMAGE_NAME_TOKENS = ["image", "img", "photo", "thumbnail", "picture", "logo", "icon"]


def image_like_value(c: Column) -> Column:
    v = F.lower(trim_ws(to_text(c)))
    return (
        v.startswith("data:image/")
        | v.rlike(r"\.(png|jpe?g|gif|webp|svg|bmp|avif)(\?|#|$)")
        | v.contains("images/")
        | v.contains("/image/")
        | v.contains("img")
    )


def image_like_name_column(c: Column) -> Column:
    found = F.lit(False)
    for token in IMAGE_NAME_TOKENS:
        found = found | F.lower(trim_ws(to_text(c))).contains(token)
    return found


def image_like_name(name: str) -> bool:
    low = name.strip().lower()
    return any(token in low for token in IMAGE_NAME_TOKENS)


def profile(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """One row per column from one pass over the table.

    Exact distinct counts of several columns in one aggregate would multiply every row by the
    column count, so values are first melted to (column, value) and counted with map-side
    combine: partial sums per distinct value, then per column. The order-safe signature is an
    XOR of hashes of (row id, value), so two columns with equal content in every row agree.
    """
    melted = df.select(
        F.col(row_id).alias("__id"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("column"), trim_ws(to_text(F.col(n))).alias("v")) for i, n in enumerate(columns)])).alias("x"),
    ).select("__id", "x.*")
    per_value = melted.groupBy("pos", "column", "v").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("__id", "v")).alias("sig"), F.bit_xor(F.xxhash64("v", "__id", F.lit(7))).alias("sig2")
    )
    filled = F.col("v") != ""
    stats = per_value.groupBy("pos", "column").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(filled, F.col("n")).otherwise(0)).alias("non_empty"),
        F.sum(F.when(filled, 1).otherwise(0)).alias("distinct_non_empty"),
        F.sum(F.when(filled & image_like_value(F.col("v")), F.col("n")).otherwise(0)).alias("image_like"),
        F.bit_xor("sig").alias("sig"),
        F.bit_xor("sig2").alias("sig2"),
    )
    return stats.select(
        "pos", "column", "row_count", "non_empty", "distinct_non_empty",
        F.coalesce(F.try_divide("non_empty", "row_count"), F.lit(0.0)).alias("density"),
        (F.lit(1.0) - F.coalesce(F.try_divide("non_empty", "row_count"), F.lit(0.0))).alias("empty_ratio"),
        F.coalesce(F.try_divide("image_like", "non_empty"), F.lit(0.0)).alias("image_ratio"),
        "sig", "sig2",
    )


def cleanup_plan(
    df: DataFrame,
    columns: list[str],
    row_id: str,
    empty: bool = False,
    repeating: bool = False,
    mostly_empty: bool = False,
    threshold: float = 0.9,
    images: bool = True,
    duplicates: bool = False,
    by_density: bool = False,
) -> tuple[list[str], dict[str, str]]:
    """(retained columns in order, removed column -> reason). Collects one row per column.

    Columns whose signatures agree are compared value by value before one is dropped.
    """
    threshold = max(0.5, min(0.99, float(threshold)))
    stats = {r["column"]: r for r in profile(df, columns, row_id).collect()}
    removed: dict[str, str] = {}

    def drop(name: str, reason: str) -> None:
        removed.setdefault(name, reason)

    for name in columns:
        r = stats.get(name)
        if r is None:
            continue
        if empty and r["non_empty"] == 0:
            drop(name, "empty")
        if repeating and r["non_empty"] > 0 and r["distinct_non_empty"] <= 1:
            drop(name, "repeating")
        if mostly_empty and r["empty_ratio"] >= threshold:
            drop(name, "mostly_empty")
        if not images and (image_like_name(name) or r["image_ratio"] >= 0.7):
            drop(name, "image")
    if duplicates:
        groups: dict[tuple, list[str]] = {}
        for name in columns:
            if name not in removed and name in stats:
                groups.setdefault((stats[name]["sig"], stats[name]["sig2"]), []).append(name)
        pairs = [(g[0], other) for g in groups.values() for other in g[1:]]
        if pairs:
            checks = [
                F.count_if(~trim_ws(to_text(F.col(a))).eqNullSafe(trim_ws(to_text(F.col(b))))).alias(f"d{i}")
                for i, (a, b) in enumerate(pairs)
            ]
            found = df.agg(*checks).first()
            for i, (_, other) in enumerate(pairs):
                if found[f"d{i}"] == 0:
                    drop(other, "duplicate")
    kept = [n for n in columns if n not in removed]
    if columns and not kept:
        raise ValueError("Cleanup would remove all columns. Adjust cleanup options.")
    if by_density:
        kept.sort(key=lambda n: (-stats[n]["density"], n))
    return kept, removed


def clean_rows(df: DataFrame, kept: list[str], carry: list[str], drop_empty_rows: bool = False) -> DataFrame:
    """Project to the retained columns (plus carried system columns); optionally drop blank rows."""
    out = df.select(*carry, *[k for k in kept if k not in carry])
    if drop_empty_rows:
        blank = F.lit(True)
        for name in kept:
            blank = blank & is_blank(F.col(name))
        out = out.filter(~blank)
    return out
