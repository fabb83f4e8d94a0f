"""URL lists: parsing, harvesting and template expansion."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagegrid.functions.text import to_text, trim_ws
from pagegrid.functions.urls import encode_component


def lines(df: DataFrame, text: str) -> DataFrame:
    """One row per non-blank trimmed line with its 1-based position; repeats are kept."""
    kept = F.filter(F.transform(F.split(to_text(F.col(text)), r"\r\n|\r|\n", -1), trim_ws), lambda x: x != "")
    return df.select(*df.drop(text).columns, F.posexplode(kept).alias("i", "value")).withColumn("line_no", F.col("i").cast("long") + 1).drop("i")


def seeds(df: DataFrame, text: str) -> DataFrame:
    """Seeds separated by commas or newlines, deduplicated within each text."""
    kept = F.array_distinct(F.filter(F.transform(F.split(to_text(F.col(text)), r"[\r\n,]+", -1), trim_ws), lambda x: x != ""))
    return df.select(*df.drop(text).columns, F.explode(kept).alias("seed"))


URL_IN_TEXT = r"""https?://[^\s,;"')]+"""


def harvest_urls(df: DataFrame, text: str, position: str) -> DataFrame:
    """Every distinct URL of any text with the smallest position it was seen at."""
    found = df.select(F.col(position).alias("first_seen"), F.explode(F.regexp_extract_all(to_text(F.col(text)), F.lit(URL_IN_TEXT), F.lit(0))).alias("url"))
    return found.groupBy("url").agg(F.min("first_seen").alias("first_seen"))


def expand_range(df: DataFrame, start: Column, end: Column, step: int = 1, padding: int = 0) -> DataFrame:
    """Rows × numbers from start towards end (either direction); ``n_text`` is padded, the sign kept."""
    step = max(1, abs(int(step)))
    pad = max(0, min(12, int(padding)))
    signed = F.when(start <= end, F.lit(step)).otherwise(F.lit(-step))
    numbered = df.withColumn("n", F.explode(F.sequence(start.cast("long"), end.cast("long"), signed.cast("long"))))
    body = F.abs("n").cast("string")
    padded = F.when(F.length(body) >= pad, body).otherwise(F.lpad(body, pad, "0"))
    return numbered.withColumn("n_text", F.concat(F.when(F.col("n") < 0, "-").otherwise(""), padded))


def fill_template(template: str, seed: Column | None = None, number: Column | None = None) -> Column:
    if "{seed}" not in template and "{n}" not in template:
        raise ValueError("template must include {seed} and/or {n}")
    out = F.lit(template)
    if seed is not None:
        out = F.replace(out, F.lit("{seed}"), encode_component(trim_ws(seed)))
    if number is not None:
        out = F.replace(out, F.lit("{n}"), number)
    return out
