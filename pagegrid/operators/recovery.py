"""Failure reports, retry and resume lists of extraction runs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagegrid.functions.numbers import distinct_texts
from pagegrid.functions.text import to_text, trim_ws

c = F.col
_DEFAULT = "Extraction failed"


def _given(options: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(trim_ws(to_text(options[n])), F.lit("")) for n in names])


def failure_entries(runs: DataFrame) -> DataFrame:
    """(run_id, pos, url, error, code, attempts) of run summaries.

    ``runs``: run_id, failures array<struct<url,error,code,attempts>>, failed_urls array<string>. Detailed
    failures win; without any, the failed urls get the default message.
    """
    detailed = F.transform(
        F.filter(F.coalesce("failures", F.array().cast(runs.schema["failures"].dataType)), lambda f: trim_ws(to_text(f["url"])) != ""),
        lambda f: F.struct(
            trim_ws(to_text(f["url"])).alias("url"), F.coalesce(_given(f, "error"), F.lit(_DEFAULT)).alias("error"), trim_ws(to_text(f["code"])).alias("code"),
            F.nullif(f["attempts"].cast("int"), F.lit(0)).alias("attempts"),
        ),
    )
    plain = F.transform(
        distinct_texts(F.coalesce("failed_urls", F.array().cast("array<string>"))),
        lambda u: F.struct(u.alias("url"), F.lit(_DEFAULT).alias("error"), F.lit("").alias("code"), F.lit(None).cast("int").alias("attempts")),
    )
    return runs.select("run_id", F.posexplode(F.when(F.size(detailed) > 0, detailed).otherwise(plain)).alias("pos", "e")).select("run_id", "pos", "e.*")


def retry_urls(runs: DataFrame) -> DataFrame:
    return failure_entries(runs).groupBy("run_id", "url").agg(F.min("pos").alias("pos"))


def resume_urls(runs: DataFrame) -> DataFrame:
    """Where a run goes on: unresolved urls, else remaining ones, else the failed ones.

    Adds ``unresolved_urls`` and ``remaining_urls`` (array<string>, null when absent) to the run columns.
    """
    pending = distinct_texts(F.coalesce("unresolved_urls", "remaining_urls", F.array().cast("array<string>")))
    held = runs.withColumn("__pending", pending)
    first = held.filter(F.size("__pending") > 0).select("run_id", F.posexplode("__pending").alias("pos", "url"))
    rest = retry_urls(held.filter(F.size("__pending") == 0).drop("__pending"))
    return first.select("run_id", "url", "pos").unionByName(rest.select("run_id", "url", "pos"))
