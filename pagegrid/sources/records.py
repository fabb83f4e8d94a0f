"""Small record builders: audit events, run summaries, notification bodies."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

c = F.col


def audit_rows(df: DataFrame, id_: str, account: str | None, user: str | None, event_type: Column, data: Sequence[str]) -> DataFrame:
    """Append-only audit rows with the chosen columns as JSON data; account and user may be null."""
    null = F.lit(None).cast("string")
    return df.select(
        c(id_).alias("id"),
        (c(account) if account else null).alias("account_id"),
        (c(user) if user else null).alias("user_id"),
        event_type.alias("event_type"),
        F.to_json(F.struct(*data)).alias("event_data"),
    )


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def run_summary(fetched: DataFrame, matched: DataFrame, groups: DataFrame, filters: dict[str, object], generated_at: str) -> DataFrame:
    """One row describing a run; written through the commit protocol, so readers never see half a file."""
    counts = None
    for name, frame in (("fetched", fetched), ("matched", matched), ("duplicate_groups", groups)):
        one = frame.agg(F.count(F.lit(1)).alias("n")).withColumn("measure", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    out = counts.agg(*[F.sum(F.when(c("measure") == m, c("n"))).alias(m) for m in ("fetched", "matched", "duplicate_groups")])
    fixed = [F.lit(v if v not in ("", 0) else None).cast("string").alias(k) for k, v in sorted(filters.items())]
    return out.select(F.lit(generated_at).alias("generated_at"), "*", F.to_json(F.struct(*fixed), {"ignoreNullFields": "false"}).alias("filters"))


def notification_bodies(changes: DataFrame, webhooks: DataFrame, default_event: str = "monitor.page.changed", keep: int | None = None) -> DataFrame:
    """Outbox rows for changed monitors that have a webhook.

    ``changes``: (account_id, monitor_key, target_url, previous_hash, snapshot_hash, changed, diff_count, diff array).
    ``webhooks``: (account_id, monitor_key, webhook_url, event_type, metadata map, body map). Fields of the
    user's metadata, then body, win over the built ones.
    """
    joined = changes.filter("changed").join(webhooks, ["account_id", "monitor_key"])
    built = F.create_map(
        F.lit("source"), F.lit("monitor.page.diff"),
        F.lit("monitorKey"), c("monitor_key"),
        F.lit("monitoredUrl"), c("target_url"),
        F.lit("diffCount"), c("diff_count").cast("string"),
        F.lit("previousSnapshotHash"), c("previous_hash"),
        F.lit("snapshotHash"), c("snapshot_hash"),
        F.lit("changes"), F.to_json(c("diff") if keep is None else F.slice("diff", 1, keep)),
    )

    def over(base: Column, extra: Column) -> Column:
        extra = F.coalesce(extra, F.create_map().cast("map<string,string>"))
        return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(extra, k)), extra)

    merged = over(over(built, c("metadata")), c("body"))
    event = F.trim(F.coalesce("event_type", F.lit("")))
    return joined.select("account_id", "monitor_key", "webhook_url", F.when(event == "", default_event).otherwise(event).alias("event_type"), merged.alias("metadata"))
