"""Page monitors: snapshots, hashes, history and field diffs."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pagegrid.functions.jsonx import flatten_paths
from pagegrid.functions.text import to_text, trim_ws
from pagegrid.plans.ordered import running

c = F.col
KEYS = ["account_id", "monitor_key"]
KEY_PATTERN = "^[a-zA-Z0-9._:-]{3,120}$"

# Switch -> the snapshot fields it controls, with the column each is read from.
SNAPSHOT_FIELDS = {
    "includeFinalUrl": {"finalUrl": "final_url"},
    "includeStatusCode": {"statusCode": "status_code"},
    "includeContentType": {"contentType": "content_type"},
    "includeTitle": {"title": "title"},
    "includeMetaDescription": {"metaDescription": "meta_description"},
    "includeCanonical": {"canonicalUrl": "canonical_url"},
    "includeWordCount": {"wordCount": "word_count", "charCount": "char_count"},
    "includeHeadings": {"headingCounts": ""},
    "includeLinks": {"linkCount": "link_count"},
    "includeLang": {"lang": "lang"},
}


def monitor_key(explicit: Column, url: Column) -> Column:
    """Given key in lower case, null when it is malformed, else one made from the url."""
    key = trim_ws(to_text(explicit))
    made = F.concat(F.lit("url."), F.left(F.sha2(to_text(url), 256), F.lit(24)))
    return F.when(key == "", made).when(key.rlike(KEY_PATTERN), F.lower(key))


def snapshot_json(df: DataFrame, switches: dict[str, bool] | None = None) -> Column:
    """Canonical JSON of the compared fields of a page summary row (keys in order).

    Columns a frame lacks are left out, so a switch turned off later reads as a change.
    """
    on = {k: True for k in SNAPSHOT_FIELDS} | (switches or {})
    cols: dict[str, Column] = {"targetUrl": to_text(c("target_url"))}
    for switch, fields in SNAPSHOT_FIELDS.items():
        if not on[switch]:
            continue
        for name, source in fields.items():
            if name == "headingCounts":
                if {"h1_count", "h2_count", "h3_count"} <= set(df.columns):
                    cols[name] = F.struct(c("h1_count").alias("h1"), c("h2_count").alias("h2"), c("h3_count").alias("h3"))
            elif source in df.columns:
                numeric = name in ("statusCode", "wordCount", "charCount", "linkCount")
                cols[name] = F.coalesce(c(source).cast("long"), F.lit(0)) if numeric else to_text(c(source))
    return F.to_json(F.struct(*[cols[k].alias(k) for k in sorted(cols)]))


def snapshot_hash(snapshot: Column) -> Column:
    return F.sha2(snapshot, 256)


def history(runs: DataFrame) -> DataFrame:
    """Each run of (account_id, monitor_key, run_at, run_id, snapshot_hash) with counters up to it.

    The first run is never a change. Both passes are sliced, so one busy monitor spreads over tasks.
    """
    order = ["run_at", "run_id"]
    compared = running(runs, KEYS, order, lags={"previous_hash": "snapshot_hash"})
    flagged = compared.withColumn("first_run", c("previous_hash").isNull()).withColumn("changed", F.coalesce(c("previous_hash") != c("snapshot_hash"), F.lit(False)))
    return running(
        flagged, KEYS, order, sums={"change_count": c("changed").cast("long")}, last_known={"last_change_at": F.when(c("changed"), c("run_at"))}, number="run_count"
    )


def upsert_state(state: DataFrame, batch: DataFrame) -> DataFrame:
    """New monitor state from stored state and a batch of runs (several runs per monitor allowed).

    State columns: keys, target_url, snapshot_hash, snapshot, run_count, change_count, first_seen_at,
    last_seen_at, last_change_at.
    """
    seed = state.select(*KEYS, F.lit(-1).cast("long").alias("run_id"), c("last_seen_at").alias("run_at"), "target_url", "snapshot_hash", "snapshot")
    runs = batch.select(*KEYS, c("run_id").cast("long").alias("run_id"), "run_at", "target_url", "snapshot_hash", "snapshot")
    touched = seed.join(batch.select(*KEYS).distinct(), KEYS, "left_semi").unionByName(runs)
    compared = running(touched, KEYS, ["run_at", "run_id"], lags={"previous_hash": "snapshot_hash"})
    new = compared.filter("run_id >= 0").groupBy(*KEYS).agg(
        F.max_by(F.struct("target_url", "snapshot_hash", "snapshot"), F.struct("run_at", "run_id")).alias("l"),
        F.count(F.lit(1)).alias("runs"), F.count_if(c("previous_hash") != c("snapshot_hash")).alias("changes"),
        F.min("run_at").alias("first_at"), F.max("run_at").alias("last_at"),
        F.max(F.when(c("previous_hash") != c("snapshot_hash"), c("run_at"))).alias("change_at"),
    )
    j = state.join(new, KEYS, "full_outer")
    fresh = c("runs").isNotNull()
    return j.select(
        *KEYS,
        *[F.when(fresh, c(f"l.{n}")).otherwise(c(n)).alias(n) for n in ("target_url", "snapshot_hash", "snapshot")],
        (F.coalesce("run_count", F.lit(0)) + F.coalesce("runs", F.lit(0))).alias("run_count"),
        (F.coalesce("change_count", F.lit(0)) + F.coalesce("changes", F.lit(0))).alias("change_count"),
        F.coalesce("first_seen_at", "first_at").alias("first_seen_at"), F.coalesce("last_at", "last_seen_at").alias("last_seen_at"),
        F.coalesce("change_at", "last_change_at").alias("last_change_at"),
    )


def clip(value: Column, size: int | None = None) -> Column:
    """Cut text values of a diff that are longer than ``size``; none: whole."""
    if size is None:
        return value
    return F.when(F.char_length(value) > size, F.concat(F.left(value, F.lit(size)), F.lit("..."))).otherwise(value)


def fields_of(df: DataFrame, keys: Sequence[str], snapshot: str) -> DataFrame:
    """(keys, field, value): snapshot leaves; texts unquoted, other values as JSON."""
    flat = flatten_paths(df.select(*keys, F.parse_json(snapshot).alias("v")), "v", list(keys))
    text = F.try_variant_get("value", "$", "string")
    is_text = F.schema_of_variant("value") == "STRING"
    return flat.select(*keys, c("path").alias("field"), F.when(is_text, text).otherwise(F.coalesce(F.to_json("value"), F.lit("null"))).alias("value"))


def field_diff(current: DataFrame, previous: DataFrame, keys: Sequence[str], changed_only: bool = True, clip_at: int | None = None) -> DataFrame:
    """Field changes between two snapshots per key: one-sided fields read null.

    A full outer join on (keys, field); monitors without a previous snapshot are a first run and
    give no rows.
    """
    known = previous.select(*keys).distinct()
    now = fields_of(current.join(known, list(keys), "left_semi"), keys, "snapshot").withColumnRenamed("value", "current")
    old = fields_of(previous, keys, "snapshot").withColumnRenamed("value", "previous")
    j = now.join(old, [*keys, "field"], "full_outer")
    if changed_only:
        j = j.filter(~c("current").eqNullSafe(c("previous")))
    return j.select(*keys, "field", clip(c("previous"), clip_at).alias("previous"), clip(c("current"), clip_at).alias("current"))


def diff_lists(diff: DataFrame, keys: Sequence[str], keep: int | None = None) -> DataFrame:
    """Changes per key in field order (all, or the first ``keep``), with the full count; a snapshot bounds them."""
    changes = F.sort_array(F.collect_list(F.struct("field", "previous", "current")))
    return diff.groupBy(*keys).agg(F.count(F.lit(1)).alias("diff_count"), (changes if keep is None else F.slice(changes, 1, keep)).alias("diff"))
