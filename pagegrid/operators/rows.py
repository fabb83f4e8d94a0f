"""Row tables: scan, search, edit, merge, deduplicate.

Rows are either typed columns or a dynamic ``map<string,string>`` column; both forms share
the same semantics (null reads as empty text, blank means blank after trim).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pagegrid.functions.numbers import rename_key
from pagegrid.functions.text import is_blank, to_text, trim_ws


def as_map(columns: Sequence[str]) -> Column:
    """Typed columns as one dynamic row map."""
    pairs: list[Column] = []
    for name in columns:
        pairs += [F.lit(name), to_text(F.col(name))]
    return F.create_map(*pairs)


def search(values: Sequence[str] | Column, needle: str) -> Column:
    """Case-insensitive substring in any value; a blank needle matches all rows."""
    q = (needle or "").strip().lower()
    if not q:
        return F.lit(True)
    if isinstance(values, Column):
        return F.exists(F.map_values(values), lambda v: F.lower(to_text(v)).contains(q))
    hit = F.lit(False)
    for name in values:
        hit = hit | F.lower(to_text(F.col(name))).contains(q)
    return hit


def column_contains(column: Column | None, needle: str) -> Column:
    q = (needle or "").strip().lower()
    if column is None or not q:
        return F.lit(True)
    return F.lower(to_text(column)).contains(q)


def first_rows(df: DataFrame, order: Sequence[Column], limit: int | None) -> DataFrame:
    """The first ``limit`` rows; all rows, unsorted, where there is no limit."""
    return df.orderBy(*order).limit(max(1, int(limit))) if limit else df


def scan_table(df: DataFrame, table_id: str, limit: int | None = 100) -> DataFrame:
    """Rows of one table, newest first; ties by arrival order. The id filter prunes partitions."""
    out = df.filter(F.col("table_id") == table_id)
    return out.orderBy(F.col("created_at").desc(), F.col("row_seq").asc()).limit(limit) if limit else out


def table_history(tables: DataFrame, runs: DataFrame, limit: int | None = None, brief: bool = False) -> DataFrame:
    """Tables newest first, runner and status falling back to the run when the table has none."""
    top = first_rows(tables, [F.col("created_at").desc(), F.col("table_id").asc()], limit)
    runs = runs.select("automation_id", F.col("runner_type").alias("run_type"), F.col("status").alias("run_status"))
    joined = top.join(runs, "automation_id", "left")
    cols = ["table_id", "automation_id", F.coalesce("runner_type", "run_type").alias("runner_type"), F.coalesce("status", "run_status").alias("status"), "created_at"]
    return joined.select(*cols, F.coalesce("row_count", F.lit(0)).alias("row_count"), *([] if brief else ["updated_at"]))


def content_key(table_id: Column, columns: Sequence[str]) -> Column:
    """Identity of a row: table id and SHA-256 of its canonical content."""
    body = F.to_json(F.struct(*[to_text(F.col(n)).alias(n) for n in sorted(columns)]))
    return F.concat(table_id, F.lit(":"), F.sha2(body, 256))


def insert_if_absent(incoming: DataFrame, stored: DataFrame, key: str, order: str) -> DataFrame:
    """Incoming rows that are neither stored already nor repeated inside the batch.

    First occurrence by ``order`` wins. The batch is reduced with a combinable aggregate
    before the anti join, so a key repeated a billion times shuffles once per task.
    """
    rest = [n for n in incoming.columns if n != key]
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
    return first.join(stored.select(key).distinct(), key, "left_anti").select(*incoming.columns)


def insert_counts(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """One row: inserted, skipped, total."""
    per_key = incoming.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = stored.select(key).distinct().withColumn("known", F.lit(True))
    return per_key.join(known, key, "left").agg(
        F.count_if(F.col("known").isNull()).alias("inserted"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count_if(F.col("known").isNull())).alias("skipped"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    )


def remove_table(df: DataFrame, table_id: str) -> DataFrame:
    return df.filter(~F.col("table_id").eqNullSafe(F.lit(table_id)))


def update_cells(df: DataFrame, edits: DataFrame, data: str = "row_data") -> DataFrame:
    """Set cells of a dynamic map column. Edits: (table_id, row_key, column_name, value, edited_at).

    Several edits of one row are folded into one map first (latest per column wins); the row's
    identity key is not recomputed. Edits naming a row of another table match nothing.
    """
    latest = edits.groupBy("table_id", "row_key", "column_name").agg(F.max_by(to_text(F.col("value")), "edited_at").alias("value"))
    folded = latest.groupBy("table_id", "row_key").agg(F.map_from_entries(F.collect_list(F.struct("column_name", "value"))).alias("patch"))
    joined = df.join(folded, ["table_id", "row_key"], "left")
    kept = F.map_filter(F.col(data), lambda k, _: ~F.map_contains_key(F.col("patch"), k))
    merged = F.when(F.col("patch").isNull(), F.col(data)).otherwise(F.map_concat(kept, F.col("patch")))
    return joined.withColumn(data, merged).drop("patch").select(*df.columns)


def rename_column(df: DataFrame, data: str, source: str, target: str) -> DataFrame:
    """Rename a key of the dynamic row; adds ``renamed`` telling whether the row held it."""
    source, target = source.strip(), target.strip()
    if not source or not target:
        raise ValueError("both column names are required")
    held = F.map_contains_key(F.col(data), F.lit(source)) & F.lit(source != target)
    return df.withColumn("renamed", held).withColumn(data, rename_key(F.col(data), source, target))


def merge_columns(df: DataFrame, sources: Sequence[str], target: str, separator: str = " ", drop_sources: bool = False) -> DataFrame:
    """Join the non-blank trimmed parts into ``target``; adds ``changed`` for rows that really differ."""
    names = list(dict.fromkeys(n.strip() for n in sources if n and n.strip()))
    if len(names) < 2:
        raise ValueError("Select at least two source columns to merge")
    if not target.strip():
        raise ValueError("the merged column needs a name")
    parts = F.filter(F.array(*[trim_ws(to_text(F.col(n))) for n in names]), lambda x: x != "")
    merged = F.array_join(parts, separator)
    if target in df.columns:
        changed = ~to_text(F.col(target)).eqNullSafe(merged)
        changed = changed | F.lit(drop_sources and any(n != target for n in names))
    else:
        changed = F.lit(True)
    out = df.withColumn("changed", changed).withColumn(target, merged)
    return out.drop(*[n for n in names if n != target]) if drop_sources else out


def filtered_read(df: DataFrame, columns: Sequence[str], order: Sequence[Column], limit: int | None = None, needle: str = "", column: str = "", value: str = "") -> DataFrame:
    """Limit first, then filter: the order of the two steps is part of the meaning."""
    limited = first_rows(df, order, limit)
    return limited.filter(search(columns, needle) & column_contains(F.col(column) if column else None, value))


def discover_columns(df: DataFrame, data: Column, position: Column) -> DataFrame:
    """Union of dynamic keys in first-seen order: (name, first_row, first_place)."""
    keys = df.select(position.alias("row"), F.posexplode(F.map_keys(data)).alias("place", "name"))
    seen = keys.groupBy("name").agg(F.min(F.struct("row", "place")).alias("at"))
    return seen.select("name", F.col("at.row").alias("first_row"), F.col("at.place").cast("long").alias("first_place"))


def table_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("table_id").agg(F.count(F.lit(1)).alias("row_count"), F.max("updated_at").alias("last_edited_at"))


def rank_url_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows holding it and distinct URLs in it, for choosing a URL column."""
    from pagegrid.functions.urls import is_http

    melted = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), trim_ws(to_text(F.col(n))).alias("v")) for n in columns])).alias("x")).select("x.*")
    per_value = melted.groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("name").agg(F.sum("n").alias("row_count"), F.count_if(is_http(F.col("v"))).alias("url_count"))


def url_column_values(df: DataFrame, columns: Sequence[str], selected: str = "") -> DataFrame:
    """Distinct URLs of the chosen column, else of the column with most URLs."""
    from pagegrid.functions.urls import is_http

    name = selected.strip()
    if not name:
        best = rank_url_columns(df, columns).filter("url_count > 0").orderBy(F.desc("url_count"), F.desc("row_count"), "name").limit(1).collect()
        if not best:
            return df.select(F.lit("").alias("url")).limit(0)
        name = best[0]["name"]
    return df.select(trim_ws(to_text(F.col(name))).alias("url")).distinct().filter(is_http(F.col("url")))


def dedupe(df: DataFrame, columns: Sequence[str], order: str, keys: Sequence[str] = ()) -> DataFrame:
    """First row (smallest ``order``) of each distinct content; combinable, so hot contents stay cheap."""
    content = F.sha2(F.to_json(F.struct(*[F.col(n) for n in sorted(columns)]), {"ignoreNullFields": "false"}), 256)
    rest = [n for n in df.columns if n not in keys]
    grouped = df.withColumn("__content", content).groupBy(*keys, "__content").agg(F.min_by(F.struct(*rest), order).alias("r"), F.count(F.lit(1)).alias("copies"))
    return grouped.select(*keys, "r.*", "copies").select(*df.columns, "copies")


def drop_blank_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    keep = F.lit(False)
    for name in columns:
        keep = keep | ~is_blank(F.col(name))
    return df.filter(keep)


def schema_difference(expected: Sequence[str], actual: Sequence[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) column names."""
    return [n for n in expected if n not in actual], [n for n in actual if n not in expected]


def enforce_schema(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    missing, extra = schema_difference(list(expected), df.columns)
    notes = ([f"missing: {', '.join(missing)}"] if missing else []) + ([f"extra: {', '.join(extra)}"] if extra else [])
    if notes:
        raise ValueError(f"Template schema lock mismatch ({' | '.join(notes)})")
    return df


def keyset_page(df: DataFrame, limit: int, cursor: tuple | None = None) -> DataFrame:
    """Newest first by (created_at, id), after the cursor; one row more than the limit tells of a next page."""
    if cursor is not None:
        at, last_id = cursor
        if at is None or last_id is None:
            raise ValueError("the cursor needs both a time and an id")
        at = F.lit(at).cast("timestamp")
        df = df.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < last_id)))
    return df.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit + 1)
