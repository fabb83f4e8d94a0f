"""Row-table operators."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from pagegrid.operators import profile as prof
from pagegrid.operators import recovery, rows, seeds
from pagegrid.plans.lineage import scratch_path
from pagegrid.plans.ordered import running
from pagegrid.plans.registry import query
from pagegrid.queries import sqltext as s
from pagegrid.sources import sinks

c = F.col
COLS = ["segment", "seg_lower", "seg_copy", "constant", "sparse", "empty_only", "image_url"]
STORE = ["priority", "status", "item"]


@query(
    "s02_manual_urls",
    f"""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\r\\n|\\r|\\n'), lambda x: {s.trim_ws('x')}), lambda x: x <> '') AS l FROM documents)
      SELECT doc_id, unnest(l) AS value, CAST(generate_subscripts(l, 1) AS BIGINT) AS line_no FROM d""",
)
def _(t):
    return seeds.lines(t.documents.select("doc_id", "text"), "text").select("doc_id", "value", "line_no")


@query(
    "s03_url_harvest",
    f"""WITH f AS (SELECT page_id, unnest(regexp_extract_all(url || ' ' || html, {s.q(seeds.URL_IN_TEXT)})) AS url FROM pages) SELECT url, min(page_id) AS first_seen FROM f GROUP BY url""",
)
def _(t):
    return seeds.harvest_urls(t.pages.select("page_id", F.concat_ws(" ", "url", "html").alias("body")), "body", "page_id")


@query(
    "s04_seed_list",
    f"""SELECT DISTINCT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '[\\r\\n,]+'), lambda x: {s.trim_ws('x')}), lambda x: x <> '')) AS seed FROM documents""",
)
def _(t):
    return seeds.seeds(t.documents.select("doc_id", "text"), "text")


@query("s05_table_scan", "SELECT * FROM v_store WHERE table_id = 't3' ORDER BY created_at DESC, row_seq LIMIT 100")
def _(t):
    return rows.scan_table(t.v_store, "t3", 100)


_HIST = """WITH tb AS (SELECT o_orderkey AS table_id, o_custkey AS automation_id, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderpriority END AS runner_type,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, o_orderdate AS created_at, CAST(o_totalprice AS BIGINT) AS row_count, o_orderdate AS updated_at FROM orders),
  a AS (SELECT c_custkey AS automation_id, c_mktsegment AS run_type, 'completed' AS run_status FROM customer WHERE c_acctbal > 0)
  SELECT table_id, tb.automation_id, coalesce(runner_type, run_type) AS runner_type, coalesce(status, run_status) AS status, created_at, row_count{extra} FROM tb LEFT JOIN a ON a.automation_id = tb.automation_id"""


def _history(t, brief):
    tb = t.orders.select(
        c("o_orderkey").alias("table_id"), c("o_custkey").alias("automation_id"),
        F.when(c("o_orderpriority") != "1-URGENT", c("o_orderpriority")).alias("runner_type"),
        F.when(c("o_orderstatus") != "P", c("o_orderstatus")).alias("status"), c("o_orderdate").alias("created_at"),
        F.rint("o_totalprice").cast("long").alias("row_count"), c("o_orderdate").alias("updated_at"),
    )
    runs = t.customer.filter("c_acctbal > 0").select(c("c_custkey").alias("automation_id"), c("c_mktsegment").alias("runner_type"), F.lit("completed").alias("status"))
    return rows.table_history(tb, runs, brief=brief)


@query("s06_table_history", _HIST.format(extra=", updated_at"))
def _(t):
    return _history(t, False)


@query("s07_data_sources", _HIST.format(extra=""))
def _(t):
    return _history(t, True)


_SPLIT = "created_at < TIMESTAMP '1996-01-01 00:00:00'"


def _incoming(t):
    v = t.v_store.withColumn("row_key", rows.content_key(c("table_id"), STORE))
    return v.filter(f"NOT ({_SPLIT})"), v.filter(_SPLIT)


@query(
    "s08_insert_if_absent",
    f"""WITH inc AS (SELECT table_id, priority, status, item, min(row_seq) AS row_seq FROM v_store WHERE NOT ({_SPLIT}) GROUP BY 1, 2, 3, 4)
      SELECT * FROM inc WHERE NOT EXISTS (SELECT 1 FROM v_store o WHERE {_SPLIT.replace('created_at', 'o.created_at')} AND o.table_id = inc.table_id AND o.priority = inc.priority AND o.status = inc.status AND o.item = inc.item)""",
)
def _(t):
    new, old = _incoming(t)
    return rows.insert_if_absent(new, old, "row_key", "row_seq").select("table_id", *STORE, "row_seq")


@query(
    "s08_insert_counts",
    f"""WITH inc AS (SELECT table_id, priority, status, item, count(*) AS n FROM v_store WHERE NOT ({_SPLIT}) GROUP BY 1, 2, 3, 4),
      old AS (SELECT DISTINCT table_id, priority, status, item FROM v_store WHERE {_SPLIT}),
      m AS (SELECT inc.n, old.item IS NULL AS fresh FROM inc LEFT JOIN old USING (table_id, priority, status, item))
      SELECT count(*) FILTER (WHERE fresh) AS inserted, CAST(sum(n) AS BIGINT) - count(*) FILTER (WHERE fresh) AS skipped, CAST(sum(n) AS BIGINT) AS total FROM m""",
)
def _(t):
    new, old = _incoming(t)
    return rows.insert_counts(new, old, "row_key")


@query("s09_delete_table", "SELECT table_id, count(*) AS remaining FROM v_store WHERE table_id <> 't3' GROUP BY 1")
def _(t):
    return rows.remove_table(t.v_store, "t3").groupBy("table_id").agg(F.count(F.lit(1)).alias("remaining"))


def _csv_sql(expr: str) -> str:
    v = f"coalesce(CAST({expr} AS VARCHAR), '')"
    return f"""CASE WHEN regexp_matches({v}, '[",\\r\\n]') THEN '"' || replace({v}, '"', '""') || '"' ELSE {v} END"""


@query("s10_csv_lines", f"SELECT doc_id, {_csv_sql('doc_id')} || ',' || {_csv_sql('lang')} || ',' || {_csv_sql('source')} || ',' || {_csv_sql('text')} AS line FROM documents")
def _(t):
    return t.documents.select("doc_id", sinks.csv_line(["doc_id", "lang", "source", "text"]).alias("line"))


@query("s11_tsv_lines", "SELECT doc_id, doc_id || chr(9) || lang || chr(9) || regexp_replace(text, '\\r?\\n|\\t', ' ', 'g') AS line FROM documents")
def _(t):
    return t.documents.select("doc_id", sinks.tsv_line(["doc_id", "lang", "text"]).alias("line"))


@query("s12_json_lines", "SELECT row_seq, CAST(to_json(struct_pack(segment := segment, sparse := sparse, image_url := image_url)) AS VARCHAR) AS line FROM v_rows")
def _(t):
    return t.v_rows.select("row_seq", F.to_json(F.struct("segment", "sparse", "image_url")).alias("line"))


def _written(t, name, write):
    """Runs an export into the scratch folder and gives its path."""
    path = scratch_path(t.spark, name)
    write(path)
    return path


_CSV = f"SELECT row_seq, {_csv_sql('priority')} || ',' || {_csv_sql('status')} || ',' || {_csv_sql('item')} || ',' || row_seq AS line FROM v_store"


@query("s10_csv_file", f"SELECT line FROM ({_CSV}) UNION ALL SELECT 'priority,status,item,row_seq'")
def _(t):
    path = _written(t, "csv", lambda p: sinks.write_csv(t.v_store, p, [*STORE, "row_seq"]))
    return t.spark.read.text(path).select(c("value").alias("line"))


@query("s11_tsv_file", "SELECT priority || chr(9) || status || chr(9) || item AS line FROM v_store UNION ALL SELECT 'priority' || chr(9) || 'status' || chr(9) || 'item'")
def _(t):
    path = _written(t, "tsv", lambda p: sinks.write_tsv(t.v_store, p, STORE))
    return t.spark.read.text(path).select(c("value").alias("line"))


@query("s12_json_array", "SELECT row_seq, segment, image_url FROM v_rows")
def _(t):
    path = _written(t, "json", lambda p: sinks.write_json(t.v_rows, p, columns=["row_seq", "segment", "image_url"]))
    return t.spark.read.schema("row_seq long, segment string, image_url string").option("multiLine", True).json(path)


@query("s13_export_file", f"SELECT line FROM ({_CSV}) JOIN v_store USING (row_seq) WHERE contains(lower(priority), 'urgent') AND contains(lower(item), '1') UNION ALL SELECT 'priority,status,item,row_seq'")
def _(t):
    path = _written(t, "table", lambda p: sinks.export_table(t.v_store, [*STORE, "row_seq"], p, "csv", [c("created_at").desc(), c("row_seq").asc()], None, "Urgent", "item", "1"))
    return t.spark.read.text(path).select(c("value").alias("line"))


@query(
    "s13_export_rows",
    f"""WITH l AS (SELECT * FROM v_store ORDER BY created_at DESC, row_seq LIMIT 5000)
      SELECT row_seq, {_csv_sql('priority')} || ',' || {_csv_sql('status')} || ',' || {_csv_sql('item')} AS line FROM l WHERE contains(lower(priority), 'urgent') AND contains(lower(item), '1')""",
)
def _(t):
    r = rows.filtered_read(t.v_store, STORE, [c("created_at").desc(), c("row_seq").asc()], 5000, "Urgent", "item", "1")
    return r.select("row_seq", sinks.csv_line(STORE).alias("line"))


_ANY = " OR ".join(f"contains(lower({n}), 'build')" for n in COLS)


@query("p01_any_column_search", f"SELECT row_seq, segment FROM v_rows WHERE {_ANY}")
def _(t):
    return t.v_rows.filter(rows.search(COLS, " BUILD ")).select("row_seq", "segment")


@query("p02_column_contains", "SELECT row_seq, sparse FROM v_rows WHERE contains(lower(sparse), '#00')")
def _(t):
    return t.v_rows.filter(rows.column_contains(c("sparse"), "#00")).select("row_seq", "sparse")


@query(
    "p03_filtered_read",
    "WITH l AS (SELECT * FROM v_rows ORDER BY row_seq DESC LIMIT 300) SELECT row_seq, segment FROM l WHERE contains(lower(segment), 'ma') AND contains(lower(image_url), '/1')",
)
def _(t):
    return rows.filtered_read(t.v_rows, ["segment"], [c("row_seq").desc()], 300, "MA", "image_url", "/1").select("row_seq", "segment")


@query(
    "p04_cell_update",
    """WITH e AS (SELECT o_custkey AS k, max_by(o_orderstatus, o_orderkey) AS value FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
      SELECT row_seq, coalesce(e.value, segment) AS segment, sparse FROM v_rows LEFT JOIN e ON e.k = row_seq""",
)
def _(t):
    v = t.v_rows.select(F.lit("t").alias("table_id"), c("row_seq").alias("row_key"), rows.as_map(["segment", "sparse"]).alias("row_data"))
    e = t.orders.filter("o_orderpriority = '1-URGENT'").select(
        F.lit("t").alias("table_id"), c("o_custkey").alias("row_key"), F.lit("segment").alias("column_name"), c("o_orderstatus").alias("value"), c("o_orderkey").alias("edited_at")
    )
    return rows.update_cells(v, e).select(c("row_key").alias("row_seq"), c("row_data.segment").alias("segment"), c("row_data.sparse").alias("sparse"))


@query("p05_column_rename", "SELECT row_seq, sparse <> '' AS renamed, CASE WHEN sparse <> '' THEN sparse ELSE 'always' END AS constant FROM v_rows")
def _(t):
    m = F.map_filter(rows.as_map(COLS), lambda k, v: v != "")
    out = rows.rename_column(t.v_rows.select("row_seq", m.alias("d")), "d", "sparse", "constant")
    return out.select("row_seq", "renamed", c("d.constant").alias("constant"))


@query(
    "p06_column_merge",
    "SELECT row_seq, segment || ' / ' || seg_lower || CASE WHEN sparse <> '' THEN ' / ' || sparse ELSE '' END AS seg_copy, true AS changed FROM v_rows",
)
def _(t):
    return rows.merge_columns(t.v_rows, ["segment", "seg_lower", "sparse", "empty_only"], "seg_copy", " / ").select("row_seq", "seg_copy", "changed")


_CLEAN = dict(empty=True, repeating=True, mostly_empty=True, threshold=0.7, images=False, duplicates=True)


@query("p07_density_projection", "SELECT row_seq, segment, seg_lower FROM v_rows")
def _(t):
    kept, _removed = prof.cleanup_plan(t.v_rows, COLS, "row_seq", by_density=True, **_CLEAN)
    return prof.clean_rows(t.v_rows, kept, ["row_seq"])


@query("p08_drop_empty_rows", "SELECT row_seq, sparse FROM v_rows WHERE sparse <> ''")
def _(t):
    return prof.clean_rows(t.v_rows, ["sparse", "empty_only"], ["row_seq"], drop_empty_rows=True).select("row_seq", "sparse")


_KEYS = "CASE WHEN sparse <> '' THEN ['segment', 'seg_lower', 'seg_copy', 'constant', 'sparse', 'image_url'] ELSE ['segment', 'seg_lower', 'seg_copy', 'constant', 'image_url'] END"


@query(
    "a01_column_discovery",
    f"""WITH k AS (SELECT row_seq, {_KEYS} AS ks FROM v_rows), e AS (SELECT row_seq, unnest(ks) AS name, generate_subscripts(ks, 1) - 1 AS place FROM k),
      m AS (SELECT name, min(struct_pack(r := row_seq, p := place)) AS spot FROM e GROUP BY name) SELECT name, spot.r AS first_row, CAST(spot.p AS BIGINT) AS first_place FROM m""",
)
def _(t):
    m = F.map_filter(rows.as_map(COLS), lambda k, v: v != "")
    return rows.discover_columns(t.v_rows, m, c("row_seq"))


@query("a02_table_summary", "SELECT table_id, count(*) AS row_count, max(created_at) AS last_edited_at FROM v_store GROUP BY 1")
def _(t):
    return rows.table_summary(t.v_store.withColumnRenamed("created_at", "updated_at"))


@query(
    "a03_url_columns",
    """WITH m AS (SELECT 'url' AS name, url AS v FROM pages UNION ALL SELECT 'title', regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1) FROM pages UNION ALL SELECT 'page_id', CAST(page_id AS VARCHAR) FROM pages)
      SELECT name, count(*) AS row_count, count(DISTINCT CASE WHEN regexp_matches(trim(v), '(?i)^https?://[^/?#]+') THEN trim(v) END) AS url_count FROM m GROUP BY name""",
)
def _(t):
    from pagegrid.functions.text import tag_inner

    return rows.rank_url_columns(t.pages.select("url", tag_inner(c("html"), "title").alias("title"), "page_id"), ["url", "title", "page_id"])


@query("a03_url_values", "SELECT DISTINCT trim(url) AS url FROM pages")
def _(t):
    return rows.url_column_values(t.pages.select("url", "page_id"), ["url", "page_id"])


def _profile_sql(name: str) -> str:
    v = s.trim_ws(f"coalesce({name}, '')")
    img = f"(starts_with(lower({v}), 'data:image/') OR regexp_matches(lower({v}), '\\.(png|jpe?g|gif|webp|svg|bmp|avif)(\\?|#|$)') OR contains(lower({v}), 'images/') OR contains(lower({v}), '/image/') OR contains(lower({v}), 'img'))"
    return (
        f"SELECT '{name}' AS column_name, count(*) AS row_count, count(*) FILTER (WHERE {v} <> '') AS non_empty, count(DISTINCT nullif({v}, '')) AS distinct_non_empty, "
        f"count(*) FILTER (WHERE {v} <> '' AND {img}) AS image_like FROM v_rows"
    )


@query(
    "a04_column_profile",
    f"""WITH p AS ({' UNION ALL '.join(_profile_sql(n) for n in COLS)}) SELECT column_name, row_count, non_empty, distinct_non_empty, {s.round2('non_empty / row_count', 4)} AS density,
      {s.round2('1 - non_empty / row_count', 4)} AS empty_ratio, {s.round2('coalesce(image_like / nullif(non_empty, 0), 0)', 4)} AS image_ratio FROM p""",
)
def _(t):
    from pagegrid.functions.numbers import round_half_up as r

    return prof.profile(t.v_rows, COLS, "row_seq").select(
        c("column").alias("column_name"), "row_count", "non_empty", "distinct_non_empty",
        r(c("density"), 4).alias("density"), r(c("empty_ratio"), 4).alias("empty_ratio"), r(c("image_ratio"), 4).alias("image_ratio"),
    )


@query(
    "a05_cleanup_plan",
    """SELECT 'seg_copy' AS name, 'duplicate' AS reason FROM (SELECT count(*) FROM v_rows WHERE segment <> seg_copy HAVING count(*) = 0) UNION ALL SELECT 'constant', 'repeating' FROM (SELECT 1 FROM v_rows HAVING count(DISTINCT constant) = 1)
      UNION ALL SELECT 'sparse', 'mostly_empty' FROM (SELECT 1 FROM v_rows HAVING count(*) FILTER (WHERE sparse = '') >= 0.7 * count(*)) UNION ALL SELECT 'empty_only', 'empty' FROM (SELECT 1 FROM v_rows HAVING count(*) FILTER (WHERE empty_only <> '') = 0) UNION ALL SELECT 'image_url', 'image' FROM (SELECT 1 FROM v_rows HAVING count(*) > 0)""",
)
def _(t):
    _kept, removed = prof.cleanup_plan(t.v_rows, COLS, "row_seq", **_CLEAN)
    return t.spark.createDataFrame(sorted(removed.items()), "name string, reason string")


@query("a06_row_dedupe", "SELECT table_id, priority, status, item, min(row_seq) AS row_seq, count(*) AS copies FROM v_store GROUP BY 1, 2, 3, 4")
def _(t):
    return rows.dedupe(t.v_store, ["table_id", *STORE], "row_seq").select("table_id", *STORE, "row_seq", "copies")


@query("w03_first_occurrence", "SELECT priority, status, item, row_seq, table_id FROM (SELECT *, row_number() OVER (PARTITION BY priority, status, item ORDER BY row_seq) AS rn FROM v_store) WHERE rn = 1")
def _(t):
    return rows.dedupe(t.v_store, STORE, "row_seq").select(*STORE, "row_seq", "table_id")


@query("t01_newest_first", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(t):
    return t.events.select("event_id", "ts", "event_type").orderBy(c("ts").desc(), c("event_id").desc()).limit(50)


@query(
    "t02_keyset_page",
    "SELECT id, account_id, created_at FROM v_schedules WHERE (created_at < TIMESTAMP '1998-06-01 00:00:00' OR (created_at = TIMESTAMP '1998-06-01 00:00:00' AND id < 5000)) AND is_active ORDER BY created_at DESC, id DESC LIMIT 51",
)
def _(t):
    return rows.keyset_page(t.v_schedules.filter("is_active"), 50, ("1998-06-01 00:00:00", 5000)).select("id", "account_id", "created_at")


@query(
    "t06_column_ranking",
    f"WITH p AS ({' UNION ALL '.join(_profile_sql(n) for n in COLS)}) SELECT column_name, row_number() OVER (ORDER BY non_empty / row_count DESC, column_name) AS place FROM p",
)
def _(t):
    # one row per column: the single-task ranking is bounded by the table's width
    p = prof.profile(t.v_rows, COLS, "row_seq")
    return p.select(c("column").alias("column_name"), F.row_number().over(Window.orderBy(c("density").desc(), c("column"))).cast("long").alias("place"))


@query("t08_first_distinct_rows", "SELECT priority, status, item, min(row_seq) AS row_seq FROM v_store GROUP BY 1, 2, 3 ORDER BY row_seq LIMIT 400")
def _(t):
    return rows.dedupe(t.v_store, STORE, "row_seq").orderBy("row_seq").limit(400).select(*STORE, "row_seq")


@query("t10_capped_distinct_urls", "SELECT url, min(event_id) AS first_seen FROM (SELECT 'https://example.com/u/' || user_id AS url, event_id FROM events) GROUP BY url ORDER BY first_seen LIMIT 5000")
def _(t):
    e = t.events.select(F.concat(F.lit("https://example.com/u/"), "user_id").alias("url"), "event_id")
    return e.groupBy("url").agg(F.min("event_id").alias("first_seen")).orderBy("first_seen").limit(5000)


@query("u02_union_distinct", "SELECT o_custkey AS k FROM orders UNION SELECT user_id FROM events")
def _(t):
    return t.orders.select(c("o_custkey").alias("k")).unionByName(t.events.select(c("user_id").alias("k"))).distinct()


@query("u03_bag_union", "SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT user_id FROM events) GROUP BY k")
def _(t):
    u = t.orders.select(c("o_custkey").alias("k")).unionByName(t.events.select(c("user_id").alias("k")))
    return u.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query(
    "u04_schema_difference",
    """WITH lock AS (SELECT unnest(['segment', 'seg_lower', 'price']) AS name), actual AS (SELECT DISTINCT unnest(map_keys(m)) AS name FROM (SELECT MAP {'segment': segment, 'seg_lower': seg_lower, 'constant': constant} AS m FROM v_rows))
      SELECT name, 'missing' AS side FROM lock WHERE name NOT IN (SELECT name FROM actual) UNION ALL SELECT name, 'extra' FROM actual WHERE name NOT IN (SELECT name FROM lock)""",
)
def _(t):
    lock = t.spark.createDataFrame([("segment",), ("seg_lower",), ("price",)], "name string")
    actual = rows.discover_columns(t.v_rows, rows.as_map(["segment", "seg_lower", "constant"]), c("row_seq")).select("name")
    missing = lock.join(actual, "name", "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(actual.join(lock, "name", "left_anti").withColumn("side", F.lit("extra")))


@query("u06_unresolved", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150)")
def _(t):
    done = t.events.filter("event_type = 'purchase' AND value > 150").select("user_id")
    return t.events.select("user_id").distinct().join(done.distinct(), "user_id", "left_anti")


@query("j05_semi_join", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(t):
    return t.customer.join(t.orders.filter("o_totalprice > 300000"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("j06_anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(t):
    return t.customer.join(t.orders.filter("o_totalprice > 300000"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(
    "j07_seed_number_urls",
    """WITH x AS (SELECT p_partkey, p_brand, unnest(generate_series(1, p_size)) AS n FROM part) SELECT p_partkey, CAST(n AS BIGINT) AS n, 'https://example.com/' || replace(url_encode(p_brand), '+', '%20') || '/' || n AS url FROM x""",
)
def _(t):
    # the number axis is a per-row sequence, so the product never needs a cross join
    p = seeds.expand_range(t.part.select("p_partkey", "p_brand", "p_size"), F.lit(1), c("p_size"))
    return p.select("p_partkey", "n", seeds.fill_template("https://example.com/{seed}/{n}", c("p_brand"), c("n_text")).alias("url"))


def _run_summaries(t):
    """One small summary per job: detailed failures, plain failed urls, or a checkpoint, by status."""
    base = F.concat(F.lit("https://example.com/"), "account_id", F.lit("/"))
    detail = F.struct(F.concat(F.lit(" "), base, F.lit("a")).alias("url"), F.when(c("attempts") > 2, "HTTP error").otherwise(" ").alias("error"), F.concat(F.lit("E"), "attempts").alias("code"), c("attempts"))
    none = F.array().cast("array<struct<url:string,error:string,code:string,attempts:int>>")
    urls = F.array(F.concat(base, F.lit("b ")), F.concat(base, F.lit("b")), F.concat(base, F.lit("c")), F.lit(" "))
    return t.v_jobs.select(
        c("id").alias("run_id"), F.when(c("status") == "failed", F.array(detail, detail)).otherwise(none).alias("failures"), urls.alias("failed_urls"),
        F.when(c("status") == "queued", F.array(F.concat(base, F.lit("u")), F.concat(base, F.lit("u")))).alias("unresolved_urls"), F.when(c("status") == "retrying", F.array(F.concat(base, F.lit("r")))).alias("remaining_urls"),
    )


_BASE = "'https://example.com/' || account_id || '/'"


@query(
    "p19_failure_entries",
    f"""SELECT id AS run_id, CAST(p AS INT) AS pos, {_BASE} || 'a' AS url, CASE WHEN attempts > 2 THEN 'HTTP error' ELSE 'Extraction failed' END AS error, 'E' || attempts AS code, nullif(attempts, 0) AS attempts FROM v_jobs, (SELECT unnest([0, 1]) AS p) WHERE status = 'failed'
      UNION ALL SELECT id, p, {_BASE} || CASE p WHEN 0 THEN 'b' ELSE 'c' END, 'Extraction failed', '', NULL FROM v_jobs, (SELECT unnest([0, 1]) AS p) WHERE status <> 'failed'""",
)
def _(t):
    return recovery.failure_entries(_run_summaries(t))


@query(
    "p19_resume_urls",
    f"""SELECT id AS run_id, {_BASE} || CASE status WHEN 'queued' THEN 'u' WHEN 'retrying' THEN 'r' WHEN 'failed' THEN 'a' ELSE 'b' END AS url FROM v_jobs UNION ALL SELECT id, {_BASE} || 'c' FROM v_jobs WHERE status NOT IN ('queued', 'retrying', 'failed')""",
)
def _(t):
    return recovery.resume_urls(_run_summaries(t)).select("run_id", "url")


@query(
    "s14_failure_report",
    """SELECT id, 'https://example.com/job/' || id || ',Extraction failed,' || CASE WHEN status = 'failed' THEN 'E' || attempts ELSE '' END || ',' || CASE WHEN attempts = 0 THEN '' ELSE CAST(attempts AS VARCHAR) END AS line FROM v_jobs WHERE status IN ('failed', 'dead_letter')""",
)
def _(t):
    j = t.v_jobs.filter(c("status").isin("failed", "dead_letter")).select(
        "id", F.concat(F.lit("https://example.com/job/"), "id").alias("url"), F.lit("Extraction failed").alias("error"),
        F.when(c("status") == "failed", F.concat(F.lit("E"), "attempts")).otherwise("").alias("code"), F.nullif(c("attempts"), F.lit(0)).alias("attempts"),
    )
    return j.select("id", sinks.csv_line(["url", "error", "code", "attempts"]).alias("line"))


@query(
    "t03_scan_slices",
    "SELECT id, created_at, row_number() OVER (ORDER BY created_at, id) AS place FROM v_schedules",
)
def _(t):
    # one numbered scan in cursor order, cut into range slices: no global single-task sort
    return running(t.v_schedules.select("id", "created_at"), [], ["created_at", "id"], number="place", cheap=True)
