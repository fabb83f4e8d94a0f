"""Row-table fixtures: storage, cleanup, export, url lists, recovery."""
import json

import pytest
from pyspark.sql import functions as F

from pagegrid.operators import profile, recovery, rows, seeds
from pagegrid.sources import sinks

c = F.col


def test_dedupe_on_insert(spark):
    batch = spark.createDataFrame([(0, "Alpha", "10"), (1, "Beta", "20"), (2, "Alpha", "10")], "seq int, name string, price string")
    keyed = batch.withColumn("row_key", rows.content_key(F.lit("t"), ["name", "price"]))
    none = keyed.limit(0)
    assert rows.insert_counts(keyed, none, "row_key").first().asDict() == {"inserted": 2, "skipped": 1, "total": 3}
    stored = rows.insert_if_absent(keyed, none, "row_key", "seq")
    assert sorted(r["seq"] for r in stored.collect()) == [0, 1]
    assert rows.insert_if_absent(keyed, stored, "row_key", "seq").count() == 0


@pytest.fixture
def people(spark):
    data = [
        (0, "Ada", "Lovelace", "London", "x1", "x1", "same", "", "https://a.example/1.png", ""),
        (1, "Alan", "Turing", "Wilmslow", "x2", "x2", "same", "", "https://a.example/2.png", ""),
        (2, "Grace", "Hopper", "New York", "x3", "x3", "same", "only", "https://a.example/3.png", ""),
        (3, "", "", "", "", "", "same", "", "https://a.example/4.png", ""),
    ]
    return spark.createDataFrame(data, "id int, first_name string, last_name string, city string, dup_a string, dup_b string, constant string, sparse string, image_url string, empty_only string")


COLS = ["first_name", "last_name", "city", "dup_a", "dup_b", "constant", "sparse", "image_url", "empty_only"]


def test_merge_and_cleanup(people):
    merged = rows.merge_columns(people, ["first_name", "last_name"], "full_name")
    assert merged.filter("changed").count() >= 3
    assert [r["full_name"] for r in merged.orderBy("id").collect()] == ["Ada Lovelace", "Alan Turing", "Grace Hopper", ""]
    kept, removed = profile.cleanup_plan(people, COLS, "id", empty=True, repeating=True, mostly_empty=True, threshold=0.7, images=False, duplicates=True)
    assert {"dup_b", "constant", "image_url", "empty_only"} <= set(removed)
    cleaned = profile.clean_rows(people, kept, ["id"], drop_empty_rows=True)
    assert cleaned.count() == 3
    again, more = profile.cleanup_plan(cleaned, kept, "id", empty=True, duplicates=True, images=False)
    assert again == kept and more == {}


def test_cleanup_refuses_to_drop_everything(spark):
    with pytest.raises(ValueError):
        profile.cleanup_plan(spark.createDataFrame([(1, "")], "id int, a string"), ["a"], "id", empty=True)


def test_repeated_merge_changes_nothing(people):
    once = rows.merge_columns(people, ["first_name", "last_name"], "full_name").drop("changed")
    assert rows.merge_columns(once, ["first_name", "last_name"], "full_name").filter("changed").count() == 0


def test_export_text(spark, tmp_path):
    df = spark.createDataFrame([("A \"quoted\"", 1.5, True, "line1\nline2"), ("B", 2.0, False, "a,b\tc")], "name string, price double, inStock boolean, notes string")
    cols = df.columns
    lines = [r[0] for r in df.select(sinks.csv_line(cols)).collect()]
    assert lines == ['"A ""quoted""",1.5,true,"line1\nline2"', 'B,2.0,false,"a,b\tc"']
    assert [r[0] for r in df.select(sinks.tsv_line(cols)).collect()][1] == "B\t2.0\tfalse\ta,b c"
    assert sinks.csv_header(cols) == "﻿name,price,inStock,notes"
    sinks.write_tsv(df, str(tmp_path / "t"))
    written = [r[0] for r in spark.read.text(str(tmp_path / "t"), recursiveFileLookup=True).collect()]
    assert len(written) == 3 and "name\tprice\tinStock\tnotes" in written
    sinks.write_csv(df.repartition(2).orderBy("name"), str(tmp_path / "c"))
    assert (tmp_path / "c").read_bytes().decode() == '\ufeffname,price,inStock,notes\n"A ""quoted""",1.5,true,"line1\nline2"\nB,2.0,false,"a,b\tc"'
    sinks.write_csv(df.limit(0), str(tmp_path / "c"))  # replaces the file
    assert (tmp_path / "c").read_bytes().decode() == "\ufeffname,price,inStock,notes"
    many = spark.range(1000).selectExpr("id", "repeat('x', cast(id % 50 as int)) AS b").repartition(5)
    sinks.write_json(many.orderBy("id"), str(tmp_path / "a"))
    assert json.loads((tmp_path / "a").read_text()) == [{"id": i, "b": "x" * (i % 50)} for i in range(1000)]
    sinks.write_json(many.limit(0), str(tmp_path / "a"))
    assert json.loads((tmp_path / "a").read_text()) == []
    out = sinks.export_table(df, cols, str(tmp_path / "j"), fmt="json", needle="QUOTED")
    assert out.count() == 1 and spark.read.text(str(tmp_path / "j")).count() == 1


def test_url_templates(spark):
    one = spark.range(1)
    page = seeds.expand_range(one, F.lit(1), F.lit(3)).select(seeds.fill_template("https://e.example/page/{n}", number=c("n_text")))
    assert sorted(r[0] for r in page.collect()) == [f"https://e.example/page/{i}" for i in (1, 2, 3)]
    down = seeds.expand_range(one, F.lit(2), F.lit(-2), step=2, padding=3)
    assert [r["n_text"] for r in down.orderBy(F.desc("n")).collect()] == ["002", "000", "-002"]
    s = spark.createDataFrame([("new york, ny\nnew york",), ("it's (a) ~ test!*",)], "raw string").withColumn("text", c("raw"))
    got = seeds.seeds(s.select("text", "raw").withColumn("id", F.monotonically_increasing_id()).drop("raw"), "text").select(seeds.fill_template("/{seed}", seed=c("seed")))
    assert sorted(r[0] for r in got.collect()) == ["/it's%20(a)%20~%20test!*", "/new%20york", "/ny"]
    with pytest.raises(ValueError):
        seeds.fill_template("/none")


def test_failure_and_resume(spark):
    schema = "run_id int, failures array<struct<url:string,error:string,code:string,attempts:int>>, failed_urls array<string>, unresolved_urls array<string>, remaining_urls array<string>"
    runs = spark.createDataFrame([(1, [("https://a", "boom", "E1", 2), ("https://b", None, None, 0)], None, ["https://b"], None), (2, [], [" https://c", "https://c"], None, None)], schema)
    e = {(r["run_id"], r["url"]): (r["error"], r["code"], r["attempts"]) for r in recovery.failure_entries(runs).collect()}
    assert e == {(1, "https://a"): ("boom", "E1", 2), (1, "https://b"): ("Extraction failed", "", None), (2, "https://c"): ("Extraction failed", "", None)}
    assert recovery.retry_urls(runs).filter("run_id = 1").count() == 2
    assert sorted((r["run_id"], r["url"]) for r in recovery.resume_urls(runs).collect()) == [(1, "https://b"), (2, "https://c")]


def test_edit_rename_and_schema_lock(spark):
    df = spark.createDataFrame([("t", "k1", {"a": "1", "b": "2"}), ("u", "k1", {"a": "9"})], "table_id string, row_key string, row_data map<string,string>")
    edits = spark.createDataFrame([("t", "k1", "a", "x", 1), ("t", "k1", "a", "y", 2), ("t", "zz", "a", "n", 1)], "table_id string, row_key string, column_name string, value string, edited_at int")
    got = {(r["table_id"], r["row_key"]): r["row_data"] for r in rows.update_cells(df, edits).collect()}
    assert got == {("t", "k1"): {"a": "y", "b": "2"}, ("u", "k1"): {"a": "9"}}
    renamed = rows.rename_column(df, "row_data", "a", "b").orderBy("table_id").collect()
    assert [(r["renamed"], r["row_data"]) for r in renamed] == [(True, {"b": "1"}), (True, {"b": "9"})]
    assert rows.rename_column(df, "row_data", "a", "a").filter("renamed").count() == 0
    with pytest.raises(ValueError, match="missing: price"):
        rows.enforce_schema(df, ["table_id", "row_key", "row_data", "price"])
