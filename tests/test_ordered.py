"""Sliced running computations, the limiter chain and profiles against plain windows and brute force."""
import random

from pyspark.sql import Window, functions as F

from pagegrid.operators import profile, ratelimit
from pagegrid.plans.ordered import running, with_slices

c = F.col


def skewed(spark, n=3000):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randint(1, 20)}", rnd.randint(0, 500), i, rnd.choice(["a", "b", None]), rnd.randint(-5, 50)) for i in range(n)]
    return spark.createDataFrame(rows, "key string, ts int, id int, label string, v int")


def test_running_equals_windows_for_a_hot_key(spark):
    df = skewed(spark)
    got = running(df, ["key"], ["ts", "id"], sums={"total": c("v")}, maxima={"peak": c("v")}, last_known={"known": c("label")}, lags={"before": "label"}, number="n", slices=24)
    w = Window.partitionBy("key").orderBy("ts", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "*", F.sum("v").over(upto).alias("total"), F.row_number().over(w).cast("long").alias("n"), F.max("v").over(upto).alias("peak"),
        F.last("label", ignorenulls=True).over(upto).alias("known"), F.lag("label").over(w).alias("before"),
    )
    cols = sorted(want.columns)
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_slices_cut_a_hot_key_into_many_tasks(spark):
    sliced = with_slices(skewed(spark), ["key", "ts", "id"], 24)
    sizes = [r["n"] for r in sliced.groupBy("__slice").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 20 and max(sizes) < 3000 / 24 * 3
    assert sliced.filter("key = 'hot'").select("__slice").distinct().count() >= 12


def brute_limit(rows, length, cap):
    state, out = {}, {}
    for key, at, rid in sorted(rows, key=lambda r: (r[1], r[2])):
        start, count = state.get(key, (None, 0))
        if start is None or at >= start + length:
            start, count = at, 0
        count += 1
        state[key] = (start, count)
        out[rid] = (count, count > cap)
    return out


def test_limiter_chain_over_slices_equals_brute_force(spark):
    rnd = random.Random(9)
    rows, at = [], 0
    for i in range(4000):
        at += rnd.choice([0, 1, 20, 400, 900, 5000 if rnd.random() < 0.05 else 30])
        rows.append(("hot" if rnd.random() < 0.8 else f"k{rnd.randint(1, 5)}", at, i))
    df = spark.createDataFrame(rows, "key string, at long, id int").select("key", F.timestamp_millis("at").alias("ts"), "at", "id")
    want = brute_limit(rows, 1000, 3)
    starts = {(r["key"], r["at"]): r["start"] for r in ratelimit.window_starts(df, "key", "at", 1000, slices=32).collect()}
    state = {}
    for key, t, _ in sorted(rows, key=lambda r: r[1]):
        if key not in state or t >= state[key] + 1000:
            state[key] = t
        assert starts[(key, t)] == state[key]
    got = {r["id"]: (r["request_no"], r["limited"]) for r in ratelimit.fixed_window_limit(df, "key", "ts", "id", 1000, 3).collect()}
    assert got == want


def test_profile_signature_tells_equal_columns(spark):
    df = spark.createDataFrame([(i, f"v{i % 3}", f" v{i % 3} ", f"v{(i + 1) % 3}") for i in range(30)], "id int, a string, b string, z string")
    sig = {r["column"]: r["sig"] for r in profile.profile(df, ["a", "b", "z"], "id").collect()}
    assert sig["a"] == sig["b"] != sig["z"]


def test_nearest_rank_without_keys(spark):
    from pagegrid.operators.metrics import nearest_rank

    df = spark.range(1, 21).select(c("id").cast("double").alias("v"))
    assert nearest_rank(df, [], "v", 0.95, "p").first()["p"] == 19.0
    assert nearest_rank(df.limit(1), [], "v", 0.95, "p").first()["p"] in {float(i) for i in range(1, 21)}
    assert nearest_rank(df.limit(0), [], "v", 0.95, "p").count() == 0


def test_null_keys_are_keys(spark):
    from pagegrid.operators.metrics import nearest_rank, tail_per_key

    rows = [(None if i % 2 else "k", i, i) for i in range(10)]
    df = spark.createDataFrame(rows, "key string, at long, id int").withColumn("ts", F.timestamp_millis("at"))
    got = {r["id"]: r["request_no"] for r in ratelimit.fixed_window_limit(df, "key", "ts", "id", 1000, 3).collect()}
    assert got == {i: i // 2 + 1 for i in range(10)}
    assert {(r["key"], r["p"]) for r in nearest_rank(df, ["key"], "id", 1.0, "p").collect()} == {(None, 9.0), ("k", 8.0)}


def test_long_tail_of_a_hot_key(spark):
    from pagegrid.operators.metrics import tail_per_key

    df = skewed(spark, 6000)
    got = tail_per_key(df, ["key"], [c("ts").desc(), c("id").desc()], 2000)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(c("ts").desc(), c("id").desc()))).filter("n <= 2000").drop("n")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.filter("key = 'hot'").count() == 2000
