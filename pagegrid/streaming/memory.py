"""Entities seen in earlier runs: a bounded memory per scope, carried from micro-batch to micro-batch.

The memory of a scope is its ``limit`` newest entities in the order in which they were accepted. A batch is reduced to its
entities, checked against the memory by a join, and leaves a new version of the memory, its accepted rows and its counters
in folders of its own; a batch that is run again finds the same older version and rewrites these folders.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

c = F.col


def remember(rows: DataFrame, stored: DataFrame, run: int, scope: str, key: str, order: str, limit: int = 50_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted rows, counters, memory) of one run. ``stored``: (scope, key, run, at), the memory before it.

    Of each entity that the memory lacks the first row by ``order``, unique in a scope, is accepted; rows without a key
    always are. Counters are (scope, accepted, skipped).
    """
    named = rows.filter(c(key) != "").groupBy(scope, key).agg(F.min(order).alias("at"))
    fresh = named.join(stored.select(scope, key), [scope, key], "left_anti")
    accepted = rows.join(fresh.select(scope, key, c("at").alias(order)), [scope, key, order], "left_semi").unionByName(rows.filter(c(key) == ""))
    taken = accepted.groupBy(scope).agg(F.count(F.lit(1)).alias("accepted"))
    counters = rows.groupBy(scope).agg(F.count(F.lit(1)).alias("rows")).join(taken, scope, "left").select(scope, F.coalesce("accepted", F.lit(0)).alias("accepted"), (c("rows") - F.coalesce("accepted", F.lit(0))).alias("skipped"))
    newest = Window.partitionBy(scope).orderBy(c("run").desc(), c("at").desc())
    both = stored.unionByName(fresh.select(scope, key, F.lit(run).cast("long").alias("run"), "at"))
    memory = both.withColumn("place", F.row_number().over(newest)).filter(c("place") <= limit).drop("place")
    return accepted, counters, memory


def seen_memory(stream: DataFrame, base: str, scope: str, key: str, order: str, limit: int = 50_000) -> None:
    """Takes in all available input of ``stream``; call it again for later input. Under ``base`` it writes ``accepted``,
    ``counters`` and ``memory``, each with a folder per micro-batch.
    """
    kinds = ", ".join(f"`{n}` {stream.schema[n].dataType.simpleString()}" for n in (scope, key))
    schema = f"{kinds}, run long, at {stream.schema[order].dataType.simpleString()}"

    def handle(batch: DataFrame, run: int, base: str = base) -> None:
        spark = batch.sparkSession
        # micro-batches are numbered without gaps
        stored = spark.read.schema(schema).parquet(f"{base}/memory/batch_id={run - 1}") if run else spark.createDataFrame([], schema)
        batch = batch.persist()
        try:
            for name, df in zip(("accepted", "counters", "memory"), remember(batch, stored, run, scope, key, order, limit), strict=True):
                df.write.mode("overwrite").parquet(f"{base}/{name}/batch_id={run}")
        finally:
            batch.unpersist()

    stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
