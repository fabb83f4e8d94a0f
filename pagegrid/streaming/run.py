"""Sources and sinks of streaming jobs: files in, parquet in the shared folder out."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagegrid.plans.lineage import scratch_path

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream over ``folder/name.parquet``; zone-less times become timestamps so watermarks work."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    for f in schema.fields:
        if f.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def settle(df: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over all available input and read back what it wrote.

    Output and offsets live in the shared folder. State is kept in RocksDB, so it may exceed memory.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    base = scratch_path(spark, label)
    q = (
        df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def settle_batches(df: DataFrame, label: str, handle: Callable[[DataFrame, int, str], None], schema) -> DataFrame:
    """As ``settle`` with a handler per micro-batch, which writes under the given table path."""
    spark = df.sparkSession
    base = scratch_path(spark, label)
    table = f"{base}/table"
    q = df.writeStream.foreachBatch(lambda b, i: handle(b, i, table)).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(table)
