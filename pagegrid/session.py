"""Session factory used by tests, the bench and the command line."""
from __future__ import annotations

import os

from pyspark.sql import SparkSession

from pagegrid.plans.shipping import ship


def build_session(app: str = "pagegrid", master: str | None = None, partitions: int | None = None, shared: str | None = None) -> SparkSession:
    """Build (or reuse) a session. On a cluster leave ``master`` unset: spark-submit supplies it.

    ``shared`` names a folder that the driver and all executors see, unless the configuration does.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # regex-heavy expressions make small partitions worth their own task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("PAGEGRID_DRIVER_MEMORY", "8g"))
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = ship(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
