"""Shared scratch folder and lineage cuts.

Executors may be lost at any time, so intermediate state lives in reliable storage: the folder named by
``spark.checkpoint.dir``. A local session (tests, trials) that names none gets a folder of its own; on a cluster a missing
setting is an error, since executors would not see each other's files.
"""
from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}
_STAGED: list[tuple[SparkSession, str]] = []
_TABLES: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="pagegrid-")
    return _LOCAL_FOLDERS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def release() -> None:
    """Deletes what was staged or cut so far. Call it when no result that reads it is still needed; it also runs at exit."""
    while _TABLES:
        spark, name = _TABLES.pop()
        if spark.sparkContext._jsc is not None and spark.sparkContext._jvm is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    while _STAGED:
        spark, path = _STAGED.pop()
        jvm = spark.sparkContext._jvm
        if spark.sparkContext._jsc is None or jvm is None:  # stopped
            continue
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _at_exit() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001  the gateway may be gone already
        _STAGED.clear()
        _TABLES.clear()


atexit.register(_at_exit)


def _children(spark: SparkSession, folder: str) -> set[str]:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {status.getPath().toString() for status in files.listStatus(place)} if files.exists(place) else set()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint so iterative plans stay short."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    before = _children(spark, spark.sparkContext.getCheckpointDir())
    done = df.checkpoint(eager=True)
    _STAGED.extend((spark, path) for path in _children(spark, spark.sparkContext.getCheckpointDir()) - before)
    return done


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a columnar table in the shared folder and read it back.

    For results several later steps read: each reads only its columns, and a lost executor
    costs a re-read, never a recomputation.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_merge(df: DataFrame) -> DataFrame:
    """``df``, joined by merges and never collected for a broadcast, whatever size the planner takes it to have. It holds for
    joins with ``df`` and with what is selected, filtered or grouped from it, but not with the result of a join or union.
    """
    return df.hint("merge")


#: joins on several columns use an order of one of them; a task reads whole buckets, which are of one size; few files are open
#: where the rows of a task share a bucket
_BY_KEY = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.maxConcurrentOutputFileWriters": "4",
}


def stage_by(df: DataFrame, label: str, key: str, laid: bool = False, parts: int | None = None) -> DataFrame:
    """As ``stage``, in buckets of ``key``: steps that join, group or order by ``key`` and more need no further exchange of it
    when their result is staged here too. ``laid``: the rows come as ``repartition(parts, key)`` left them. ``parts``:
    how many buckets, the session's shuffle partitions by default.

    Joins with it are merge joins. The planner knows the size of its files only, and rows of repeating keys take twenty times
    that and more in memory: a side that looks small enough to be sent to all tasks may not fit into the driver.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"{label}_{uuid.uuid4().hex}", scratch_path(spark, label)
    before = {k: spark.conf.get(k) for k in _BY_KEY}
    try:
        for k, v in _BY_KEY.items():
            spark.conf.set(k, v)
        (df if laid else df.repartition(n, key)).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(name)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    _TABLES.append((spark, name))
    return by_merge(spark.table(name))
