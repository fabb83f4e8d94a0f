"""Insert-if-absent from a stream: each micro-batch is reduced and anti-joined before it is appended."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from pagegrid.operators.rows import insert_if_absent
from pagegrid.streaming.run import settle_batches


def append_new(stream: DataFrame, key: str, order: str) -> DataFrame:
    """Append rows whose key is new; a replayed batch rewrites its own folder, so it stays exactly once."""
    schema = stream.schema

    def handle(batch: DataFrame, batch_id: int, table: str) -> None:
        try:
            stored = batch.sparkSession.read.parquet(table).filter(F.col("batch_id") != batch_id)
        except AnalysisException:  # first batch: nothing stored yet
            stored = batch.limit(0)
        insert_if_absent(batch, stored, key, order).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return settle_batches(stream, "append", handle, schema)
