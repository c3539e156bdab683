"""Streams of file changes and of events.

Late events have no bound in this model: a fold must come out the same whenever they arrive. So each micro-batch appends to the stored
log and refolds only the keys that it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from tessera.operators.events import fold_balance


def changed_files(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of a batch (file, hash, ...) whose content isn't stored yet; unchanged files are skipped."""
    return batch.join(stored.select("file", "hash").distinct(), ["file", "hash"], "left_anti")


def refold(spark: SparkSession, log_path: str, batch: DataFrame, batch_id: int, as_of: int | None = None, fold: Callable[..., DataFrame] = fold_balance) -> DataFrame:
    """Stores a batch in the log and folds, over the whole log, the keys that the batch holds. A batch has a folder of its own, which a retry
    replaces, so no event is stored twice."""
    batch.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
    log = spark.read.schema(batch.schema).parquet(log_path).select(*batch.columns)
    return fold(log.join(batch.select("key").distinct(), "key", "left_semi"), as_of)


def start_refold(stream: DataFrame, log_path: str, out: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A streaming query that hands out(refolded keys, batch id) for each micro-batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        out(refold(batch.sparkSession, log_path, batch, batch_id), batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
