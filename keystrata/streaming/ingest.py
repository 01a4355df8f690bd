"""Streaming ingestion of change-log files into a store: every micro-batch becomes one run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.log import LOG_SCHEMA
from ..sources.store import KVStore


def log_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LOG_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def ingest(stream: DataFrame, store: KVStore, checkpoint: str) -> StreamingQuery:
    """Rows keep their versions: late files and a batch replayed after a failure, or after newer writes, change nothing."""

    def load(batch: DataFrame, _epoch: int) -> None:
        if not batch.isEmpty():
            store.ingest(batch)

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
