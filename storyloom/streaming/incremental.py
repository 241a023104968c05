"""Incremental runs over arriving files: each batch goes through the same functions as a batch job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def run_available(spark: SparkSession, path: str, schema: T.StructType, step: Callable[[DataFrame, int], None], checkpoint: str, fmt: str = "parquet", files: int | None = None) -> StreamingQuery:
    """Handles all files under ``path`` that no earlier run has, in batches, then ends. ``step`` gets each batch and its number; it must give the same output for the
    same number, as a batch is tried again after a failure."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    query = reader.load(path).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def into_batches(out: str, transform: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A step that writes ``transform(batch)`` to the batch's own partition, so a repeated batch overwrites itself."""

    def step(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return step
