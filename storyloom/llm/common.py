"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.sources.checkpoints import cut, table

__all__ = ["WORD", "add_values", "cut", "load", "map_batches", "map_values", "pa_type", "row_key", "table"]

#: A word is a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_values(df: DataFrame, keep: list[Column], value: Column, fn: Callable[[object], tuple], schema: T.StructType) -> DataFrame:
    """``keep`` columns followed by the columns that ``fn`` makes from one value; one output row for each input row.

    Rows pass through in Arrow batches, one value at a time is a Python object.
    """
    kept = df.select(*keep)
    out = T.StructType([*kept.schema.fields, *schema.fields])
    kinds = [pa_type(f.dataType) for f in schema.fields]
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fn(v.as_py()) for v in batch.column(n)]
            columns = [pa.array([m[i] for m in made], kinds[i]) for i in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], names=out.fieldNames())

    return df.select(*keep, value.alias("_value")).mapInArrow(run, out)


def map_batches(df: DataFrame, keep: list[Column], value: Column, fn: Callable[[Iterator[pa.Array]], Iterator[list[tuple]]], schema: T.StructType) -> DataFrame:
    """Like ``map_values`` with a function over the batches of a task: for each array of values it gives a list of as many rows."""
    kept = df.select(*keep)
    out = T.StructType([*kept.schema.fields, *schema.fields])
    kinds = [pa_type(f.dataType) for f in schema.fields]
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def values() -> Iterator[pa.Array]:
            for batch in batches:
                held.append(batch)
                yield batch.column(n)

        for made in fn(values()):
            columns = [pa.array([m[i] for m in made], kinds[i]) for i in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([*held.pop(0).columns[:n], *columns], names=out.fieldNames())

    return df.select(*keep, value.alias("_value")).mapInArrow(run, out)


def add_values(df: DataFrame, value: str, fn: Callable[[object], tuple], schema: T.StructType) -> DataFrame:
    """``df`` with the columns that ``fn`` makes from the column ``value``; its own columns pass through in Arrow batches."""
    out = T.StructType([*df.schema.fields, *schema.fields])
    kinds = [pa_type(f.dataType) for f in schema.fields]
    n, at = len(df.columns), df.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fn(v.as_py()) for v in batch.column(at)]
            columns = [pa.array([m[i] for m in made], kinds[i]) for i in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], names=out.fieldNames())

    return df.mapInArrow(run, out)


def pa_type(kind: T.DataType) -> pa.DataType:
    simple = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_(), T.BinaryType(): pa.binary()}
    return pa.list_(pa_type(kind.elementType)) if isinstance(kind, T.ArrayType) else simple[kind]


def row_key() -> list[Column]:
    """Tells rows of ``documents`` apart also where a doc_id is null or repeats with another text."""
    return [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
