"""Tables that are used more than once, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only a session on this machine alone, as in tests, gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def table(df: DataFrame, **options: object) -> DataFrame:
    """Like ``cut``, as Parquet. A checkpoint keeps the size that the optimizer guessed for its plan, and the guesses of joins of
    joins of ... multiply; a file has its own size, by which the optimizer decides what to broadcast. ``options`` are the writer's."""
    path = fresh_path(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_alone(df: DataFrame) -> DataFrame:
    """Like ``table``; what writing it has shuffled is deleted as soon as it is written, not when the driver happens to collect its garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return table(df)
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)
