"""Folders that all executors see, and their files."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether a query's shuffle files are removed when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder in spark.checkpoint.dir; on one machine, where that is unset, below a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="regspark-checkpoint-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether any path fits the pattern (a path, or one with *)."""
    system, at = _file(spark, pattern)
    return bool(len(system.globStatus(at) or ()))


def remove(spark: SparkSession, path: str) -> None:
    system, at = _file(spark, path)
    system.delete(at, True)


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Jobs inside take their shuffle files off the disk when they end, where Spark would leave them to garbage collection."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in a new folder and read it from there: what is read several times is worked out once.

    The shuffle files of that work go when the table is written.
    """
    at = new_folder(df.sparkSession, name)
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def once(value: Column) -> Column:
    """`value` as a generated column: what is built on it further up does not work it out again."""
    return F.explode(F.array(value))
