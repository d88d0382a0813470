"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
WORD_BREAKS = " \t\n\x0b\f\r"
WORD_BREAK_PATTERN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` in the folder `sf_dir`, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which all executors see.

    It is the one named by spark.checkpoint.dir; only on one machine, where that is unset, a
    temporary folder is taken.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="regspark-checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder as a checkpoint and cut its lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder as Parquet and read it from there; dropped() removes it."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/regspark-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def dropped(*tables: DataFrame) -> None:
    """Remove tables that stored() wrote and that nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def words(text: Column) -> Column:
    """The words of a text (null: none) as an array, in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK_PATTERN), lambda w: w != "")


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id, written as text, leaves `remainder`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def least_by_hash(df: DataFrame, id_col: str, n: int, total: int) -> DataFrame:
    """The `n` rows of `df`, which has `total`, that come first by a hash of the id.

    A threshold for the hash leaves a few times as many, so that few rows of each task are sorted.
    """
    draw = F.pmod(F.xxhash64(id_col), F.lit(1 << 30))
    if total > 4 * n:
        df = df.where(draw < int((1 << 30) * 4 * n / total))
    return df.orderBy(draw, id_col).limit(n)


def fresh(df: DataFrame, name: str) -> str:
    """A column name beginning with `name` that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
