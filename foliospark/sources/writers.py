"""Sinks: replacement by key without losing the old version, tagged text, resumable cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, at: str):
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = jvm.Path(at)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def replace_atomically(df: DataFrame, path: str) -> None:
    """Write beside, then rename: readers see the old table or the new one."""
    fs, p, jvm = _fs(df.sparkSession, path)
    fresh, old = jvm.Path(path + ".new"), jvm.Path(path + ".old")
    df.write.mode("overwrite").parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(p):
        fs.rename(p, old)
    fs.rename(fresh, p)
    fs.delete(old, True)


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str) -> None:
    """Replace all rows of the keys in ``rows``; a key without rows keeps what it has. Nothing to write is an error before anything is deleted."""
    if rows.isEmpty():
        raise ValueError("nothing to write")
    fs, p, _ = _fs(spark, path)
    if fs.exists(p):
        old = spark.read.parquet(path)
        rows = old.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)
    replace_atomically(rows, path)


def delete(spark: SparkSession, path: str, keys: DataFrame, key: str) -> int:
    """Delete the rows of the given keys; returns how many keys were there."""
    old = spark.read.parquet(path)
    hit = old.join(keys.select(key).distinct(), key, "left_semi").select(key).distinct().count()
    replace_atomically(old.join(keys.select(key).distinct(), key, "left_anti"), path)
    return hit


def write_cells(df: DataFrame, path: str, cells: tuple[str, ...] = ("parser", "chunker")) -> None:
    """One folder per cell; a cell written again replaces itself and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*cells).parquet(path)


def write_tagged_text(texts: DataFrame, path: str) -> None:
    """stem, text as text files by stem."""
    texts.select("stem", F.col("text").alias("value")).write.mode("overwrite").partitionBy("stem").text(path)
