"""Versions of a table below one folder: the state that is kept between runs (parsed files, ledger, churn, suggestions, results).

A version is a folder of its own and counts once it was written whole, so readers never meet half of one, a lost write leaves
the former version in force, and a table may be replaced by one that was computed from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of whole versions, in order."""
    p, fs = _folder(spark, folder)
    if not fs.exists(p):
        return []
    found = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and fs.exists(_folder(spark, f"{folder}/{name}/_SUCCESS")[0]):
            found.append(int(name[1:]))
    return sorted(found)


def save(df: DataFrame, folder: str, keep: int = 2) -> int:
    """Writes the next version and removes all but the last ``keep``. One writer at a time."""
    spark = df.sparkSession
    number = (versions(spark, folder) or [0])[-1] + 1
    df.write.mode("overwrite").parquet(f"{folder}/v{number}")
    for old in versions(spark, folder)[:-keep]:
        p, fs = _folder(spark, f"{folder}/v{old}")
        fs.delete(p, True)
    return number


def load(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The last version; an empty table of ``schema`` before the first."""
    found = versions(spark, folder)
    return spark.read.schema(schema).parquet(f"{folder}/v{found[-1]}") if found else spark.createDataFrame([], schema)
