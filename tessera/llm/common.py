"""Helpers that several corpus operators share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the folder of ``shared_folder``."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names. Without one: a folder of this machine in local mode, else an error."""
    if folder := spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if spark.sparkContext.master.startswith("local"):
        return os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")


def free_name(taken: list[str], wanted: str) -> str:
    """A column name that no column of ``taken`` has (names compare without case)."""
    have = {c.lower() for c in taken}
    while wanted.lower() in have:
        wanted = f"_{wanted}"
    return wanted


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(key: Column, seed: str) -> Column:
    """The first 15 hex digits of an MD5 as a non-negative long: the same number in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 15), 16, 10).cast("long")


#: A key with more rows than this is split; at most LISTED keys are (the threshold rises with the rows, so that no more can be).
HOT, LISTED = 4096, 100_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with ``value`` computed once however often a lambda of ``body`` reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_join(rows: DataFrame, classes: DataFrame, keys: list[str], tell: list[str], how: str = "inner", hot: int = HOT, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``classes`` (one row a key; ``n``: rows of that key) on ``keys`` without null. A key of many rows is
    split by a hash of the columns ``tell`` and its class repeated for each part, so no task gets a hot key whole.

    The list of hot keys is broadcast: with a threshold of at least total / LISTED it has fewer than LISTED rows. ``total``:
    the sum of ``n``, or a greater number, where it is known."""
    total = (classes.agg(F.sum("n")).first()[0] or 0) if total is None else total
    limit = max(hot, total // LISTED)
    hottest = classes.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("_k"))
    k = F.coalesce("_k", F.lit(1))
    dealt = rows.join(F.broadcast(hottest), keys, "left").withColumn("_part", F.pmod(F.xxhash64(*tell), k).cast("int")).drop("_k")
    spread = classes.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / limit), F.lit(1)).cast("int") - 1))).drop("n")
    return dealt.join(spread, [*keys, "_part"], how).drop("_part")
