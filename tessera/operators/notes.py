"""Session notes over their append-only log: what is still active, and what of it answers a question.

Each write ages all active notes by one turn and adds one. All scores shrink by the same factor, so their order never
changes, and what a working set keeps that drops its least note whenever it is full is the same as the best notes of the whole
log: a window function, not a replay."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import ranking
from tessera.operators.governor import DECAY

# Fixed values.
ACTIVE, IMPORTANCE = 50, (1, 5)


def appended(log: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (note_id, session_id, content, importance, timestamp) with the turns that follow those of the log (order:
    timestamp, note_id). An importance out of range raises."""
    low, high = IMPORTANCE
    fits = F.when(F.col("importance").between(low, high), F.col("importance")).otherwise(F.raise_error(F.lit(f"importance goes from {low} to {high}")))
    last = log.groupBy("session_id").agg(F.max("turn_index").alias("_last"))
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("timestamp", "note_id"))
    rows = new.withColumns({"importance": fits, "_n": nth}).join(last, "session_id", "left")
    return rows.select("note_id", "session_id", "content", "importance", (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("int").alias("turn_index"), "timestamp")


def active(log: DataFrame, most: int = ACTIVE) -> DataFrame:
    """The log's rows in each session's working set, with ``current``: importance decayed by the turns since.

    The newest note can't be the one that is dropped, which the order alone ensures from a size on: there the oldest of
    ``most`` notes scores less than any new one. Smaller sizes raise."""
    low, high = IMPORTANCE
    least = math.ceil(math.log(high / low) / -math.log(DECAY)) + 1
    if most < least:
        raise ValueError(f"the working set must hold {least} notes or more")
    # Logarithms order notes of any age; the powers themselves underflow after some thousand turns.
    order = F.log(F.col("importance").cast("double")) - F.col("turn_index") * F.lit(math.log(DECAY))
    session = Window.partitionBy("session_id")
    place = F.row_number().over(session.orderBy(order.desc(), "note_id"))
    best = log.withColumns({"_last": F.max("turn_index").over(session), "_place": place}).where(F.col("_place") <= most)
    return best.withColumn("current", F.col("importance") * F.pow(F.lit(DECAY), F.col("_last") - F.col("turn_index"))).drop("_last", "_place")


def recent(notes: DataFrame, limit: int = 10) -> DataFrame:
    """A session's latest notes first."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("turn_index").desc(), "note_id"))
    return notes.withColumn("pick", place).where(F.col("pick") <= limit)


def relevant(notes: DataFrame, query: str, text, embedder: Callable[[list[str]], np.ndarray], top_k: int = 5) -> DataFrame:
    """note_id, pick: one session's active notes by words and meaning (rank fusion) times current importance, diversified.
    ``text`` is the column of words that is searched."""
    spark = notes.sparkSession
    one = spark.createDataFrame([(0, query)], "query_id int, query string")
    asked = spark.createDataFrame([(0, [float(x) for x in embedder([query])[0]])], "query_id int, qv array<double>")
    keyed = notes.select(F.col("note_id").alias("id"), F.xxhash64("content").cast("string").alias("content_hash"), "content", text.alias("words"), "current")
    nothing = spark.createDataFrame([], f"id {dict(keyed.dtypes)['id']}, content_hash string, embedding array<double>")
    vectors = ranking.embed_missing(keyed.select("id", "content_hash", F.col("content").alias("text")), nothing, embedder)
    lists = [ranking.bm25(keyed, one, id_col="id", text=F.col("words"), top_k=ACTIVE), ranking.nearest(vectors, asked, id_col="id", vector="embedding", top_k=ACTIVE)]
    fused = ranking.fuse(lists, top_k=ACTIVE).select("query_id", "id", "score")
    scored = fused.join(keyed.select("id", "current"), "id").join(vectors.select("id", F.col("embedding").alias("vector")), "id")
    picked = ranking.mmr(scored.select("query_id", "id", (F.col("score") * F.col("current")).alias("relevance"), "vector"), top_k)
    return picked.select(F.col("id").alias("note_id"), "pick")
