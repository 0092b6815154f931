"""The build ledger: tracked symbols with what they depend on, whether a test covers them, and statuses that go stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.governor import refreshed_ledger

#: Statuses that may be set; ``stale`` is only ever reached from ``done``.
SETTABLE = ("planned", "in_progress", "done")
ENTRY = "symbol_id string, status string, depends_on array<string>, has_test boolean, content_hash_at_done string, note string, updated_at double"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ENTRY)


def applied(ledger: DataFrame, changes: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """The ledger after ``changes`` (symbol_id, status, note, at), the latest of a symbol last (ties by status).

    A new entry takes its dependencies (direct calls, sorted) and test from ``edges``; a known one keeps those. The hash is
    the symbol's (null if unknown) if any of the changes sets ``done``; the note is the latest that isn't null. A status
    that may not be set raises. symbols: (id, content_hash)."""
    ok = F.when(F.col("status").isin(*SETTABLE), F.col("status")).otherwise(F.raise_error(F.format_string("status %s can't be set", "status")))
    new = changes.select("symbol_id", ok.alias("status"), "note", "at").groupBy("symbol_id").agg(
        F.max_by("status", F.struct("at", "status")).alias("_status"),
        F.max_by("note", F.when(F.col("note").isNotNull(), F.struct("at", "note"))).alias("_note"),
        F.bool_or(F.col("status") == "done").alias("_done"),
        F.max("at").cast("double").alias("_at"),
    )
    edges = edges.where("src <> dst")
    calls = edges.where("edge_type = 'CALLS'").join(new.select(F.col("symbol_id").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("symbol_id")).agg(F.sort_array(F.collect_set("dst")).alias("_calls"))
    tested = edges.where("edge_type = 'TESTS'").select(F.col("dst").alias("symbol_id"), F.lit(True).alias("_tested")).distinct()
    now = symbols.select(F.col("id").alias("symbol_id"), F.col("content_hash").alias("_now"))
    fresh = new.join(calls, "symbol_id", "left").join(tested, "symbol_id", "left").join(now, "symbol_id", "left")
    both = ledger.withColumn("_known", F.lit(True)).join(fresh, "symbol_id", "full")
    known, changed = F.coalesce("_known", F.lit(False)), F.col("_status").isNotNull()
    none = F.array().cast(dict(ledger.dtypes)["depends_on"])
    values = {
        "status": F.coalesce("_status", "status"),
        "depends_on": F.when(known, F.col("depends_on")).otherwise(F.coalesce("_calls", none)),
        "has_test": F.when(known, F.col("has_test")).otherwise(F.coalesce("_tested", F.lit(False))),
        "content_hash_at_done": F.when(changed & F.col("_done"), F.col("_now")).otherwise(F.col("content_hash_at_done")),
        "note": F.coalesce("_note", "note"),
        "updated_at": F.coalesce("_at", "updated_at"),
    }
    return both.select("symbol_id", *[v.alias(c) for c, v in values.items()])


def listed(ledger: DataFrame, symbols: DataFrame, edges: DataFrame, status: str | None = None) -> DataFrame:
    """Entries by symbol after what has changed went stale, all or those of a status."""
    out = refreshed_ledger(ledger, symbols, edges)
    return (out if status is None else out.where(F.col("status") == status)).orderBy("symbol_id")
