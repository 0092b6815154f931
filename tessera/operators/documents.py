"""The context document: convention facts, architecture entries, selection within a budget, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import token_estimate
from tessera.operators.ranking import knapsack

# Fixed values.
LEAST_CONFIDENCE, DOCUMENT_BUDGET = 0.7, 1500


def ratio(a, b):
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def architecture(clusters: DataFrame, scores: DataFrame, symbols: DataFrame) -> DataFrame:
    """(cluster, representative, member_count): the member of highest (pr, id) of each coarse cluster."""
    rows = clusters.where("level = 'coarse'").join(scores.select(F.col("id").alias("member"), "pr"), "member")
    top = rows.groupBy("cluster").agg(F.max(F.struct("pr", "member"))["member"].alias("id"), F.count(F.lit(1)).alias("member_count"))
    return top.join(symbols.select("id", "qualified_name"), "id").select("cluster", F.col("qualified_name").alias("representative"), "member_count")


def within_budget(entries: DataFrame, budget: int = DOCUMENT_BUDGET) -> DataFrame:
    """(text, confidence) entries at or above the least confidence that fit."""
    rows = entries.where(F.col("confidence") >= LEAST_CONFIDENCE).select(F.lit(0).alias("query_id"), F.col("text").alias("id"), F.col("confidence").alias("relevance"), token_estimate(F.col("text")).alias("cost"), F.col("text").alias("pos"))
    return knapsack(rows, budget).select(F.col("id").alias("text"), F.col("relevance").alias("confidence"))


def input_hash(entries: DataFrame) -> DataFrame:
    """One row (hash) that changes only when an entry does; confidences count to six places."""
    one = F.to_json(F.array_sort(F.collect_list(F.struct("text", F.round("confidence", 6).alias("confidence")))))
    return entries.agg(F.sha2(one, 256).alias("hash"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, change) of conventions (kind, text): added, removed or changed."""
    o, n = old.select("kind", F.col("text").alias("was")), new.select("kind", F.col("text").alias("now"))
    say = F.when(F.col("was").isNull(), F.concat(F.lit("added: "), "now")).when(F.col("now").isNull(), F.concat(F.lit("removed: "), "was")).when(F.col("was") != F.col("now"), F.concat("was", F.lit(" -> "), "now"))
    return o.join(n, "kind", "full_outer").select("kind", say.alias("change")).where("change is not null")


def render(sections: dict[str, list[str]]) -> str:
    """Markdown; empty sections are left out."""
    return "\n".join(f"## {name}\n" + "\n".join(f"- {x}" for x in lines) + "\n" for name, lines in sections.items() if lines)
