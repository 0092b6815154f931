"""Retrieval strategies measured on tasks mined from a repository's history, each on the index of the commit before its own.

There are at most ``most`` tasks; the driver takes them one after another, and files and embeddings of one index carry over
to the next, so only what differs between the commits is parsed and encoded."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import api
from tessera.functions import text as tx
from tessera.operators import evaluation, governor, graphs, learning, mining, ranking
from tessera.operators.lineage import checkpointed
from tessera.sources import history

Embedder = Callable[[list[str]], np.ndarray]
Cost = Callable[[Column], Column]


@dataclass
class Snapshot:
    """A commit's Python files (path, text), its index, and each symbol's (id, file_path, byte_start, text, cost)."""

    files: DataFrame
    index: api.Index
    symbols: DataFrame


def snapshot(spark: SparkSession, repo: str, ref: str, embedder: Embedder | None = None, before: Snapshot | None = None, cost: Cost = tx.token_estimate) -> Snapshot:
    """The index of a commit's files; those that ``before`` has too are not parsed or encoded again."""
    files = checkpointed(history.blobs(spark, repo, ref))
    index = api.build(spark, files, embedder, before and before.index.embeddings, before and before.index.facts)
    s = index.code.symbols.join(files.withColumnRenamed("path", "file_path"), "file_path")
    s = s.withColumn("text", F.expr("CAST(substring(content, byte_start + 1, byte_end - byte_start) AS STRING)"))
    priced = s.select("id", "parent_id", "file_path", "byte_start", "text", cost(F.col("text")).alias("own_cost"), cost(tx.discovery_text(F.col("signature"), F.col("docstring"))).alias("discovery_cost"))
    costs = governor.marginal_costs(priced.select("id", "parent_id", "own_cost", "discovery_cost"))
    symbols = priced.join(costs.select("id", F.col("served_cost").alias("cost")), "id").select("id", "file_path", "byte_start", "text", "cost")
    return Snapshot(files.select("path", F.col("content").cast("string").alias("text")), index, checkpointed(symbols))


def mined(spark: SparkSession, repo: str, most: int = 50, **options) -> DataFrame:
    """sha, parent, description, committed_at, truth_ids, truth_files, new_symbols_added of the newest usable commits that
    change Python files which were there before."""
    usable = history.commits(spark, repo, **options).where(history.qualifies())
    rows = checkpointed(usable.where(F.exists("files", lambda f: f.endswith(".py"))))
    tasks = history.tasks(rows, history.symbols_before(rows, repo)).where(F.size("truth_files") > 0)
    parents = rows.select("sha", F.col("parents")[0].alias("parent"))
    return history.newest_first(tasks.join(parents, "sha"), most)


def churn_before(spark: SparkSession, repo: str, at: Snapshot, ref: str) -> DataFrame:
    """(id, churn) as of ``ref``: nothing after that commit counts, nor does time."""
    rows = history.commits(spark, repo, ref=ref).where(F.size("parents") == 1)
    now = rows.agg(F.max("committed_at")).first()[0] or 0.0
    touches = history.touched(history.hunks(rows), at.index.code.symbols).join(rows.select("sha", "committed_at"), "sha")
    return at.index.churn(touches, now)


@dataclass
class Retrieved:
    """Symbols in order (id, rank) and the texts that were read for them (pos, text)."""

    symbols: DataFrame
    texts: DataFrame


def _of_files(at: Snapshot, files: DataFrame) -> Retrieved:
    """files: (path, rank)."""
    placed = at.symbols.join(files.withColumnRenamed("rank", "_r"), F.col("file_path") == F.col("path"))
    ids = placed.select("id", F.row_number().over(Window.orderBy("_r", "byte_start")).alias("rank"))
    return Retrieved(ids, at.files.join(files, "path").select(F.col("rank").alias("pos"), "text"))


def _of_symbols(at: Snapshot, ids: DataFrame) -> Retrieved:
    """ids: (id, rank)."""
    return Retrieved(ids.select("id", "rank"), at.symbols.join(ids.select("id", "rank"), "id").select(F.col("rank").alias("pos"), "text"))


def _task(at: Snapshot, query: str) -> DataFrame:
    return at.index.spark.createDataFrame([(0, query)], "query_id int, query string")


def _vector(at: Snapshot, query: str, embedder: Embedder) -> DataFrame:
    return at.index.spark.createDataFrame([(0, [float(x) for x in embedder([query])[0]])], "query_id int, qv array<double>")


def whole_files(at: Snapshot, query: str) -> Retrieved:
    return _of_files(at, evaluation.whole_files(_task(at, query), at.files).select(F.col("id").alias("path"), "rank"))


def fixed_chunks(at: Snapshot, query: str, embedder: Embedder) -> Retrieved:
    """The chunks nearest to the query, and the symbols they cover by their best chunk."""
    pieces = evaluation.chunks(at.files).withColumn("id", F.concat_ws(":", "path", "chunk")).withColumn("content_hash", F.sha2("text", 256))
    pieces = checkpointed(pieces)
    none = at.index.spark.createDataFrame([], "id string, content_hash string, embedding array<double>")
    vectors = ranking.embed_missing(pieces.select("id", "content_hash", "text"), none, embedder)
    near = ranking.nearest(vectors, _vector(at, query, embedder), id_col="id", vector="embedding", top_k=evaluation.CHUNKS)
    hits = checkpointed(near.join(pieces, "id").select("query_id", "path", "line_start", "line_end", "score", "rank", "text"))
    covered = evaluation.covered_symbols(hits, at.index.code.symbols)
    ids = covered.select("id", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")).alias("rank"))
    return Retrieved(ids, hits.select(F.col("rank").alias("pos"), "text"))


def fused(at: Snapshot, query: str, embedder: Embedder | None = None, *, personal: bool = True, churn: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, rank, lexical_score, semantic_score: both pools with PageRank, restarted at the candidates or
    static, and churn if given."""
    s = at.index.code.symbols
    text = tx.document_text(F.col("name"), F.col("qualified_name"), F.col("signature"), F.col("docstring"), F.col("decorators"))
    pools = [checkpointed(ranking.bm25(s, _task(at, query), id_col="id", text=text))]
    if embedder is not None and at.index.embeddings is not None:
        pools.append(checkpointed(ranking.nearest(at.index.embeddings, _vector(at, query, embedder), id_col="id", vector="embedding")))
    ids = [p.select("id") for p in pools]
    central = _restarted(at, ids[0] if len(ids) == 1 else ids[0].union(ids[1])) if personal else at.index.scores
    signals = [central.select("id", F.col("pr").alias("value"))] + ([] if churn is None else [churn.select("id", F.col("churn").alias("value"))])
    semantic = F.col("c1") if len(pools) == 2 else F.lit(0.0)
    return checkpointed(ranking.fuse(pools, signals).select("query_id", "id", "score", "rank", F.col("c0").alias("lexical_score"), semantic.alias("semantic_score")))


def _restarted(at: Snapshot, seeds: DataFrame) -> DataFrame:
    return graphs.personalised_pagerank(at.index.edges, at.index.code.symbols.select("id"), at.index.scores, seeds)


def learned(at: Snapshot, ranked: DataFrame, ranker: learning.Ranker) -> DataFrame:
    """``ranked`` (of ``fused``) by the model's probability instead; as it was while nothing is trained."""
    if not ranker.is_trained:
        return ranked
    central = ranked.join(_restarted(at, ranked.select("id")), "id", "left")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("pr", F.lit(0.0)).desc(), "id"))
    judged = ranker.predict(central.withColumn("centrality_score", ranking.reciprocal(place)))
    order = Window.partitionBy("query_id").orderBy(F.col("probability").desc(), "id")
    return judged.select("query_id", "id", F.col("probability").alias("score"), F.row_number().over(order).alias("rank"))


def governed(at: Snapshot, ranked: DataFrame, budget: int = governor.BUDGET) -> Retrieved:
    return _of_symbols(at, evaluation.governed(ranked, at.symbols, budget))


def measured(found: Retrieved, truth: list[str], cost: Cost = tx.token_estimate) -> DataFrame:
    """(metric, value) of one strategy on one task; recall is null without truth."""
    in_order = lambda df, key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    got = found.symbols.agg(in_order(found.symbols, "rank", "id").alias("got"))
    read = found.texts.agg(F.array_join(in_order(found.texts, "pos", "text"), "\n").alias("read")).select(cost(F.col("read")).cast("double").alias("tokens"))
    wanted = F.array(*map(F.lit, truth)) if truth else F.array().cast("array<string>")
    values = [F.struct(F.lit(f"recall@{k}").alias("metric"), mining.recall_at(F.col("got"), wanted, k).cast("double").alias("value")) for k in evaluation.RECALL_AT]
    return got.crossJoin(read).select(F.explode(F.array(*values, F.struct(F.lit("tokens").alias("metric"), F.col("tokens").alias("value")))).alias("v")).select("v.*")


def run(spark: SparkSession, repo: str, embedder: Embedder | None = None, *, most: int = 50, ranker: learning.Ranker | None = None, cost: Cost = tx.token_estimate, budget: int = governor.BUDGET) -> DataFrame:
    """(condition, strategy, sha, metric, value). Conditions: ``oracle`` (the right files against the right symbols),
    ``end_to_end``, the ablations ``personal_pagerank`` and ``churn``, and ``learned_ranker`` if one is given."""
    out = spark.createDataFrame([], "condition string, strategy string, sha string, metric string, value double")
    at = None
    for t in mined(spark, repo, most).collect():
        at = snapshot(spark, repo, t["parent"], embedder, at, cost)
        query, truth = t["description"], t["truth_ids"]
        ids = spark.createDataFrame([(x, i) for i, x in enumerate(truth)], "id string, rank int")
        files = spark.createDataFrame([(x, i) for i, x in enumerate(t["truth_files"])], "path string, rank int")
        plain, static = fused(at, query, embedder), fused(at, query, embedder, personal=False)
        found = {("oracle", "whole_files"): _of_files(at, files), ("oracle", "governed"): _of_symbols(at, ids), ("end_to_end", "whole_files"): whole_files(at, query)}
        if embedder is not None:
            found["end_to_end", "fixed_chunks"] = fixed_chunks(at, query, embedder)
        found["end_to_end", "governed"] = found["personal_pagerank", "with"] = found["churn", "without"] = governed(at, plain, budget)
        found["personal_pagerank", "without"] = governed(at, static, budget)
        found["churn", "with"] = governed(at, fused(at, query, embedder, churn=churn_before(spark, repo, at, t["parent"])), budget)
        if ranker is not None:
            found["learned_ranker", "without"], found["learned_ranker", "with"] = found["end_to_end", "governed"], governed(at, learned(at, plain, ranker), budget)
        for (condition, strategy), one in found.items():
            rows = measured(one, truth, cost).select(F.lit(condition).alias("condition"), F.lit(strategy).alias("strategy"), F.lit(t["sha"]).alias("sha"), "metric", "value")
            out = out.unionByName(rows)
        out = checkpointed(out)
    return out


def summary(rows: DataFrame) -> DataFrame:
    """(condition, strategy, metric, mean, median, n, total); tasks without truth don't count towards recall."""
    totals = rows.groupBy("condition", "strategy", "metric").agg(F.sum("value").alias("total"))
    return mining.summary(rows, "value", "condition", "strategy", "metric").join(totals, ["condition", "strategy", "metric"])


def saved(rows: DataFrame, folder: str, stamp: str | None = None) -> str:
    """Writes the summary as JSON lines, one file in a folder named by the time; returns that folder."""
    path = f"{folder}/{stamp or time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}"
    summary(rows).orderBy("condition", "strategy", "metric").coalesce(1).write.json(path)
    return path
