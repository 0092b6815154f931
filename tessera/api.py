"""The engine over one code base: build once, then ask."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import checks, documents, governor, graphs, mining, ranking, resolution
from tessera.operators.lineage import checkpointed
from tessera.sources import python_code, snapshots
from tessera.sources.python_code import Code


@dataclass
class Index:
    """All tables of one version; a rebuild makes a new one, so readers keep theirs."""

    spark: SparkSession
    code: Code
    edges: DataFrame
    unresolved: DataFrame
    scores: DataFrame
    clusters: DataFrame
    test_links: DataFrame
    embeddings: DataFrame | None = None
    facts: DataFrame | None = None

    def list_symbols(self, glob: str = "*", kinds: list[str] | None = None, name: str = "", members: DataFrame | None = None) -> DataFrame:
        out = self.code.symbols.where(F.col("file_path").rlike(tx.glob_to_regex(glob)) & F.lower("qualified_name").contains(name.lower()))
        out = out if kinds is None else out.where(F.col("kind").isin(kinds))
        out = out if members is None else out.join(members.select("id"), "id", "left_semi")
        return out.orderBy("file_path", "byte_start")

    def scope(self, path_prefix: str | None = None, seed: str | None = None) -> DataFrame:
        """(id): symbols under a path, or of the seed's fine cluster (the seed alone if it has none)."""
        if path_prefix is not None:
            return self.code.symbols.where(F.col("file_path").startswith(path_prefix)).select("id")
        own = self.clusters.where((F.col("level") == "fine") & (F.col("member") == seed)).select("cluster")
        found = self.clusters.where("level = 'fine'").join(own, "cluster", "left_semi").select(F.col("member").alias("id"))
        return found.union(self.code.symbols.where(F.col("id") == seed).select("id")).distinct()

    def search(self, query: str, embedder: Callable[[list[str]], np.ndarray] | None = None, *, top_k: int = 10, members: DataFrame | None = None, hard: bool = True, churn: DataFrame | None = None, scorer=ranking.overlap_scorer, extra: str | None = None) -> DataFrame:
        """id, qualified_name, pick: pools of 50, hard scope, fusion to 20, re-ranking, diversity."""
        s, one = self.code.symbols, self.spark.createDataFrame([(0, query)], "query_id int, query string")
        text = tx.document_text(F.col("name"), F.col("qualified_name"), F.col("signature"), F.col("docstring"), F.col("decorators"))
        pools = [ranking.bm25(s, one, id_col="id", text=text)]
        if embedder is not None and self.embeddings is not None:
            for q in [query, *([extra] if extra else [])]:
                v = self.spark.createDataFrame([(0, [float(x) for x in embedder([q])[0]])], "query_id int, qv array<double>")
                pools.append(ranking.nearest(self.embeddings, v, id_col="id", vector="embedding"))
        static = self.scores
        if members is not None and hard:
            pools = [p.join(members.select("id"), "id", "left_semi") for p in pools]
        elif members is not None:
            static = graphs.personalised_pagerank(self.edges, s.select("id"), self.scores, members, seed_mass=graphs.SCOPE_MASS)
        signals = [static.select("id", F.col("pr").alias("value"))] + ([] if churn is None else [churn.select("id", F.col("churn").alias("value"))])
        fused = checkpointed(ranking.fuse(pools, signals))
        again = ranking.rerank(fused.join(s.select("id", text.alias("text")), "id").select("query_id", F.lit(query).alias("query"), "id", "text"), scorer)
        vectors = again.withColumn("vector", F.lit(None).cast("array<double>")) if self.embeddings is None else again.join(self.embeddings.select("id", F.col("embedding").cast("array<double>").alias("vector")), "id", "left")
        picked = ranking.mmr(vectors.select("query_id", "id", F.col("score").alias("relevance"), "vector"), top_k)
        return picked.join(s.select("id", "qualified_name", "file_path"), "id").select("id", "qualified_name", "file_path", "pick").orderBy("pick")

    def expand(self, symbol: str, depth: int = 1, direction: str = "out", edge_type: str | None = None, limit: int = graphs.CAP) -> DataFrame:
        found = graphs.reach(self.edges, self._start(symbol), depth, direction, edge_type)
        rows = found.join(self.scores, F.col("node") == F.col("id")).select("id", "depth", "pr")
        return graphs.capped(rows, F.col("pr").desc(), F.col("id"), limit=limit)

    def impact(self, symbol: str) -> DataFrame:
        return graphs.impact(self.edges, self._start(symbol))

    def _start(self, symbol: str) -> DataFrame:
        return self.spark.createDataFrame([(symbol,)], "start string")

    def smells(self, category: str | None = None) -> DataFrame:
        return checks.worst_first(checks.code_smells(self.code, self.edges, self.unresolved, self.scores, category))

    def dead_code(self) -> DataFrame:
        return checks.dead_code(self.code, self.edges)

    def duplicates(self, threshold: float = 0.9) -> DataFrame:
        """(a, b, similarity) of like symbols in different files, without pairs of which one calls or inherits the other;
        empty without embeddings."""
        if self.embeddings is None:
            return self.spark.createDataFrame([], "a string, b string, similarity double")
        placed = self.embeddings.join(self.code.symbols.select("id", "file_path"), "id")
        direct = self.edges.where(F.col("edge_type").isin("CALLS", "INHERITS")).select("src", "dst")
        found = ranking.similar_pairs(placed, id_col="id", vector="embedding", group_col="file_path", threshold=threshold, edges=direct)
        return found.orderBy(F.col("similarity").desc(), "a", "b")

    def check(self, limit: int = 20) -> DataFrame:
        """(check, total, findings): the checks that need nothing but the code, the first ``limit`` findings of each."""
        dead = self.dead_code().select(F.lit("dead_code").alias("check"), F.concat_ws("::", "file_path", "qualified_name").alias("text"), F.lit(0.0).alias("order"))
        name = lambda end: self.code.symbols.select(F.col("id").alias(end), F.col("qualified_name").alias(f"{end}_name"))
        pairs = self.duplicates().join(name("a"), "a").join(name("b"), "b")
        twins = pairs.select(F.lit("duplicates").alias("check"), F.format_string("%s <-> %s (%.3f)", "a_name", "b_name", "similarity").alias("text"), (-F.col("similarity")).alias("order"))
        place = Window.partitionBy("check").orderBy("order", "text")
        rows = dead.unionByName(twins).withColumns({"n": F.row_number().over(place), "total": F.count(F.lit(1)).over(Window.partitionBy("check"))}).where(F.col("n") <= limit)
        lists = rows.groupBy("check").agg(F.max("total").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("findings"))
        names = self.spark.createDataFrame([("dead_code",), ("duplicates",)], "check string")
        return names.join(lists, "check", "left").select("check", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("findings", F.array().cast("array<string>")).alias("findings"))

    def untested(self) -> DataFrame:
        bare = self.code.symbols.where(~tx.is_test_file(F.col("file_path"))).select("id").join(self.edges.where("edge_type = 'TESTS'").select(F.col("dst").alias("id")), "id", "left_anti")
        found = graphs.impact(self.edges, bare.select(F.col("id").alias("start"))).select(F.col("start").alias("id"), (F.col("direct") + F.col("transitive")).alias("impact")).where("impact > 0")
        return graphs.capped(found, F.col("impact").desc(), F.col("id"))

    def architecture(self) -> DataFrame:
        return documents.architecture(self.clusters, self.scores, self.code.symbols)

    def costs(self) -> DataFrame:
        """Token costs by symbol, of its own source and of its discovery text."""
        files = self.code.symbols.select("id", "parent_id", tx.token_estimate(tx.discovery_text(F.col("signature"), F.col("docstring"))).alias("discovery_cost"), ((F.col("byte_end") - F.col("byte_start")) / 4).cast("long").alias("own_cost"))
        return governor.marginal_costs(files)

    def status(self) -> DataFrame:
        return self.code.symbols.agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("file_path").alias("files"), F.sort_array(F.collect_set("language")).alias("languages"))

    def graph_export(self) -> tuple[DataFrame, DataFrame]:
        """(nodes with score, edges) for display."""
        nodes = self.code.symbols.select("id", "qualified_name", "kind", tx.module_of(F.col("file_path")).alias("module")).join(self.scores, "id", "left")
        return nodes, self.edges.select("src", "dst", "edge_type", "weight")

    def modules(self) -> DataFrame:
        return self.code.symbols.groupBy(tx.module_of(F.col("file_path")).alias("module")).agg(F.count(F.lit(1)).alias("symbols"))

    def by_file(self, symbols: DataFrame) -> DataFrame:
        """(file_path, n, symbols): the compact shape of a listing, files in order."""
        one = F.struct("line_start", "id", "qualified_name", "kind")
        return symbols.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(one)).alias("symbols")).orderBy("file_path")

    def debug_seeds(self, query: str, depth: int = 1) -> DataFrame:
        """(id): what the symbol that a debugging query names leads to; nothing for other queries."""
        q = self.spark.createDataFrame([(query,)], "q string").select(tx.intent(F.col("q")).alias("intent"), tx.symbol_reference(F.col("q")).alias("reference")).where("intent = 'debug' and reference is not null")
        start = self.code.symbols.join(F.broadcast(q), (F.col("qualified_name") == F.col("reference")) | (F.col("name") == F.col("reference"))).select(F.col("id").alias("start"))
        return graphs.reach(self.edges, start, depth).select(F.col("node").alias("id")).distinct()

    def related(self, suggestions: DataFrame, symbol: str, limit: int = 5) -> DataFrame:
        """The first suggestions (a, b, confidence, support) of a symbol; unknown ids fall out after the cut."""
        top = suggestions.where(F.col("a") == symbol).orderBy(F.col("confidence").desc(), "b").limit(limit)
        return top.join(self.code.symbols.select(F.col("id").alias("b"), "qualified_name"), "b").select(F.col("b").alias("id"), "qualified_name", "confidence", "support")

    def source(self, symbol: str, files: DataFrame, session: governor.Session, relevance: float = 1.0) -> dict:
        """A symbol's source under a session's budget: members' signatures instead of a costly class; redacted; the parent's
        signature comes first, once a session. Raises KeyError for an unknown id."""
        row = self.code.symbols.where(F.col("id") == symbol).join(files.select(F.col("path").alias("file_path"), "content"), "file_path").first()
        if row is None:
            raise KeyError(symbol)
        text = bytes(row["content"])[row["byte_start"] : row["byte_end"]].decode("utf-8", "replace")
        members = [r["signature"] for r in self.code.symbols.where(F.col("parent_id") == symbol).orderBy("byte_start").select("signature").collect()]
        parent = self.code.symbols.where(F.col("id") == row["parent_id"]).select("id", "signature", "docstring").first() if row["parent_id"] else None
        lead = "" if parent is None else "\n".join(filter(None, [parent["signature"], parent["docstring"]]))
        texts = self.spark.createDataFrame([(text, lead, "\n".join([row["signature"], *members]))], "own string, lead string, brief string")
        cost = texts.select(*[tx.token_estimate(F.col(c)).alias(c) for c in texts.columns], tx.redact(F.col("own")).alias("clean")).first()
        brief = bool(members) and cost["own"] > governor.DECOMPOSE
        owed = cost["brief"] if brief else session.marginal(cost["own"], None if parent is None else parent["id"], cost["lead"])
        got = session.request([(symbol, relevance, int(owed))])
        if symbol in got["denied"]:
            return {"id": symbol, "denied": True, "cost": owed, "evicted": got["evicted"]}
        if brief:
            return {"id": symbol, "denied": False, "signatures": [row["signature"], *members], "evicted": got["evicted"]}
        fresh = parent is not None and parent["id"] not in session.shared
        if fresh:
            session.shared.add(parent["id"])
        return {"id": symbol, "denied": False, "source": (lead + "\n" if fresh else "") + cost["clean"], "redacted": cost["clean"] != text, "evicted": got["evicted"]}

    def conventions(self) -> DataFrame:
        """(kind, text, confidence) of what the code base mostly does."""
        errors = checks.error_handling(self.code).select(F.lit("error_handling").alias("kind"), F.col("pattern").alias("text"), documents.ratio(F.col("n"), F.col("total")).alias("confidence"))
        d = checks.docstrings(self.code)
        docs = d.select(F.lit("docstrings").alias("kind"), F.concat(F.col("dominant_style"), F.lit(" docstrings")).alias("text"), documents.ratio(F.col("dominant_count"), F.col("documented")).alias("confidence"))
        i = checks.import_style(self.code)
        imports = i.select(F.lit("imports").alias("kind"), F.concat(F.col("dominant"), F.lit(" imports")).alias("text"), documents.ratio(F.greatest("relative", "absolute"), F.col("relative") + F.col("absolute")).alias("confidence"))
        return errors.unionByName(docs).unionByName(imports)

    def context_document(self, previous_hash: str | None = None) -> tuple[str | None, str]:
        """(markdown, hash); no document where nothing changed since ``previous_hash``."""
        facts = self.conventions()
        parts = self.architecture().select(F.lit("architecture").alias("kind"), F.format_string("%s leads %d symbols", "representative", "member_count").alias("text"), F.lit(1.0).alias("confidence"))
        entries = facts.unionByName(parts)
        now = documents.input_hash(entries).first()["hash"]
        if now == previous_hash:
            return None, now
        kept = entries.join(documents.within_budget(entries).select("text"), "text", "left_semi").orderBy("kind", "text").collect()
        sections: dict[str, list[str]] = {}
        for r in kept:
            sections.setdefault(r["kind"].replace("_", " ").capitalize(), []).append(r["text"])
        return documents.render(sections), now

    def report(self) -> DataFrame:
        """One row of JSON: worst smells, dead code and untested symbols."""
        as_json = lambda df, name: df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias(name))
        return as_json(self.smells(), "smells").crossJoin(as_json(self.dead_code().limit(graphs.CAP), "dead_code")).crossJoin(as_json(self.untested(), "untested"))

    def static_analysis(self, limit: int = 30, **drift: DataFrame | None) -> str:
        """JSON of dead code, duplicates and each kind of drift (key, kind): totals and the first ``limit`` findings; null for a
        kind whose other side isn't there."""
        out = {r["check"]: {"total": r["total"], "findings": r["findings"]} for r in self.check(limit).collect()}
        for name, found in drift.items():
            out[name] = None
            if found is not None:
                key = found.columns[0]
                out[name] = {"total": found.count(), "findings": [f"{r[key]} ({r['kind']})" for r in found.orderBy("kind", key).limit(limit).collect()]}
        return json.dumps(out)

    def overview(self) -> str:
        """JSON of the conventions and of the leading parts of the architecture."""
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        return json.dumps({"conventions": rows(self.conventions()), "architecture": rows(self.architecture())}, default=str)

    def churn(self, touches: DataFrame, now: float) -> DataFrame:
        """touches: (id, committed_at), a row for every overlapping hunk."""
        return mining.decayed_sum(touches, self.code.symbols, key="id", days=(F.lit(now) - F.col("committed_at")) / 86400)


#: Parsed files with the hash of what was parsed.
KNOWN = f"{python_code.FACTS}, file_hash string"
#: A change of how files are parsed raises this, and nothing kept by an older version is used again.
VERSION = 1


def parsed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Facts of all ``files`` (path, content): those of ``known`` where path and content are unchanged, else read anew. Paths that are
    gone fall out."""
    now = files.withColumn("file_hash", F.sha2("content", 256))
    kept = known.join(now.select("path", "file_hash"), ["path", "file_hash"], "left_semi")
    new = now.join(known.select("path", "file_hash"), ["path", "file_hash"], "left_anti")
    fresh = python_code.facts(new).join(new.select("path", "file_hash"), "path")
    return kept.unionByName(fresh)


def build(spark: SparkSession, files: DataFrame, embedder: Callable[[list[str]], np.ndarray] | None = None, cache: DataFrame | None = None, known: DataFrame | None = None) -> Index:
    """files: (path, content), a row a path. PageRank and clusters are taken before test links join the graph. Files in ``known`` (``facts`` of
    an earlier index) are not parsed again, symbols in ``cache`` (its ``embeddings``) not encoded again."""
    found = checkpointed(parsed(files, spark.createDataFrame([], KNOWN) if known is None else known))
    code = python_code.tables(found)
    edges, unresolved = resolution.code_graph(code)
    edges, nodes = checkpointed(edges), code.symbols.select("id")
    scores, _ = graphs.pagerank(edges, nodes)
    clusters = graphs.clusters(edges, nodes)
    links = checkpointed(resolution.link_tests(code.symbols, edges))
    vectors = None
    if embedder is not None:
        s = code.symbols.select("id", "content_hash", tx.embedding_text(F.col("qualified_name"), F.col("signature"), F.col("docstring")).alias("text"))
        empty = spark.createDataFrame([], "id string, content_hash string, embedding array<double>")
        vectors = checkpointed(ranking.embed_missing(s, cache if cache is not None else empty, embedder))
    return Index(spark, code, checkpointed(resolution.with_tests(edges, links)), unresolved, checkpointed(scores), clusters, links, vectors, found)


def refreshed(index: Index, files: DataFrame, embedder: Callable[[list[str]], np.ndarray] | None = None) -> Index:
    """The index of ``files`` as they are now: only new and changed files are parsed and encoded; the graph is built anew."""
    return build(index.spark, files, embedder, index.embeddings, index.facts)


def opened(spark: SparkSession, files: DataFrame, folder: str, embedder: Callable[[list[str]], np.ndarray] | None = None, profile: str = "default") -> Index:
    """An index that keeps its parsed files and embeddings below ``folder``, in a part for each version and ``profile`` (the name of
    the embedder): another of either starts from nothing."""
    home = f"{folder}/{VERSION}-{profile}"
    known = snapshots.load(spark, f"{home}/facts", KNOWN)
    cache = snapshots.load(spark, f"{home}/embeddings", "id string, content_hash string, embedding array<double>")
    index = build(spark, files, embedder, cache, known)
    snapshots.save(index.facts, f"{home}/facts")
    if index.embeddings is not None:
        snapshots.save(index.embeddings, f"{home}/embeddings")
    return index
