"""Graph queries over transitions between the users of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.vectors import jaccard  # noqa: F401  (part of the operator set)
from tessera.operators import graphs as g
from tessera.plans.tables import TRANSITIONS, edges_and_nodes, table, transitions


def edge_build(spark, d):
    return g.merged_edges(transitions(spark, d))


def _starts(spark, n=3):
    return spark.range(n).select(F.col("id").alias("start"))


def bfs_depth2(spark, d):
    """Reached nodes by direction and depth, and typed, from three starts."""
    edges, _ = edges_and_nodes(spark, d)
    out = None
    for direction, kind in (("out", None), ("in", None), ("both", None), ("out", "click")):
        part = g.reach(edges, _starts(spark), 2, direction, kind).groupBy("start", "depth").agg(F.count(F.lit(1)).alias("n"), F.sum("node").alias("sum_nodes")).withColumn("mode", F.lit(f"{direction}:{kind or 'any'}"))
        out = part if out is None else out.unionByName(part)
    return out


def _bfs_sql(mode: str, steps: str) -> str:
    return f"""SELECT '{mode}' AS mode, start, CAST(depth AS INTEGER) AS depth, count(*) AS n, CAST(sum(node) AS BIGINT) AS sum_nodes FROM (
SELECT start, node, min(depth) AS depth FROM (
  SELECT s.start, s.start AS node, 0 AS depth FROM starts s
  UNION ALL SELECT s.start, e.b, 1 FROM starts s JOIN ({steps}) e ON e.a = s.start
  UNION ALL SELECT s.start, f.b, 2 FROM starts s JOIN ({steps}) e ON e.a = s.start JOIN ({steps}) f ON f.a = e.b) GROUP BY start, node) WHERE depth > 0 GROUP BY start, depth"""


_OUT, _IN = "SELECT src AS a, dst AS b FROM edges", "SELECT dst AS a, src AS b FROM edges"
BFS = f"""WITH {TRANSITIONS}, starts AS (SELECT unnest([0, 1, 2])::BIGINT AS start)
{_bfs_sql("out:any", _OUT)} UNION ALL {_bfs_sql("in:any", _IN)} UNION ALL {_bfs_sql("both:any", _OUT + " UNION " + _IN)} UNION ALL {_bfs_sql("out:click", _OUT + " WHERE edge_type = 'click'")}"""


def pagerank_20(spark, d):
    edges, nodes = edges_and_nodes(spark, d)
    scores, _ = g.pagerank(edges, nodes, rounds=20)
    return scores.select("id", F.round("pr", 8).alias("pr"))


def _pagerank_sql(rounds: int, edges: str, nodes: str, base: str, name: str) -> str:
    """Power iteration as a chain of views."""
    out = f"""{name}w AS (SELECT src, dst, weight::DOUBLE / sum(weight) OVER (PARTITION BY src) AS share FROM {edges}),
{name}l AS (SELECT id FROM {nodes} WHERE id NOT IN (SELECT src FROM {edges})),
{name}0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM {nodes}) AS pr FROM {nodes})"""
    for k in range(rounds):
        out += f""",
{name}{k + 1} AS MATERIALIZED (SELECT b.id, 0.85 * (coalesce(m.got, 0) + coalesce((SELECT sum(pr) FROM {name}{k} WHERE id IN (SELECT id FROM {name}l)), 0) * b.p) + 0.15 * b.p AS pr
  FROM {base} b LEFT JOIN (SELECT dst, sum(pr * share) AS got FROM {name}{k} JOIN {name}w ON id = src GROUP BY dst) m ON m.dst = b.id)"""
    return out


_UNIFORM = "base AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS p FROM nodes)"
PAGERANK = f"WITH {TRANSITIONS}, {_UNIFORM}, {_pagerank_sql(20, 'edges', 'nodes', 'base', 'p')}"


def personalized_pagerank(spark, d):
    """Restarts at users 0 to 4 within three steps, ten rounds; elsewhere the share that PageRank gives."""
    edges, nodes = edges_and_nodes(spark, d)
    seeds = nodes.where("id < 5").withColumn("p", F.lit(0.2))
    scores, _ = g.pagerank(edges, nodes, rounds=10, restart=seeds)
    return scores.select("id", F.round("pr", 8).alias("pr"))


PPR = f"""WITH {TRANSITIONS}, base AS (SELECT id, CASE WHEN id < 5 THEN 1.0::DOUBLE / (SELECT count(*) FROM nodes WHERE id < 5) ELSE 0 END AS p FROM nodes), {_pagerank_sql(10, 'edges', 'nodes', 'base', 'p')}
SELECT id, round(pr, 8) AS pr FROM p10"""


def hub_outliers(spark, d):
    edges, nodes = edges_and_nodes(spark, d)
    scores, _ = g.pagerank(edges, nodes, rounds=20)
    return g.hubs(scores).select("id", F.round("pr", 8).alias("pr"))


def impact_report(spark, d):
    edges, nodes = edges_and_nodes(spark, d)
    return g.impact(edges, nodes.where("id % 20 = 0").select(F.col("id").alias("start")))


IMPACT = f"""WITH {TRANSITIONS}, s AS (SELECT id AS start FROM nodes WHERE id % 20 = 0),
one AS (SELECT DISTINCT start, src AS node FROM s JOIN edges ON dst = start WHERE src <> start),
two AS (SELECT DISTINCT start, e.src AS node FROM one JOIN edges e ON e.dst = one.node WHERE e.src <> start),
r AS (SELECT start, node, min(depth) AS depth FROM (SELECT start, node, 1 AS depth FROM one UNION ALL SELECT start, node, 2 FROM two) GROUP BY start, node)
SELECT s.start, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth = 2) AS transitive FROM s LEFT JOIN r ON r.start = s.start GROUP BY s.start"""


def untested_high_impact(spark, d):
    """Nodes that no repeated 'purchase' edge enters, with how many nodes depend on them within two steps."""
    edges, nodes = edges_and_nodes(spark, d)
    untested = nodes.join(edges.where("edge_type = 'purchase' and weight > 1").select(F.col("dst").alias("id")), "id", "left_anti")
    scored = g.impact(edges, untested.select(F.col("id").alias("start"))).select(F.col("start").alias("id"), (F.col("direct") + F.col("transitive")).alias("impact"))
    return g.capped(scored.where("impact > 0"), F.col("impact").desc(), F.col("id"))


UNTESTED = f"""WITH {TRANSITIONS}, s AS (SELECT id AS start FROM nodes WHERE id NOT IN (SELECT dst FROM edges WHERE edge_type = 'purchase' AND weight > 1)),
one AS (SELECT DISTINCT start, src AS node FROM s JOIN edges ON dst = start WHERE src <> start),
two AS (SELECT DISTINCT start, e.src AS node FROM one JOIN edges e ON e.dst = one.node WHERE e.src <> start),
r AS (SELECT start AS id, count(*) AS impact FROM (SELECT start, node FROM one UNION SELECT start, node FROM two) GROUP BY start)
SELECT id, impact, (SELECT count(*) FROM r) AS total FROM r ORDER BY impact DESC, id LIMIT 30"""


def zero_in_degree(spark, d):
    """Suppliers and parts as a graph: suppliers lead to the parts they ship; nothing leads to a supplier."""
    l = table(spark, d, "lineitem")  # noqa: E741
    edges = l.select((F.col("l_suppkey") + 10_000_000).alias("src"), F.col("l_partkey").alias("dst")).distinct()
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return g.unreferenced(nodes, edges)


def scc_members(spark, d):
    first = transitions(spark, d).select("src", "dst")
    return g.cycle_members(first).select("id")


SCC = f"""WITH RECURSIVE {TRANSITIONS}, e AS (SELECT DISTINCT src, dst FROM calls WHERE src <> dst),
r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
SELECT a AS id FROM r WHERE a = b"""


def capped_with_total(spark, d):
    edges, nodes = edges_and_nodes(spark, d)
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("calls"))
    return g.capped(degree, F.col("calls").desc(), F.col("id"), limit=10)


def cluster_align_jaccard(spark, d):
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    new = vectors.select(F.col("label").alias("cluster"), F.col("vec_id").alias("member"))
    old = docs.select(F.col("lang").alias("cluster"), F.col("doc_id").alias("member"))
    return g.aligned_clusters(new, old).select("new", "old", F.round("jaccard", 8).alias("jaccard"))


ALIGN = """WITH b AS (SELECT label AS new, lang AS old, count(*) AS shared FROM embeddings JOIN documents ON vec_id = doc_id GROUP BY ALL),
n AS (SELECT label AS new, count(*) AS nn FROM embeddings GROUP BY ALL), o AS (SELECT lang AS old, count(*) AS no FROM documents GROUP BY ALL),
s AS (SELECT new, old, shared / (nn + no - shared) AS jaccard FROM b JOIN n USING (new) JOIN o USING (old)),
r AS (SELECT *, row_number() OVER (PARTITION BY new ORDER BY jaccard DESC, old) AS k FROM s)
SELECT n.new, r.old, round(r.jaccard, 8) AS jaccard FROM n LEFT JOIN r ON r.new = n.new AND k = 1"""


def argmax_per_cluster(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("lang").agg(F.max(F.struct("n_chars", "doc_id"))["doc_id"].alias("top_id"), F.count(F.lit(1)).alias("member_count"))


def graph_clusters(spark, d):
    """Louvain communities at both resolutions."""
    edges, nodes = edges_and_nodes(spark, d)
    return g.clusters(edges, nodes)


QUERIES = {f.__name__: f for f in (edge_build, bfs_depth2, pagerank_20, personalized_pagerank, hub_outliers, impact_report, untested_high_impact, zero_in_degree, scc_members, capped_with_total, cluster_align_jaccard, argmax_per_cluster, graph_clusters)}

ORACLES = {
    "edge_build": f"WITH {TRANSITIONS} SELECT src, dst, edge_type, weight FROM edges",
    "bfs_depth2": BFS,
    "pagerank_20": f"{PAGERANK} SELECT id, round(pr, 8) AS pr FROM p20",
    "personalized_pagerank": PPR,
    "hub_outliers": f"{PAGERANK} SELECT id, round(pr, 8) AS pr FROM p20 WHERE pr > (SELECT avg(pr) + stddev_pop(pr) FROM p20)",
    "impact_report": IMPACT,
    "untested_high_impact": UNTESTED,
    "zero_in_degree": "WITH e AS (SELECT DISTINCT l_suppkey + 10000000 AS src, l_partkey AS dst FROM lineitem) SELECT DISTINCT src AS id FROM e WHERE src NOT IN (SELECT dst FROM e)",
    "scc_members": SCC,
    "capped_with_total": f"WITH {TRANSITIONS} SELECT src AS id, CAST(sum(weight) AS BIGINT) AS calls, count(*) OVER () AS total FROM edges GROUP BY src ORDER BY calls DESC, id LIMIT 10",
    "cluster_align_jaccard": ALIGN,
    "argmax_per_cluster": "SELECT lang, max_by(doc_id, (n_chars, doc_id)) AS top_id, count(*) AS member_count FROM documents GROUP BY lang",
}
