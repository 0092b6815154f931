"""Retrieval queries: lexical, nearest neighbours, fusion, diversity, budgets, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.vectors import cosine, dot, mean_vectors
from tessera.operators import ranking
from tessera.plans.tables import first_query, table

TOK = "list_transform(list_filter(string_split_regex(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: length(x) >= 2), lambda x: lower(x))"


def tokenize_terms(spark, d):
    words = table(spark, d, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _lexical(spark, d, k=ranking.POOL):
    return ranking.bm25(table(spark, d, "documents"), first_query(spark, d), id_col="doc_id", text=F.col("text"), top_k=k)


def bm25_topk(spark, d):
    return _lexical(spark, d, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


BM25 = f"""dt AS (SELECT doc_id AS id, {TOK.format("text")} AS toks FROM documents),
tf AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(toks) AS token FROM dt) GROUP BY id, token),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM dt),
raw AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT token, count(*) AS df FROM tf GROUP BY token), st),
idf AS (SELECT token, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT item_id AS query_id, unnest({TOK.format("text")}) AS token FROM benchmark WHERE item_id % 20 = 0),
sc AS (SELECT query_id, tf.id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avgdl))), 9) AS score FROM q JOIN tf USING (token) JOIN idf USING (token) JOIN dt ON dt.id = tf.id, st GROUP BY query_id, tf.id),
al AS (SELECT qs.query_id, dt.id, coalesce(score, 0) AS score FROM (SELECT DISTINCT query_id FROM q) qs CROSS JOIN dt LEFT JOIN sc ON sc.query_id = qs.query_id AND sc.id = dt.id),
lex AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM al)"""


def _vector_queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


def _semantic(spark, d, k=ranking.POOL):
    return ranking.nearest(table(spark, d, "embeddings"), _vector_queries(spark, d), id_col="vec_id", vector="embedding", top_k=k)


def knn_topk(spark, d):
    return _semantic(spark, d, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


KNN = """sv AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0),
sem AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM sv)"""


def knn_by_vector(spark, d):
    q = mean_vectors(table(spark, d, "embeddings").where("label is not null"), "label", "embedding").select(F.col("label").cast("long").alias("query_id"), F.col("mean").alias("qv"))
    found = ranking.nearest(table(spark, d, "embeddings"), q, id_col="vec_id", vector="embedding", top_k=5)
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


def _static(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 97).cast("double").alias("value"))


def _churn(spark, d):
    return table(spark, d, "documents").where("n_chars % 3 = 0").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 13).cast("double").alias("value"))


def rrf_fusion(spark, d):
    out = ranking.fuse([_lexical(spark, d), _semantic(spark, d)], [_static(spark, d), _churn(spark, d)])
    return out.select("query_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("int").alias("rank"))


FUSE = """lists AS (SELECT query_id, id, max(CASE WHEN k = 0 THEN rank END) AS r0, max(CASE WHEN k = 1 THEN rank END) AS r1, max(CASE WHEN k = 2 THEN rank END) AS r2 FROM {0} GROUP BY query_id, id),
sig AS (SELECT l.*, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(n_chars % 97, 0) DESC, id) AS s0, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(CASE WHEN n_chars % 3 = 0 THEN n_chars % 13 END, 0) DESC, id) AS s1 FROM lists l LEFT JOIN documents ON doc_id = id),
fu AS (SELECT query_id, id, coalesce(1.0::DOUBLE / (60 + r0), 0) + coalesce(1.0::DOUBLE / (60 + r1), 0) + coalesce(1.0::DOUBLE / (60 + r2), 0) + {1} AS score FROM sig),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM fu)
SELECT query_id, id, round(score, 9) AS score, rank FROM fr WHERE rank <= 20"""
_LISTS = "(SELECT query_id, id, rank, 0 AS k FROM lex WHERE rank <= 50 UNION ALL SELECT query_id, id, rank, 1 FROM sem WHERE rank <= 50{0})"


def hyde_fusion(spark, d):
    third = table(spark, d, "embeddings").where("vec_id % 20 = 10").select((F.col("vec_id") - 10).alias("query_id"), F.col("embedding").alias("qv"))
    hyde = ranking.nearest(table(spark, d, "embeddings"), third, id_col="vec_id", vector="embedding")
    out = ranking.fuse([_lexical(spark, d), _semantic(spark, d), hyde])
    return out.select("query_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("int").alias("rank"))


HYDE = """hv AS (SELECT q.vec_id - 10 AS query_id, c.vec_id AS id, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 10),
hy AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hv)"""


def rerank_overlap(spark, d):
    top = F.broadcast(_lexical(spark, d, 20).join(F.broadcast(first_query(spark, d)), "query_id")).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return ranking.rerank(top.select("query_id", "query", "id", "text")).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def mmr_select(spark, d):
    pool = _semantic(spark, d, 20).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id")
    return ranking.mmr(pool.select("query_id", "id", F.col("score").alias("relevance"), "vector"), 5)


MMR = f"""WITH RECURSIVE {KNN},
pool AS (SELECT query_id, id, score AS rel, embedding::DOUBLE[] AS v FROM sem JOIN embeddings ON vec_id = id WHERE rank <= 20),
pick(query_id, n, ids) AS (
  SELECT query_id, 1, [arg_max(id, (rel, -id))] FROM pool GROUP BY query_id
  UNION ALL
  SELECT k.query_id, k.n + 1, list_append(k.ids, (SELECT arg_max(p.id, (0.7 * p.rel - 0.3 * (SELECT max(list_cosine_similarity(p.v, s.v)) FROM pool s WHERE s.query_id = p.query_id AND list_contains(k.ids, s.id)), -p.id))
    FROM pool p WHERE p.query_id = k.query_id AND NOT list_contains(k.ids, p.id)))
  FROM pick k WHERE k.n < 5)
SELECT query_id, unnest(ids) AS id, CAST(generate_subscripts(ids, 1) AS INTEGER) AS pick FROM pick WHERE n = 5"""


def knapsack_greedy(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("cost"))
    pool = F.broadcast(_lexical(spark, d, 40)).join(docs, "id").select("query_id", "id", F.col("score").alias("relevance"), "cost", F.col("id").alias("pos"))
    return ranking.knapsack(pool, 12000).select("query_id", "id", "cost")


KNAP = f"""WITH RECURSIVE {BM25},
pool AS (SELECT query_id, id, n_chars AS cost, row_number() OVER (PARTITION BY query_id ORDER BY score / n_chars DESC, score DESC, id) AS k FROM lex JOIN documents ON doc_id = id WHERE rank <= 40),
run(query_id, k, used, id, cost) AS (
  SELECT query_id, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT query_id FROM pool)
  UNION ALL
  SELECT p.query_id, p.k, CASE WHEN r.used + p.cost <= 12000 THEN r.used + p.cost ELSE r.used END, CASE WHEN r.used + p.cost <= 12000 THEN p.id END, p.cost FROM run r JOIN pool p ON p.query_id = r.query_id AND p.k = r.k + 1)
SELECT query_id, id, cost FROM run WHERE id IS NOT NULL"""


def near_duplicates(spark, d):
    found = ranking.similar_pairs(table(spark, d, "embeddings"), id_col="vec_id", vector="embedding", group_col="label", threshold=0.4)
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


NEAR = """WITH s AS (SELECT x.vec_id AS i, y.vec_id AS j, x.label AS li, y.label AS lj, list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS sim FROM embeddings x, embeddings y),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS n FROM s)
SELECT least(i, j) AS a, greatest(i, j) AS b, round(max(sim), 6) AS similarity FROM r WHERE n <= 10 AND sim >= 0.4 AND i <> j AND li IS DISTINCT FROM lj GROUP BY least(i, j), greatest(i, j)"""


def duplicate_text(spark, d):
    rows = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
    return rows.where("n > 1")


def centroid_nearest(spark, d):
    """Each vector's nearest label centroid at or above the threshold; null below it."""
    e = table(spark, d, "embeddings")
    c = mean_vectors(e, "label", "embedding").withColumnRenamed("label", "nearest")
    scored = e.select("vec_id", "embedding").crossJoin(F.broadcast(c)).withColumn("s", cosine(F.col("embedding"), F.col("mean")))
    best = scored.groupBy("vec_id").agg(F.max(F.struct("s", (-F.col("nearest")).alias("n"))).alias("b"))
    return best.select("vec_id", F.when(F.col("b.s") >= 0.3, -F.col("b.n")).cast("int").alias("nearest"))


CENTROID = """WITH c AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
s AS (SELECT vec_id, c.label, list_cosine_similarity(embedding::DOUBLE[], v) AS s FROM embeddings, c),
b AS (SELECT vec_id, arg_max(label, (s, -label)) AS label, max(s) AS s FROM s GROUP BY vec_id)
SELECT vec_id, CAST(CASE WHEN s >= 0.3 THEN label END AS INTEGER) AS nearest FROM b"""


def naive_term_scoring(spark, d):
    """Top five documents by occurrences of a query's words as substrings; ties in corpus order."""
    found = ranking.word_counts(table(spark, d, "documents"), first_query(spark, d), id_col="doc_id", text="text", top_k=5)
    return found.select("query_id", "id", "score")


NAIVE = """WITH q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 3)) AS w FROM benchmark WHERE item_id % 20 = 0),
s AS (SELECT query_id, doc_id AS id, CAST(sum((length(lower(text)) - length(replace(lower(text), w, ''))) // length(w)) AS BIGINT) AS score FROM q, documents GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM s)
SELECT query_id, id, score FROM r WHERE n <= 5"""

QUERIES = {
    f.__name__: f
    for f in (tokenize_terms, bm25_topk, knn_topk, knn_by_vector, rrf_fusion, hyde_fusion, rerank_overlap, mmr_select, knapsack_greedy, near_duplicates, duplicate_text, centroid_nearest, naive_term_scoring)
}

ORACLES = {
    "tokenize_terms": f"SELECT token, count(*) AS n FROM (SELECT unnest({TOK.format('text')}) AS token FROM documents) GROUP BY token",
    "bm25_topk": f"WITH {BM25} SELECT query_id, id, round(score, 6) AS score, rank FROM lex WHERE rank <= 10",
    "knn_topk": f"WITH {KNN} SELECT query_id, id, round(score, 6) AS score, rank FROM sem WHERE rank <= 10",
    "knn_by_vector": """WITH c AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IS NOT NULL) GROUP BY label, i) GROUP BY label),
s AS (SELECT c.label::BIGINT AS query_id, vec_id AS id, list_dot_product(embedding::DOUBLE[], v) AS score FROM embeddings, c), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM s)
SELECT query_id, id, round(score, 6) AS score FROM r WHERE n <= 5""",
    "rrf_fusion": f"WITH {BM25}, {KNN}, {FUSE.format(_LISTS.format(''), '1.0::DOUBLE / (60 + s0) + 1.0::DOUBLE / (60 + s1)')}",
    "hyde_fusion": f"WITH {BM25}, {KNN}, {HYDE}, {FUSE.format(_LISTS.format(' UNION ALL SELECT query_id, id, rank, 2 FROM hy WHERE rank <= 50'), '0')}",
    "mmr_select": MMR,
    "knapsack_greedy": KNAP,
    "near_duplicates": NEAR,
    "duplicate_text": "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "centroid_nearest": CENTROID,
    "naive_term_scoring": NAIVE,
}
