"""Log, history and report queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import mining as m
from tessera.plans.tables import table


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def _t():
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6


def co_retrieval(spark, d):
    rows = m.co_retrieval(table(spark, d, "events").select("user_id", _k().alias("k")), session="user_id", item="k")
    return rows.select("a", "b", F.round("confidence", 8).alias("confidence"), "support")


CO = """WITH s AS (SELECT DISTINCT user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events), n AS (SELECT k, count(*) AS n FROM s WHERE k IS NOT NULL GROUP BY k),
p AS (SELECT x.k AS a, y.k AS b, count(*) AS support FROM s x JOIN s y ON x.user_id = y.user_id AND x.k <> y.k GROUP BY ALL HAVING count(*) >= 5)
SELECT a, b, round(support / n, 8) AS confidence, support FROM p JOIN n ON n.k = a"""


def churn_decay(spark, d):
    e = table(spark, d, "events")
    days = (F.lit(1706745600.0) - _t()) / 86400
    out = m.decayed_sum(e.where("event_type = 'click'"), e, key="user_id", days=days)
    return out.select("user_id", F.round("churn", 6).alias("churn"))


CHURN = """WITH d AS (SELECT user_id, (1706745600.0::DOUBLE - epoch_us(ts) / 1e6) / 86400 AS days FROM events WHERE event_type = 'click'),
c AS (SELECT user_id, sum(pow(0.97::DOUBLE, greatest(0, days))) AS churn FROM d WHERE days <= 90 GROUP BY user_id)
SELECT user_id, round(coalesce(churn, 0), 6) AS churn FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN c USING (user_id)"""


def session_turns(spark, d):
    return m.turns(table(spark, d, "events").select("event_id", "user_id", "ts"), session="user_id", order=["ts", "event_id"]).select("event_id", "user_id", "turn")


def session_ttl_windows(spark, d):
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


TTL = """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""


def decay_scores(spark, d):
    log = m.turns(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value"), session="user_id", order=["ts", "event_id"])
    out = m.decayed_scores(log, session="user_id", item="event_type", turn="turn", base="value")
    return out.select("user_id", "event_type", F.round("score", 6).alias("score"))


DECAY = """WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events), e AS (SELECT user_id, max(turn) AS last FROM t GROUP BY user_id)
SELECT user_id, event_type, round(max_by(value, turn) * pow(0.85::DOUBLE, any_value(last) - max(turn)), 6) AS score FROM t JOIN e USING (user_id) GROUP BY user_id, event_type"""


def outcome_backfill(spark, d):
    e = table(spark, d, "events")
    left, right = e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts")
    out = m.latest_within(left, right, on="user_id", left_time=_t(), right_time=_t())
    return out.select("event_id", F.when(F.col("at").isNotNull(), True).alias("edited"))


BACKFILL = """SELECT l.event_id, CASE WHEN count(r.ts) > 0 THEN true END AS edited FROM (SELECT * FROM events WHERE event_type = 'click') l
LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND epoch_us(r.ts) >= epoch_us(l.ts) AND epoch_us(r.ts) <= epoch_us(l.ts) + 1800000000 GROUP BY l.event_id"""


def feedback_precedence(spark, d):
    proxies = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 3000, True).when(F.col("n_chars") < 500, False).alias("proxy"))
    rated = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "helpful").otherwise("not_helpful").alias("rating"), F.col("doc_id").alias("submitted_at"))
    return m.with_feedback(proxies, rated, key="doc_id")


FEEDBACK = """SELECT doc_id, coalesce(quality = 1, CASE WHEN n_chars > 3000 THEN true WHEN n_chars < 500 THEN false END) AS label, CASE WHEN quality IS NOT NULL THEN 'human' ELSE 'proxy' END AS origin
FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL OR n_chars > 3000 OR n_chars < 500"""


def majority_pattern(spark, d):
    return m.majority(table(spark, d, "events"), pattern="event_type", pos="event_id")


def pattern_violations(spark, d):
    return m.violations(table(spark, d, "part"), key="p_partkey", pattern="p_brand", pos="p_partkey")


def coverage_stats(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.round(100 * F.count("quality") / F.count(F.lit(1)), 6).alias("coverage_pct"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality").isNull()).alias("missing"))


def drift_both_ways(spark, d):
    left, right = table(spark, d, "documents").where("n_chars % 5 <> 0").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return m.drift(left, right, "doc_id", "unlabelled", "unknown")


def contract_diff(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.split("p_type", " ").alias("fields"), "p_size")
    new = p.where("p_size % 11 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.slice("fields", 2, 10)).otherwise(F.col("fields")).alias("fields"), F.when(F.col("p_partkey") % 13 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    return m.breaking_changes(p, new, key="p_partkey", required="fields", status="p_size")


CONTRACT = """WITH o AS (SELECT p_partkey, string_split(p_type, ' ') AS f, p_size FROM part),
n AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN f[2:] ELSE f END AS f, CASE WHEN p_partkey % 13 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM o WHERE p_size % 11 <> 0)
SELECT p_partkey, 'removed' AS description FROM o WHERE p_partkey NOT IN (SELECT p_partkey FROM n)
UNION ALL SELECT p_partkey, 'field removed: ' || x FROM (SELECT DISTINCT o.p_partkey, unnest(list_filter(o.f, lambda x: NOT list_contains(n.f, x))) AS x FROM o JOIN n USING (p_partkey))
UNION ALL SELECT p_partkey, 'status ' || o.p_size || ' -> ' || n.p_size FROM o JOIN n USING (p_partkey) WHERE o.p_size <> n.p_size"""


def recall_at_k(spark, d):
    """Recall at 5 of each label's vectors ranked by id against those with even ids; null where a label has none."""
    e = table(spark, d, "embeddings").groupBy("label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    truth = F.filter("ids", lambda x: x % 2 == 0)
    return e.select("label", F.round(m.recall_at(F.col("ids"), truth, 5), 8).alias("recall"))


RECALL = """WITH g AS (SELECT label, list(vec_id ORDER BY vec_id) AS ids FROM embeddings GROUP BY label), t AS (SELECT label, ids, list_filter(ids, lambda x: x % 2 = 0) AS truth FROM g)
SELECT label, round(len(list_intersect(ids[1:5], truth)) / nullif(len(truth), 0), 8) AS recall FROM t"""


def strategy_summary(spark, d):
    rows = table(spark, d, "events").select("event_type", F.when(F.col("user_id") % 3 != 0, F.col("value")).alias("v"))
    out = m.summary(rows, "v", "event_type")
    return out.select("event_type", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "n")


def range_overlap(spark, d):
    """Hunks against line ranges of the same file: lines of lineitem as ranges, orders as files."""
    l = table(spark, d, "lineitem")  # noqa: E741
    ranges = l.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("a"), (F.col("l_quantity") + 5).cast("int").alias("e"))
    hunks = l.where("l_linenumber = 1").select("l_orderkey", F.col("l_quantity").cast("int").alias("s"), (F.col("l_suppkey") % 4).cast("int").alias("c"))
    hit = ranges.join(hunks, "l_orderkey").where(tx.hunk_overlaps(F.col("s"), F.col("c"), F.col("a"), F.col("e")))
    return hit.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


OVERLAP = """WITH r AS (SELECT l_orderkey, CAST(floor(l_quantity) AS INTEGER) AS a, CAST(floor(l_quantity + 5) AS INTEGER) AS e FROM lineitem),
h AS (SELECT l_orderkey, CAST(floor(l_quantity) AS INTEGER) AS s, l_suppkey % 4 AS c FROM lineitem WHERE l_linenumber = 1)
SELECT l_orderkey, count(*) AS n FROM r JOIN h USING (l_orderkey) WHERE CASE WHEN c = 0 THEN a <= s AND s < e ELSE s <= e AND s + c - 1 >= a END GROUP BY l_orderkey"""


def chunk_containment(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("a"), (F.col("l_quantity") + 5).cast("int").alias("e"))  # noqa: E741
    one = l.where("l_linenumber = 1").select("l_orderkey", F.col("a").alias("ca"), F.col("e").alias("ce"))
    best = l.join(one, "l_orderkey").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linenumber") > 1, tx.containment(F.col("ca"), F.col("ce"), F.col("a"), F.col("e")))).alias("c"))
    return best.select("l_orderkey", F.round("c", 8).alias("containment"))


CONTAIN = """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS INTEGER) AS a, CAST(floor(l_quantity + 5) AS INTEGER) AS e FROM lineitem), o AS (SELECT l_orderkey, a AS ca, e AS ce FROM l WHERE l_linenumber = 1)
SELECT l_orderkey, round(max(CASE WHEN l_linenumber > 1 THEN greatest(0, least(ce, e) - greatest(ca, a) + 1) / (e - a + 1) END), 8) AS containment FROM l JOIN o USING (l_orderkey) GROUP BY l_orderkey"""


def chunk_packing(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda x: F.length(x).cast("long"))
    return table(spark, d, "documents").select("doc_id", (F.array_max(tx.packed_chunks(lines, 500)) + 1).alias("chunks"))


CHUNKS = """WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS c FROM documents),
r(doc_id, i, n, chunk, used) AS (SELECT doc_id, 0::BIGINT, len(c)::BIGINT, 0::BIGINT, 0::BIGINT FROM l
UNION ALL SELECT r.doc_id, i + 1, n, chunk + CASE WHEN used > 0 AND used + c[i + 1] > 500 THEN 1 ELSE 0 END, CASE WHEN used > 0 AND used + c[i + 1] > 500 THEN c[i + 1] ELSE used + c[i + 1] END FROM r JOIN l USING (doc_id) WHERE i < n)
SELECT doc_id, chunk + 1 AS chunks FROM r WHERE i = n"""


def sanitize_patterns(spark, d):
    text = tx.redact(tx.redact(F.col("text")), [r"(?i)\b(worthless|pathetic)\b"])
    return table(spark, d, "documents").select("doc_id", F.sha2(text, 256).alias("clean_sha256"), (text != F.col("text")).alias("modified"))


SANITIZE = r"""WITH c AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?im)^\s*(system|assistant)\s*:\s', '[REDACTED]', 'g'), '(?i)ignore (all |any )?(previous|prior|above) instructions', '[REDACTED]', 'g'),
 '(?i)disregard (all |any )?(previous|prior|above) instructions', '[REDACTED]', 'g'), '(?i)\b(worthless|pathetic)\b', '[REDACTED]', 'g') AS clean FROM documents)
SELECT doc_id, sha256(clean) AS clean_sha256, clean <> text AS modified FROM c"""


def intent_keywords(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", tx.intent(t).alias("intent"), tx.symbol_reference(t).alias("reference"), tx.starting_level(t).alias("level"))


INTENT = r"""WITH c AS (SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'error|exception|traceback|crash|fails|broken|bug') THEN 'debug' WHEN regexp_matches(lower(text), 'add|implement|create|new|support for') THEN 'feature'
 WHEN regexp_matches(lower(text), 'refactor|rename|clean up|restructure|simplify') THEN 'refactor' ELSE 'general' END AS intent,
 nullif(regexp_extract(text, '\b([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)+|[a-z]+_[a-z_]+|[a-zA-Z][a-zA-Z0-9_]*\.py)\b', 1), '') AS reference FROM conversations)
SELECT *, CASE WHEN intent = 'general' AND reference IS NULL THEN 'L0_L1' ELSE 'L3_L4' END AS level FROM c"""


def glob_name_filter(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").where(u.rlike(tx.glob_to_regex("https://*/en/*")) & F.lower(u).contains("page=")).select("page_id", "url")


def file_summary(spark, d):
    host = F.split("url", "/")[2]
    return table(spark, d, "pages").groupBy(host.alias("file_path")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id"))


def severity_topk(spark, d):
    rank = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(2)
    return table(spark, d, "orders").select("o_orderkey", rank.alias("severity"), F.count(F.lit(1)).over(Window.partitionBy()).alias("total")).orderBy("severity", "o_orderkey").limit(30)


def temporal_split(spark, d):
    side = F.when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"), "train").otherwise("eval")
    return table(spark, d, "orders").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


def telemetry_recent(spark, d):
    return table(spark, d, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(100).select("event_id", "user_id", "event_type")


def dashboard_status(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("source").alias("files"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("languages"))


def experimental_total(spark, d):
    kinds = spark.createDataFrame([("click",), ("purchase",), ("absent",)], "feature string")
    sums = table(spark, d, "events").groupBy(F.col("event_type").alias("feature")).agg(F.sum(F.floor("value")).alias("t"))
    return F.broadcast(kinds).join(sums, "feature", "left").select("feature", F.coalesce("t", F.lit(0)).cast("long").alias("tokens"))


def bandit_posterior(spark, d):
    e = table(spark, d, "events")
    decisions = e.select(F.col("event_id").alias("log_id"), F.col("event_type").alias("intent"), (F.col("user_id") % 3).cast("string").alias("arm"))
    outcomes = e.where("event_id % 4 <> 0").select(F.col("event_id").alias("log_id"), (F.col("value") > 50).alias("reward"))
    return m.posteriors(decisions, outcomes)


def ledger_status_counts(spark, d):
    return m.status_counts(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")), "status", ["F", "O", "P", "X"])


QUERIES = {
    f.__name__: f
    for f in (co_retrieval, churn_decay, session_turns, session_ttl_windows, decay_scores, outcome_backfill, feedback_precedence, majority_pattern, pattern_violations, coverage_stats, drift_both_ways, contract_diff, recall_at_k, strategy_summary, range_overlap, chunk_containment, chunk_packing, sanitize_patterns, intent_keywords, glob_name_filter, file_summary, severity_topk, temporal_split, telemetry_recent, dashboard_status, experimental_total, bandit_posterior, ledger_status_counts)
}

ORACLES = {
    "co_retrieval": CO,
    "churn_decay": CHURN,
    "session_turns": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events",
    "session_ttl_windows": TTL,
    "decay_scores": DECAY,
    "outcome_backfill": BACKFILL,
    "feedback_precedence": FEEDBACK,
    "majority_pattern": "SELECT event_type AS pattern, count(*) AS n, (SELECT count(event_type) FROM events) AS total FROM events WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY n DESC, min(event_id) LIMIT 1",
    "pattern_violations": "SELECT p_partkey, p_brand FROM part WHERE p_brand <> (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, min(p_partkey) LIMIT 1)",
    "coverage_stats": "SELECT lang, round(100 * count(quality) / count(*), 6) AS coverage_pct, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality IS NULL) AS missing FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "drift_both_ways": "SELECT doc_id, 'unlabelled' AS kind FROM documents WHERE n_chars % 5 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'unknown' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars % 5 <> 0)",
    "contract_diff": CONTRACT,
    "recall_at_k": RECALL,
    "strategy_summary": "SELECT event_type, round(avg(v), 6) AS mean, round(median(v), 6) AS median, count(v) AS n FROM (SELECT event_type, CASE WHEN user_id % 3 <> 0 THEN value END AS v FROM events) GROUP BY event_type",
    "range_overlap": OVERLAP,
    "chunk_containment": CONTAIN,
    "chunk_packing": CHUNKS,
    "sanitize_patterns": SANITIZE,
    "intent_keywords": INTENT,
    "glob_name_filter": "SELECT page_id, url FROM pages WHERE url GLOB 'https://*/en/*' AND contains(lower(url), 'page=')",
    "file_summary": "SELECT string_split(url, '/')[3] AS file_path, count(*) AS n, min(page_id) AS first_id FROM pages GROUP BY 1",
    "severity_topk": "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END AS severity, count(*) OVER () AS total FROM orders ORDER BY severity, o_orderkey LIMIT 30",
    "temporal_split": "SELECT CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'train' ELSE 'eval' END AS side, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1",
    "telemetry_recent": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
    "dashboard_status": "SELECT count(*) AS symbols, count(DISTINCT source) AS files, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM documents",
    "experimental_total": "SELECT feature, CAST(coalesce(sum(floor(value)), 0) AS BIGINT) AS tokens FROM (SELECT unnest(['click', 'purchase', 'absent']) AS feature) LEFT JOIN events ON event_type = feature GROUP BY feature",
    "bandit_posterior": "SELECT event_type AS intent, CAST(user_id % 3 AS VARCHAR) AS arm, 1 + count(*) FILTER (event_id % 4 <> 0 AND value > 50) AS alpha, 1 + count(*) FILTER (event_id % 4 <> 0 AND value <= 50) AS beta FROM events GROUP BY ALL",
    "ledger_status_counts": "SELECT s AS status, count(o_orderkey) AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS s) LEFT JOIN orders ON o_orderstatus = s GROUP BY s",
}
