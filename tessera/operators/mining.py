"""Mining of logs and histories: co-occurrence, decay, outcomes, precedence, majorities, drift, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
MIN_SUPPORT, DECAY, WINDOW_DAYS, SETTLE_S, TURN_DECAY, TTL_S = 5, 0.97, 90, 1800, 0.85, 7200


def co_retrieval(baskets: DataFrame, *, session: str, item: str, support: int = MIN_SUPPORT) -> DataFrame:
    """(a, b, confidence, support): how often b is in a session that holds a. A session's items meet each other once; the
    pairs of a session are emitted by its own row, never as a join of two tables."""
    each = baskets.where(F.col(item).isNotNull()).groupBy(session).agg(F.sort_array(F.collect_set(item)).alias("items"))
    solo = each.select(F.explode("items").alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    first = each.select("items", F.posexplode("items").alias("i", "x"))
    pairs = first.select("x", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= support)
    both = pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), "support").unionByName(pairs.select(F.col("y").alias("a"), F.col("x").alias("b"), "support"))
    return both.join(solo, "a").select("a", "b", (F.col("support") / F.col("n")).alias("confidence"), "support")


def decayed_sum(touches: DataFrame, keys: DataFrame, *, key: str, days: Column, decay: float = DECAY, window: float = WINDOW_DAYS) -> DataFrame:
    """(key, churn): sum of decay ^ days within the window, 0 for keys never touched."""
    recent = touches.where(days <= window).groupBy(key).agg(F.sum(F.pow(F.lit(decay), F.greatest(F.lit(0.0), days))).alias("churn"))
    return keys.select(key).distinct().join(recent, key, "left").select(key, F.coalesce("churn", F.lit(0.0)).alias("churn"))


def latest_within(left: DataFrame, right: DataFrame, *, on: str, left_time: Column, right_time: Column, seconds: int = SETTLE_S) -> DataFrame:
    """left with ``at``: the latest right time within ``seconds`` after the left one, null without any. Each right row is
    listed in the time bins where a left row could reach it, so the join is an equality on (on, bin)."""
    r = right.select(F.col(on).alias("_on"), right_time.alias("_rt"))
    r = r.select("_on", "_rt", F.explode(F.array(F.floor(F.col("_rt") / seconds), F.floor(F.col("_rt") / seconds) - 1)).alias("_bin"))
    l = left.withColumn("_lt", left_time).withColumn("_bin", F.floor(F.col("_lt") / seconds))  # noqa: E741
    hit = (l[on] == r["_on"]) & (l["_bin"] == r["_bin"]) & (r["_rt"] >= l["_lt"]) & (r["_rt"] <= l["_lt"] + seconds)
    return l.join(r, hit, "left").groupBy(*left.columns).agg(F.max("_rt").alias("at"))


def with_feedback(proxies: DataFrame, feedback: DataFrame, *, key: str) -> DataFrame:
    """(key, label, origin): the latest rating, else the proxy; rows with neither are dropped. feedback: (key, rating, submitted_at)."""
    last = feedback.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("submitted_at").desc()))).where("_n = 1").select(key, F.col("rating").alias("_rating"))
    rated = F.when(F.col("_rating") == "helpful", True).when(F.col("_rating") == "not_helpful", False)
    out = proxies.join(last, key, "left").select(key, F.coalesce(rated, F.col("proxy")).alias("label"), F.when(rated.isNotNull(), "human").otherwise("proxy").alias("origin"))
    return out.where(F.col("label").isNotNull())


def turns(log: DataFrame, *, session: str, order: list[str]) -> DataFrame:
    return log.withColumn("turn", F.row_number().over(Window.partitionBy(session).orderBy(*order)).cast("long"))


def decayed_scores(log: DataFrame, *, session: str, item: str, turn: str, base: str, decay: float = TURN_DECAY) -> DataFrame:
    """At the end of each session: (session, item, score) = latest base x decay ^ turns since."""
    end = log.groupBy(session).agg(F.max(turn).alias("_end"))
    last = log.groupBy(session, item).agg(F.max(F.struct(turn, base)).alias("_l"))
    return last.join(end, session).select(session, item, (F.col(f"_l.{base}") * F.pow(F.lit(decay), F.col("_end") - F.col(f"_l.{turn}"))).alias("score"))


def majority(rows: DataFrame, *, pattern: str, pos: str) -> DataFrame:
    """One row (pattern, n, total): the most frequent; ties to what was seen first."""
    counts = rows.where(F.col(pattern).isNotNull()).groupBy(pattern).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("_seen"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.orderBy(F.col("n").desc(), "_seen").limit(1).select(F.col(pattern).alias("pattern"), "n").join(F.broadcast(total))


def violations(rows: DataFrame, *, key: str, pattern: str, pos: str) -> DataFrame:
    top = F.broadcast(majority(rows, pattern=pattern, pos=pos).select(F.col("pattern").alias("_top")))
    return rows.where(F.col(pattern).isNotNull()).join(top).where(F.col(pattern) != F.col("_top")).select(key, pattern)


def drift(left: DataFrame, right: DataFrame, key: str, left_says: str, right_says: str) -> DataFrame:
    """(key, kind): keys on one side alone."""
    l, r = left.select(key).distinct(), right.select(key).distinct()  # noqa: E741
    return l.join(r, key, "left_anti").withColumn("kind", F.lit(left_says)).unionByName(r.join(l, key, "left_anti").withColumn("kind", F.lit(right_says)))


def breaking_changes(old: DataFrame, new: DataFrame, *, key: str, required: str, status: str) -> DataFrame:
    """(key, description): removed routes, removed required fields, changed statuses; additions are no changes."""
    o = old.select(key, F.col(required).alias("_or"), F.col(status).alias("_os"))
    n = new.select(key, F.col(required).alias("_nr"), F.col(status).alias("_ns"), F.lit(True).alias("_there"))
    both = o.join(n, key, "left")
    removed = both.where(F.col("_there").isNull()).select(key, F.lit("removed").alias("description"))
    fields = both.where("_there").select(key, F.explode(F.array_except("_or", "_nr")).alias("f")).select(key, F.concat(F.lit("field removed: "), "f").alias("description"))
    changed = both.where(F.col("_there") & ~F.col("_os").eqNullSafe(F.col("_ns"))).select(key, F.concat(F.lit("status "), F.col("_os").cast("string"), F.lit(" -> "), F.col("_ns").cast("string")).alias("description"))
    return removed.unionByName(fields).unionByName(changed)


def recall_at(retrieved: Column, truth: Column, k: int) -> Column:
    """Null where there is no truth."""
    return F.size(F.array_intersect(F.slice(retrieved, 1, k), truth)) / F.nullif(F.size(F.array_distinct(truth)), F.lit(0))


def summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """mean, median and n of what isn't null."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.count(value).alias("n"))


def posteriors(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(intent, arm, alpha, beta) of Beta(1, 1) priors after the resolved decisions; pending ones change nothing.
    decisions: (log_id, intent, arm); outcomes: (log_id, reward boolean)."""
    joined = decisions.join(outcomes, "log_id", "left")
    return joined.groupBy("intent", "arm").agg((F.count_if(F.col("reward")) + 1).alias("alpha"), (F.count_if(~F.col("reward")) + 1).alias("beta"))


def status_counts(rows: DataFrame, status: str, all_statuses: list[str]) -> DataFrame:
    enum = rows.sparkSession.createDataFrame([(s,) for s in all_statuses], f"{status} string")
    return F.broadcast(enum).join(rows.groupBy(status).agg(F.count(F.lit(1)).alias("n")), status, "left").select(status, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
