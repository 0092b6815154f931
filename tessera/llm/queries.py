"""The registered queries of the dealt operators: production parameters over whole tables, digests of the full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, language, line_dedup, mixing, sharding, simhash, suffix_dedup, topk, toxicity, url_filter
from tessera.llm.common import table, word_count

#: Fixed rules of the URL query: (host, path, verdict).
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Parts of host names (between dots or hyphens) that usual lists of advertisers and trackers hold; they decide where no rule
#: of the above fits. Fixed values.
URL_WORDS = ("ad", "adnxs", "ads", "adserver", "adservice", "adsystem", "adtech", "advert", "adverts", "affiliate", "banner", "banners", "beacon", "clickserve", "clicktrack", "doubleclick", "googlesyndication", "outbrain", "pixel", "popads", "popunder", "scorecardresearch", "taboola", "telemetry", "tracker", "trackers", "tracking")
URL_PATTERNS = tuple(url_filter.Rule(None, rf"\A(?:[^/]*[.-])?{w}[.-]", (w,), "block", 0) for w in URL_WORDS)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, F.col("doc_id"), F.col("source"), word_count(F.col("text")))
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # A null id has no remainder: such rows are held out of learning neither way, and not learned from.
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    found = language.identify(docs, ~held_out & F.col("doc_id").isNotNull())
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"], keep_text=False)
    hit = F.aggregate(F.arrays_zip("begins", "ends"), F.lit(0).cast("long"), lambda n, s: n + s["ends"] - s["begins"])
    out = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    dealt = sharding.deal(rows, F.col("doc_id"), shards=8, ties=[F.col("size"), F.col("text_crc32")])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = line_dedup.without_repeats(docs)
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [*(url_filter.host_rule(*r) for r in URL_RULES), *URL_PATTERNS]
    return url_filter.judge(table(spark, sf_dir, "pages"), rules, id_col="page_id", url_col="url")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=["doc_id"])
