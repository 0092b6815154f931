"""A corpus pipeline of five stages: toxicity, SimHash near-dedup, benchmark decontamination, source mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents (the last one adds the shard);
``run`` writes each result as Parquet to the folder in spark.checkpoint.dir and reads it again as the next one's docs.
Every stage works on all rows of its predecessor, texts of any length whole. Null texts count as empty ones: they are clean, of
no words, near copies of each other, and null still. Rows with null ids are rows like others: each stage tells rows apart by
id and text, so rows of one id, or of none, with different texts all stay, and of repeated rows the near-copy stage keeps one.
Of near copies the least id (null last), then the least text hash, stays. Other columns of any name pass through. An empty
table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, mixing, near_copies, sharding, toxicity
from tessera.llm.common import WORD, free_name, shared_folder, table, word_count

#: Documents of which at least one word in this many is hit go; of others the hit spans are cut.
COVERAGE = 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is at the reject threshold or above go."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    judged = toxicity.score(docs, model, carry=docs.columns)
    return judged.where(~F.col(free_name(docs.columns, "toxic"))).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose five-word shingles are similar by 0.8 or more the row with the least id (null last), then text hash, stays."""
    which, of = free_name(docs.columns, "id_or_zero"), free_name(docs.columns, "row_hash")
    row = lambda text_hash: {which: F.coalesce("doc_id", F.lit(0)), of: F.xxhash64(F.col("doc_id").isNull(), "doc_id", text_hash)}
    keep = near_copies.firsts(docs).withColumns(row(F.col("text_hash"))).select(which, of)
    # Repeated rows collapse before the exchange; the join needs no other one of the texts.
    return docs.withColumns(row(near_copies.text_hash("text"))).dropDuplicates([which, of]).join(keep, [which, of], "left_semi").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a hit word in 20 go; elsewhere the words that items cover are cut from the text."""
    found = decontamination.scan(docs, table(spark, sf_dir, "benchmark"), carry=[c for c in docs.columns if c != "text"], cut=True)
    n_words, begins, ends = (free_name(docs.columns, n) for n in ("n_words", "begins", "ends"))
    hit = F.aggregate(F.zip_with(begins, ends, lambda a, e: e - a), F.lit(0).cast("long"), lambda n, x: n + x)
    kept = found.where((hit == 0) | (COVERAGE * hit < F.col(n_words)))
    return kept.withColumn("n_chars", F.when(F.size(begins) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each appearance of a document in the mix. One that a source's last block cuts short keeps the words taken."""
    others = [c for c in docs.columns if c not in ("doc_id", "source")]
    short_names = {c: f"carried_{i}" for i, c in enumerate(others)}  # whatever the columns are called, they don't clash
    mixed = mixing.mix(docs, F.col("doc_id"), F.col("source"), word_count(F.col("text")), carry={n: F.col(f"`{c}`") for c, n in short_names.items()})
    shown = mixed.withColumn("n", F.explode(F.array("first_taken", F.col("taken") - F.col("first_taken")))).where("n > 0")
    text, n_chars, short = F.col(short_names["text"]), F.col(short_names["n_chars"]), F.col("n") < F.col("size")
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    part = F.array_join(F.slice(words, F.lit(1), F.col("n").cast("int")), " ")
    values = {"doc_id": F.col("key"), "source": F.col("source"), "text": F.when(short, part).otherwise(text), "n_chars": F.when(short, F.length(part).cast("long")).otherwise(n_chars)}
    return shown.select(*[values.get(c, F.col(short_names.get(c, c))).alias(c) for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with shard (0 to 7) and slot; shard sizes differ by one row at most."""
    return sharding.deal(docs, F.col("doc_id"), shards=8, ties=[F.col("n_chars")])


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("decontamination", decontaminate), ("mixing", mix_sources), ("sharding", shard)]

#: A trained model and hashed fingerprints decide, which SQL can't express; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. A stage's files go once the next one's are written; the last ones stay."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        docs, before = spark.read.parquet(out), out
    return docs
