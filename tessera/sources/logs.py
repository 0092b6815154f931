"""Usage logs, notes, feedback and configuration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.mining import turns

RETRIEVAL = """log_id string, timestamp double, session_id string, turn_index int, tool_name string, query_text string, query_intent string,
candidates array<struct<symbol_id: string, score: double, value: string>>, selected array<struct<symbol_id: string, score: double, value: string>>,
latency_ms double, output_size_bytes bigint, error_code string, outcome struct<symbol_edited: boolean>, cross_encoder_latency_ms double"""
FEEDBACK = "retrieval_log_id string, rating string, note string, submitted_at double, source string"
NOTES = "note_id string, session_id string, content string, importance int, turn_index int, timestamp double"


def retrieval_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RETRIEVAL).json(path)


def entries(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def recent(log: DataFrame, limit: int = 100) -> DataFrame:
    return log.orderBy(F.col("timestamp").desc(), "log_id").limit(limit)


def baskets(log: DataFrame) -> DataFrame:
    """(session_id, item) of single-symbol requests; batch requests log no text and so don't count."""
    return log.where("tool_name = 'get_symbol' and query_text is not null").select("session_id", F.col("query_text").alias("item")).distinct()


def with_turns(log: DataFrame) -> DataFrame:
    return turns(log, session="session_id", order=["timestamp", "log_id"])


def feedback(spark: SparkSession, path: str) -> DataFrame:
    """The last submission of each log id."""
    rows = spark.read.schema(FEEDBACK).json(path)
    return rows.groupBy("retrieval_log_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "retrieval_log_id"]), F.col("submitted_at")).alias("r")).select("retrieval_log_id", "r.*")


def append(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("append").partitionBy(*by).json(path)


def total_tokens(spark: SparkSession, path: str) -> int:
    return int(spark.read.schema("tokens bigint").json(path).agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])


def optional(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is none: an absent signal isn't an empty one."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def merged(base: dict, over: dict) -> dict:
    """Deep merge of settings: ``over`` wins; lists replace."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(*texts: str) -> dict:
    """YAML or JSON texts, the most general first."""
    out: dict = {}
    for t in texts:
        try:
            import yaml

            one = yaml.safe_load(t)
        except ImportError:
            one = json.loads(t)
        out = merged(out, one or {})
    return out


def is_enabled(config: dict, feature: str) -> bool:
    """Both the general switch and the feature's own."""
    block = config.get("experimental", {})
    return bool(block.get("enabled")) and bool(block.get(feature, {}).get("enabled") if isinstance(block.get(feature), dict) else block.get(feature))
