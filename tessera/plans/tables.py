"""Tables of the driver and views derived from them that several plans share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, edge_type, pos): each event's user to the next event's. Days play files: the order is per day."""
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"), F.col("event_type").alias("edge_type"), F.col("event_id").alias("pos")).where(F.col("dst").isNotNull())


TRANSITIONS = """t AS (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS dst, event_type AS edge_type, event_id AS pos FROM events),
calls AS (SELECT * FROM t WHERE dst IS NOT NULL),
lastt AS (SELECT *, max_by(edge_type, pos) OVER (PARTITION BY src, dst) AS lt FROM calls),
runs AS (SELECT *, max(CASE WHEN edge_type <> lt THEN pos END) OVER (PARTITION BY src, dst) AS other FROM lastt),
edges AS (SELECT src, dst, lt AS edge_type, count(*) AS weight FROM runs WHERE other IS NULL OR pos > other GROUP BY src, dst, lt),
nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"""


def edges_and_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from tessera.operators.graphs import merged_edges

    edges = merged_edges(transitions(spark, sf_dir))
    return edges, edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def first_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): the texts of the benchmark items whose id is divisible by 20."""
    return table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
