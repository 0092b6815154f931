"""Streams over files, run to the end of what is there."""

import json
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.operators import governor
from tessera.streaming import live

T0 = datetime(2024, 1, 1)


def source(spark, tmp_path, rows, schema):
    for i, r in enumerate(rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i:03}.json").write_text("\n".join(json.dumps(x) for x in r))
        os.utime(tmp_path / "in" / f"{i:03}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read by age
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def drained(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def stamp(seconds):
    return (T0 + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3]


def test_settled(spark, tmp_path):
    rows = [[{"path": "a", "ts": stamp(0)}, {"path": "a", "ts": stamp(0.2)}], [{"path": "a", "ts": stamp(5)}, {"path": "b", "ts": stamp(60)}]]
    got = drained(live.settled(source(spark, tmp_path, rows, "path string, ts timestamp")), tmp_path, "settled")
    assert sorted((r.path, r.events) for r in got) == [("a", 1), ("a", 2)]


def test_outcomes(spark, tmp_path):
    (tmp_path / "x").mkdir(), (tmp_path / "y").mkdir()
    r = source(spark, tmp_path / "x", [[{"log_id": 1, "path": "f", "retrieved_at": stamp(0)}, {"log_id": 2, "path": "g", "retrieved_at": stamp(0)}], [{"log_id": 3, "path": "z", "retrieved_at": stamp(9000)}]], "log_id int, path string, retrieved_at timestamp")
    c = source(spark, tmp_path / "y", [[{"path": "f", "changed_at": stamp(600)}], [{"path": "z", "changed_at": stamp(9000)}]], "path string, changed_at timestamp")
    got = drained(live.outcomes(r, c, on="path"), tmp_path, "outcomes")
    assert {(x.log_id, x.changed_at is not None) for x in got} >= {(1, True), (2, False)}


def test_governed_stream_equals_replay(spark, tmp_path):
    turns = [[("a", 0.9, 40), ("b", 0.5, 40)], [("a", 0.9, 40)], [("c", 0.8, 30)], [("b", 0.9, 40)], []]
    rows = [[{"session_id": "s", "turn": i, "requests": [dict(zip(("id", "relevance", "cost"), x, strict=True)) for x in t]}] for i, t in enumerate(turns)]
    schema = "session_id string, turn long, requests array<struct<id: string, relevance: double, cost: long>>"
    got = drained(governor.governed_stream(source(spark, tmp_path, rows, schema), 100), tmp_path, "governed")
    want = governor.replay(spark.createDataFrame([(r[0]["session_id"], r[0]["turn"], [tuple(q.values()) for q in r[0]["requests"]]) for r in rows], schema), 100)
    assert sorted(map(str, got)) == sorted(map(str, want.collect()))


def test_refresh_and_append(spark, tmp_path):
    seen = []
    src = source(spark, tmp_path, [[{"path": "a", "content": "1", "ts": stamp(0)}, {"path": "a", "content": "2", "ts": stamp(1)}]], "path string, content string, ts timestamp")
    live.refresh(src, lambda df, n: seen.extend(df.collect()), str(tmp_path / "c1"), every=None).awaitTermination(60)
    assert [(r.path, r.content) for r in seen] == [("a", "2")]
    live.append_json(src, str(tmp_path / "out"), str(tmp_path / "c2"), "path").awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).where(F.col("path") == "a").count() == 2
