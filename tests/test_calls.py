"""The call log, checks of a configuration and the JSON summaries."""

import json

import pytest
from pyspark.sql import Row

from tessera import api
from tessera.operators import calls, doctor
from tessera.operators.learning import Ranker
from tessera.sources import logs


def test_call_log(spark, tmp_path):
    log, path = calls.CallLog(clock=lambda: 5.0), str(tmp_path / "log")

    def search(query, top_k=2):
        calls.note_rerank(3.0)
        return [Row(id=f"s{k}", score=1.0 / (k + 1), name=query) for k in range(top_k)]

    def fails(symbol_id):
        raise KeyError(symbol_id)

    assert len(log.tool("search", search)("a", query="q")) == 2
    with pytest.raises(KeyError):
        log.tool("get_symbol", fails)("a", symbol_id="x")
    log.tool("status", lambda: {"n": 1})("b")
    assert log.flush(spark, path) == 3 and log.flush(spark, path) == 0
    log.tool("nothing", lambda: None)("b")
    log.flush(spark, path)
    rows = {r.tool_name: r for r in logs.retrieval_log(spark, path).collect()}
    one, two, three, four = (rows[t] for t in ("search", "get_symbol", "status", "nothing"))
    assert (one.session_id, one.turn_index, one.query_text, one.cross_encoder_latency_ms, one.error_code) == ("a", 0, "q", 3.0, None)
    assert [(x.symbol_id, x.score, x.value) for x in one.selected] == [("s0", 1.0, None), ("s1", 0.5, None)]
    assert one.output_size_bytes == sum(len(json.dumps({"id": f"s{k}", "score": s, "name": "q"})) for k, s in ((0, 1.0), (1, 0.5))) and one.latency_ms >= 0
    assert (two.turn_index, two.query_text, two.error_code, two.output_size_bytes, two.selected) == (1, "x", "KeyError", 0, [])
    assert two.cross_encoder_latency_ms is None and (three.session_id, three.turn_index) == ("b", 0)
    assert [x.value for x in three.selected] == ["{'n': 1}"] and (four.turn_index, four.output_size_bytes) == (1, 0)


def test_doctor():
    level = lambda config, **k: {c: lv for lv, c, _ in doctor.findings(config, **{"kept": 1, "version": 1, "ranker": Ranker(), **k})}
    assert level({}) == {"compute_profile": "ok", "index_schema": "ok", "ranker": "ok"}
    bad = {"embedding_model": "small-model", "cross_encoder_model": "org/model", "compute_profile": "gpu_large"}
    assert level(bad, kept=None) == {"embedding_model": "warning", "compute_profile": "ok", "gpu_profile": "warning", "index_schema": "error", "ranker": "ok"}
    assert level(bad, kept=0, has_gpu=True)["index_schema"] == "warning" and "gpu_profile" not in level(bad, has_gpu=True)
    assert level({"compute_profile": "huge"})["compute_profile"] == "error"


def test_summaries(spark):
    texts = {"a.py": "def used():\n    return 1\n\n\ndef caller():\n    return used()\n", "b.py": "class Alone:\n    pass\n"}
    index = api.build(spark, spark.createDataFrame([(p, t.encode()) for p, t in texts.items()], "path string, content binary"))
    drift = spark.createDataFrame([("B", "unused"), ("A", "undocumented"), ("C", "unused")], "name string, kind string")
    got = json.loads(index.static_analysis(limit=2, config_drift=drift, migration_drift=None))
    assert got["config_drift"] == {"total": 3, "findings": ["A (undocumented)", "B (unused)"]} and got["migration_drift"] is None
    assert got["dead_code"]["total"] == len(index.dead_code().collect()) and got["duplicates"] == {"total": 0, "findings": []}
    shown = json.loads(index.overview())
    assert {x["kind"] for x in shown["conventions"]} <= {"docstrings", "error_handling", "imports"} and isinstance(shown["architecture"], list)
