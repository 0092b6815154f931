"""Strategies on tasks mined from a small history."""

import json
import os
import subprocess

import numpy as np
import pytest

from tessera import harness
from tessera.functions import text as tx
from tessera.operators import learning
from tessera.sources import python_code

BASE = "def load_rows(path):\n    return open(path).read()\n\n\ndef save_rows(path, rows):\n    check(rows)\n    return len(rows)\n"
OTHER = "def paint(shape):\n    return shape\n\n\ndef erase(shape):\n    return None\n"


def letters():
    return lambda texts: np.array([[t.lower().count(c) + 0.1 for c in "abcdefghijklmnopqrs"] for t in texts])


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    folder = tmp_path_factory.mktemp("repo")
    git = lambda *a: subprocess.run(["git", "-C", str(folder), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    commits = [
        ("first commit of everything", {"rows.py": BASE, "paint.py": OTHER}),
        ("load rows without the end of line", {"rows.py": BASE.replace(".read()", ".read().strip()")}),
        ("notes about the release only", {"notes.txt": "x"}),
        ("wip", {"paint.py": OTHER.replace("return shape", "return 1")}),
        ("paint gives the shape it got back", {"paint.py": OTHER.replace("return shape", "return shape or None")}),
        ("a module of nothing but new code", {"fresh.py": "def fresh():\n    return 1\n"}),
    ]
    for k, (subject, files) in enumerate(commits):
        for name, content in files.items():
            (folder / name).write_text(content)
        day = f"2024-01-0{k + 1}T00:00:00Z"
        os.environ |= {"GIT_AUTHOR_DATE": day, "GIT_COMMITTER_DATE": day}
        git("add", "."), git("commit", "-qm", subject)
    for name in ("GIT_AUTHOR_DATE", "GIT_COMMITTER_DATE"):
        del os.environ[name]
    return str(folder)


def test_mined(spark, repo):
    rows = harness.mined(spark, repo).orderBy("committed_at").collect()
    ids = [[python_code.symbol_id("rows.py", "load_rows", "function")], [python_code.symbol_id("paint.py", "paint", "function")]]
    assert [(r.truth_ids, r.truth_files) for r in rows] == [(ids[0], ["rows.py"]), (ids[1], ["paint.py"])]
    assert [r.description for r in harness.mined(spark, repo, most=1).collect()] == ["paint gives the shape it got back"]


def test_harness(spark, repo, tmp_path):
    ranker = learning.Ranker()
    data = [(i / 60, 0.0, j / 60, i > 5) for i in range(15) for j in range(15)]
    assert ranker.train(spark.createDataFrame(data, "lexical_score double, semantic_score double, centrality_score double, symbol_edited boolean"))
    words = tx.counted_by(lambda t: len(t.split()))
    rows = harness.run(spark, repo, letters(), most=1, ranker=ranker, cost=words)
    got = {(r.condition, r.strategy, r.metric): r.value for r in rows.collect()}
    assert {k[:2] for k in got} == {("oracle", "whole_files"), ("oracle", "governed"), ("end_to_end", "whole_files"), ("end_to_end", "fixed_chunks"), ("end_to_end", "governed"), *((c, s) for c in ("personal_pagerank", "churn", "learned_ranker") for s in ("with", "without"))}
    # Before the last change paint.py reads ``return 1``: the whole file has eight words, the symbol four, and a tenth more.
    assert got["oracle", "whole_files", "tokens"] == 9 and got["oracle", "governed", "tokens"] == 5
    assert got["oracle", "governed", "recall@5"] == 1 and got["end_to_end", "whole_files", "recall@5"] == 1
    # All four symbols fit the budget, so nothing is missed whatever the order.
    assert all(v == 1 for (_, _, m), v in got.items() if m == "recall@5")
    folder = harness.saved(rows, str(tmp_path / "results"), "now")
    (part,) = [x for x in os.listdir(folder) if x.endswith(".json")]
    lines = [json.loads(x) for x in open(f"{folder}/{part}")]
    assert len(lines) == len(got) and all(x["n"] == 1 and x["total"] == x["mean"] == got[x["condition"], x["strategy"], x["metric"]] for x in lines)


def test_churn_ends_at_the_commit(spark, repo):
    log = subprocess.run(["git", "-C", repo, "log", "--format=%H", "--reverse"], capture_output=True, check=True, text=True).stdout.split()
    at = harness.snapshot(spark, repo, log[1])
    churn = {r.id: r.churn for r in harness.churn_before(spark, repo, at, log[1]).collect()}
    touched = python_code.symbol_id("rows.py", "load_rows", "function")
    assert churn.pop(touched) == 1 and set(churn.values()) == {0.0}


def test_measured_without_truth(spark):
    one = harness.Retrieved(spark.createDataFrame([("a", 1)], "id string, rank int"), spark.createDataFrame([], "pos int, text string"))
    assert {r.metric: r.value for r in harness.measured(one, []).collect()} == {"recall@5": None, "recall@10": None, "tokens": 0.0}


def test_readers_and_counts(spark):
    assert python_code.reader_of("python")("a.py", b"x = 1")["error"] is None
    with pytest.raises(ValueError):
        python_code.reader_of("cobol")
    rows = spark.createDataFrame([("a b c",), ("",), (None,)], "t string")
    assert [r.n for r in rows.select(tx.counted_by(lambda t: len(t.split()))("t").alias("n")).collect()] == [4, 0, 0]
