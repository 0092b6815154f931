"""Kept state: ledger, notes, snapshots and indexes that are refreshed instead of built."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import api
from tessera.operators import governor, ledger, notes
from tessera.plans import state
from tessera.sources import python_code, snapshots

SF = "/root/testdata/sf0.001"
CHANGES = "symbol_id string, status string, note string, at double"


def letters():
    """An embedder by counts of letters; workers get it by value."""
    return lambda texts: np.array([[t.count(c) + 0.1 for c in "abcdefghij"] for t in texts])


embedder = letters()


@pytest.mark.parametrize("name", sorted(state.QUERIES))
def test_against_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS FROM '{SF}/events.parquet'")
    want = db.sql(state.ORACLES[name])
    got = state.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_ledger(spark):
    symbols = lambda **h: spark.createDataFrame(list(h.items()), "id string, content_hash string")
    edges = spark.createDataFrame([("a", "b", "CALLS", 1), ("b", "c", "CALLS", 1), ("t", "b", "TESTS", 1), ("a", "a", "CALLS", 1)], "src string, dst string, edge_type string, weight long")
    first = spark.createDataFrame([("a", "planned", "first", 1.0), ("a", "done", None, 2.0), ("c", "done", None, 1.0), ("b", "in_progress", None, 1.0), ("gone", "done", None, 1.0)], CHANGES)
    now = symbols(a="1", b="1", c="1")
    one = ledger.applied(ledger.empty(spark), first, now, edges)
    by = {r.symbol_id: r for r in one.collect()}
    assert (by["a"].status, by["a"].depends_on, by["a"].note, by["a"].content_hash_at_done) == ("done", ["b"], "first", "1")
    assert by["b"].has_test and not by["a"].has_test and by["gone"].content_hash_at_done is None and by["c"].depends_on == []
    # Dependencies and tests stay as they were when the entry was made.
    two = ledger.applied(one, spark.createDataFrame([("b", "done", "n", 3.0)], CHANGES), now, edges.where("false"))
    b = two.where("symbol_id = 'b'").first()
    assert (b.status, b.depends_on, b.has_test, b.note) == ("done", ["c"], True, "n") and two.count() == 4
    assert {r.symbol_id for r in ledger.listed(two, symbols(a="1", b="1", c="2"), edges, "stale").collect()} == {"a", "b", "c"}
    assert [r.symbol_id for r in ledger.listed(two, now, edges).collect()] == ["a", "b", "c", "gone"]
    with pytest.raises(Exception, match="can't be set"):
        ledger.applied(one, spark.createDataFrame([("a", "stale", None, 1.0)], CHANGES), now, edges).collect()
    assert ledger.applied(ledger.empty(spark), spark.createDataFrame([], CHANGES), now, edges).count() == 0


def test_notes_equal_a_replay(spark):
    """The window keeps what a working set keeps that drops its least note on every write."""
    rng = random.Random(4)
    rows = [(f"{s}-{i:03}", s, f"text {i}", rng.randint(1, 5), float(i)) for s in "xy" for i in range(40 if s == "x" else 5)]
    df = spark.createDataFrame(rows, "note_id string, session_id string, content string, importance int, timestamp double")
    none = df.limit(0).withColumn("turn_index", F.lit(0))
    log = notes.appended(none, df.where("timestamp < 20"))
    log = log.unionByName(notes.appended(log, df.where("timestamp >= 20")))
    got = {s: {r.note_id: r.current for r in notes.active(log, 12).where(F.col("session_id") == s).collect()} for s in "xy"}
    for s in "xy":
        replay = governor.Notes(12)
        for note_id, _, content, importance, _ in (r for r in rows if r[1] == s):
            replay.write(note_id, content, importance)
        want = {n: replay.cache.score(n) for n in replay.cache.base}
        assert got[s].keys() == want.keys() and all(abs(got[s][n] - want[n]) < 1e-9 for n in want)
    assert [r.note_id for r in notes.recent(notes.active(log, 12), 2).where("session_id = 'y'").orderBy("pick").collect()] == ["y-004", "y-003"]
    with pytest.raises(ValueError):
        notes.active(log, 5)
    with pytest.raises(Exception, match="importance"):
        notes.appended(none, df.withColumn("importance", F.lit(6))).collect()


def test_relevant_notes(spark):
    rows = [("n1", "s", "cache badge fade", 3, 1), ("n2", "s", "cache badge fade", 3, 2), ("n3", "s", "hij jih hhh", 1, 3)]
    log = spark.createDataFrame(rows, "note_id string, session_id string, content string, importance int, turn_index int")
    got = [r.note_id for r in notes.relevant(notes.active(log), "cache badge", F.col("content"), embedder, 2).orderBy("pick").collect()]
    # Twice 1/62 x 3 x 0.85 beats n3's twice 1/63; then n1 repeats n2 word for word, so n3 follows.
    assert got == ["n2", "n3"]


def test_snapshots(spark, tmp_path):
    folder, schema = f"{tmp_path}/t", "a int"
    assert snapshots.load(spark, folder, schema).count() == 0
    for n in range(1, 5):
        before = snapshots.load(spark, folder, schema)
        snapshots.save(before.unionByName(spark.createDataFrame([(n,)], schema)), folder)
    (tmp_path / "t" / "v9").mkdir()  # a write that never ended
    assert snapshots.versions(spark, folder) == [3, 4]
    assert sorted(r.a for r in snapshots.load(spark, folder, schema).collect()) == [1, 2, 3, 4]


BODY = "def {}(a):\n    '''adds a bag of beads'''\n    return {}\n"


def test_only_changed_files_are_parsed(spark, tmp_path, monkeypatch):
    table = lambda files: spark.createDataFrame([(p, bytearray(c.encode())) for p, c in files.items()], "path string, content binary")
    old = {"a.py": BODY.format("bead", "1"), "b.py": BODY.format("beads", "2"), "c.py": BODY.format("beat", "bead(a)") + "\n"}
    folder = str(tmp_path / "index")
    index = api.opened(spark, table(old), folder, embedder)
    like = {(r.a, r.b) for r in index.duplicates(0.9).collect()}
    ids = {r.qualified_name: r.id for r in index.code.symbols.collect()}
    pair = lambda x, y: tuple(sorted((ids[x], ids[y])))
    assert pair("bead", "beads") in like and pair("bead", "beat") not in like  # beat calls bead
    shown = {r.check: r for r in index.check(1).collect()}
    assert set(shown) == {"dead_code", "duplicates"} and shown["duplicates"].total == len(like) and len(shown["duplicates"].findings) == 1
    new = {"a.py": old["a.py"], "c.py": BODY.format("other", "3")}
    seen, real = [], python_code.facts
    monkeypatch.setattr(python_code, "facts", lambda files: (seen.append({r.path for r in files.select("path").collect()}), real(files))[1])
    again = api.refreshed(index, table(new), embedder)
    later = api.opened(spark, table(new), folder, embedder)
    other = api.opened(spark, table(new), folder, embedder, profile="large")
    assert seen == [{"c.py"}, {"c.py"}, {"a.py", "c.py"}]
    whole = api.build(spark, table(new), embedder)
    rows = lambda i: sorted((r.id, r.content_hash) for r in i.code.symbols.collect())
    assert rows(again) == rows(later) == rows(other) == rows(whole) and again.embeddings.count() == whole.embeddings.count()
