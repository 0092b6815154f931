"""Queries over kept state: the build ledger and session notes, with events as what was written to them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import ledger, notes
from tessera.plans.tables import TRANSITIONS, edges_and_nodes, table


def ledger_entries(spark, d):
    """Events set the statuses of their users, who depend on each other by repeated transitions; users with more errors than
    signups have changed since."""
    e = table(spark, d, "events")
    status = F.when(F.col("event_type").isin("purchase", "click", "view"), "done").when(F.col("event_type") == "signup", "in_progress").otherwise("planned")
    user = F.col("user_id").cast("string")
    changes = e.select(user.alias("symbol_id"), status.alias("status"), F.when(F.col("event_type") == "error", F.col("event_id").cast("string")).alias("note"), F.col("event_id").alias("at"))
    n = e.groupBy(user.alias("id")).agg(F.count_if(F.col("event_type") == "signup").alias("s"), F.count_if(F.col("event_type") == "error").alias("e"))
    then, now = (n.select("id", F.concat(F.lit("v"), v).alias("content_hash")) for v in (F.col("s"), F.greatest("s", "e")))
    merged, _ = edges_and_nodes(spark, d)
    edges = merged.where("weight > 1").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.when(F.col("edge_type") == "purchase", "TESTS").otherwise("CALLS").alias("edge_type"), "weight")
    out = ledger.listed(ledger.applied(ledger.empty(spark), changes, then, edges), now, edges)
    return out.select("symbol_id", "status", F.array_join("depends_on", ",").alias("depends_on"), "has_test", "content_hash_at_done", "note", "updated_at")


LEDGER = f"""WITH {TRANSITIONS}, m AS (SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, CASE WHEN edge_type = 'purchase' THEN 'TESTS' ELSE 'CALLS' END AS kind FROM edges WHERE weight > 1 AND src <> dst),
v AS (SELECT CAST(user_id AS VARCHAR) AS symbol_id, event_id, event_type, CASE WHEN event_type IN ('purchase', 'click', 'view') THEN 'done' WHEN event_type = 'signup' THEN 'in_progress' ELSE 'planned' END AS st FROM events),
c AS (SELECT symbol_id, arg_max(st, event_id) AS status, bool_or(st = 'done') AS done, CAST(max(event_id) FILTER (event_type = 'error') AS VARCHAR) AS note, CAST(max(event_id) AS DOUBLE) AS updated_at,
  count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'error') AS e FROM v GROUP BY symbol_id),
own AS (SELECT symbol_id FROM c WHERE status = 'done' AND e > s),
one AS (SELECT DISTINCT src FROM m WHERE dst IN (FROM own)),
stale AS (FROM own UNION SELECT src FROM one UNION SELECT src FROM m WHERE dst IN (SELECT src FROM one))
SELECT symbol_id, CASE WHEN status = 'done' AND symbol_id IN (FROM stale) THEN 'stale' ELSE status END AS status,
  coalesce((SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM m WHERE src = symbol_id AND kind = 'CALLS'), '') AS depends_on,
  symbol_id IN (SELECT dst FROM m WHERE kind = 'TESTS') AS has_test, CASE WHEN done THEN 'v' || s END AS content_hash_at_done, note, updated_at FROM c"""


def _log(spark, d):
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select(F.col("event_id").alias("note_id"), F.col("user_id").alias("session_id"), F.col("props").alias("content"), (F.floor("value") % 5 + 1).cast("int").alias("importance"), turn.alias("turn_index"))


def notes_active(spark, d):
    """Each session's working set with current importance."""
    return notes.active(_log(spark, d)).select("session_id", "note_id", "turn_index", F.round("current", 6).alias("current"))


def notes_recent(spark, d):
    return notes.recent(notes.active(_log(spark, d))).select("session_id", "note_id", "pick")


NOTES = """l AS (SELECT event_id AS note_id, user_id AS session_id, CAST(floor(value) AS BIGINT) % 5 + 1 AS importance, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn_index FROM events),
p AS (SELECT *, max(turn_index) OVER (PARTITION BY session_id) AS latest, row_number() OVER (PARTITION BY session_id ORDER BY ln(importance) - turn_index * ln(0.85) DESC, note_id) AS place FROM l),
a AS (SELECT session_id, note_id, turn_index, importance * pow(0.85, latest - turn_index) AS current FROM p WHERE place <= 50)"""

QUERIES = {f.__name__: f for f in (ledger_entries, notes_active, notes_recent)}
ORACLES = {
    "ledger_entries": LEDGER,
    "notes_active": f"WITH {NOTES} SELECT session_id, note_id, turn_index, round(current, 6) AS current FROM a",
    "notes_recent": f"WITH {NOTES} SELECT session_id, note_id, pick FROM (SELECT session_id, note_id, row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC, note_id) AS pick FROM a) WHERE pick <= 10",
}
