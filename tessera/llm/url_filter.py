"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over ``host + path``. Of its literal tokens (whole alphanumeric runs that any
matching URL must contain) the one that the fewest URLs hold is its index key. A URL's own tokens fetch candidate
rules and only those run their expressions, so the cost of a URL does not grow with the number of rules.

Rules beyond ``RULES_PER_PASS`` are worked off in passes; of equal ranks the first rule wins. Rows: one per input row, URLs
of any length whole. A null URL, or one without ``://``, has an empty host and path and no rule. Repeated rows are
judged alike. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER

TOKEN = re.compile(r"[0-9a-zA-Z]+")
#: More rules than this are matched in several passes over the URLs, so that what a task holds stays bounded.
RULES_PER_PASS = 50_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path. ``tokens``: whole tokens that every match holds (may be empty: always run).
    Of the matching rules the highest ``rank`` wins; at equal ranks the first."""

    name: str | None
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host, its subdomains and a path prefix. Longer rules win over shorter ones and over plain patterns."""
    whole = TOKEN.findall(host)
    # The last token of the path may be the beginning of a longer one, unless a separator follows it.
    inner = [m.group() for m in TOKEN.finditer(path) if m.end() < len(path)]
    pattern = rf"\A(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}" if path else rf"\A(?:[^/?#]*\.)?{re.escape(host)}(?=/|\Z)"
    return Rule(host + path, pattern, tuple(dict.fromkeys(whole + inner)), verdict, 1 + len(host + path))


def rules_of(table: DataFrame) -> Iterator[Rule]:
    """Rules from rows (name, pattern, tokens array, verdict, rank), in the order of rank, name and pattern, as a stream; equal
    rows are one rule, rows without a pattern or a verdict none. Null tokens: the rule runs on every URL."""
    rows = table.select("name", "pattern", "tokens", "verdict", F.coalesce("rank", F.lit(0)).cast("long").alias("rank")).where("pattern is not null and verdict is not null").distinct()
    for r in rows.orderBy(F.desc("rank"), "name", "pattern", "verdict").toLocalIterator():
        yield Rule(r["name"], r["pattern"], tuple(r["tokens"] or ()), r["verdict"], r["rank"])


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rarest_tokens(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """How many rows of ``urls`` (host, path) hold each token of a rule; absent ones are not in the result."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    counts: dict[str, int] = {}
    for i in range(0, len(wanted), RULES_PER_PASS):
        some = urls.sparkSession.createDataFrame([(t,) for t in wanted[i : i + RULES_PER_PASS]], "token string")
        tokens = F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit("([0-9a-zA-Z]+)"), 1))
        found = urls.select(F.explode(tokens).alias("token")).join(F.broadcast(some), "token", "left_semi")  # at most RULES_PER_PASS tokens
        counts |= {r["token"]: r["count"] for r in found.groupBy("token").count().collect()}  # at most one row for each rule token
    return counts


def index_rules(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[tuple]], list[tuple]]:
    """token -> rules that it fetches; and the rules without tokens, which every URL runs."""
    index: dict[str, list[tuple]] = {}
    always = []
    for order, r in enumerate(rules):
        entry = (r.rank, -order, re.compile(r.pattern), r.name, r.verdict)
        if r.tokens:
            index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(entry)
        else:
            always.append(entry)
    return index, always


def judge(urls: DataFrame, rules: list[Rule], *, id_col: str, url_col: str, default: str = "allow") -> DataFrame:
    """id, host, path, rule (name of the winning rule, null for plain patterns and for none) and verdict of every row."""
    parts = urls.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    counts = rarest_tokens(parts, rules)
    out = parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default), "best": F.lit(-1).cast("long")})
    id_type = dict(parts.dtypes)[id_col]
    for i in range(0, len(rules), RULES_PER_PASS):
        index, always = index_rules(rules[i : i + RULES_PER_PASS], counts)

        def run(batches: Iterator[pa.RecordBatch], index=index, always=always) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
                rule, verdict, best = (b.column(k).to_pylist() for k in (3, 4, 5))
                for k, (h, p) in enumerate(zip(hosts, paths, strict=True)):
                    if not h and not p:
                        continue
                    s = h + p
                    found = [e for t in set(TOKEN.findall(s)) for e in index.get(t, ())]
                    hits = [e for e in (*found, *always) if e[2].search(s)]
                    if hits and (top := max(hits, key=lambda e: e[:2]))[0] > best[k]:
                        best[k], rule[k], verdict[k] = top[0], top[3], top[4]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(best, pa.int64())], names=b.schema.names)

        out = out.mapInArrow(run, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string, best long")
    return out.drop("best")
