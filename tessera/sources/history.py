"""Git history as tables, through a Python data source that reads commits in parallel ranges."""

from __future__ import annotations

import difflib
import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.text import hunk_overlaps
from tessera.sources.python_code import read_file

# What makes a commit a task.
MOST_FILES, LEAST_SUBJECT = 15, 15
STOPLIST = r"(?i)^(merge|bump|release|chore\(deps\)|wip|typo|fix$)$"
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
COMMITS = "sha string, parents array<string>, subject string, committed_at double, files array<string>, whitespace_only boolean, diff string"


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")


class _Shas(InputPartition):
    def __init__(self, shas: list[str]):
        self.shas = shas


class CommitReader(DataSourceReader):
    """Options: path, ref (HEAD), since (epoch seconds), chunk (commits per partition)."""

    def __init__(self, options):
        self.repo, self.ref = options["path"], options.get("ref", "HEAD")
        self.since, self.chunk = options.get("since"), int(options.get("chunk", 50))

    def partitions(self) -> list[InputPartition]:
        args = ["rev-list", self.ref, *([f"--since={int(float(self.since))}"] if self.since else [])]
        shas = _git(self.repo, *args).split()
        return [_Shas(shas[i : i + self.chunk]) for i in range(0, len(shas), self.chunk)] or [_Shas([])]

    def read(self, partition: _Shas) -> Iterator[tuple]:
        for sha in partition.shas:
            parents, at, subject = _git(self.repo, "show", "-s", "--format=%P%x00%ct%x00%s", sha).rstrip("\n").split("\0")
            ps = parents.split()
            diff = _git(self.repo, "diff", "--unified=0", "--no-color", ps[0], sha) if ps else ""
            files = _git(self.repo, "diff", "--name-only", ps[0], sha).split("\n")[:-1] if ps else []
            blank = bool(diff) and not _git(self.repo, "diff", "-w", "--ignore-blank-lines", ps[0], sha)
            yield sha, ps, subject, float(at), files, blank, diff


class CommitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_commits"

    def schema(self) -> str:
        return COMMITS

    def reader(self, schema) -> DataSourceReader:
        return CommitReader(self.options)


def commits(spark: SparkSession, repo: str, **options) -> DataFrame:
    spark.dataSource.register(CommitSource)
    return spark.read.format("git_commits").options(path=repo, **options).load()


def blobs(spark: SparkSession, repo: str, ref: str, suffix: str = ".py") -> DataFrame:
    """(path, content) of a tree; files are read by the workers."""
    listed = [x for x in _git(repo, "ls-tree", "-r", "--name-only", ref).split("\n") if x.endswith(suffix)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["content"] = [subprocess.run(["git", "-C", repo, "show", f"{ref}:{p}"], capture_output=True, check=True).stdout for p in pdf["path"]]
            yield pdf[["path", "content"]]

    return spark.createDataFrame([(p,) for p in listed], "path string").repartition(max(1, len(listed) // 50)).mapInPandas(run, "path string, content binary")


def hunks(rows: DataFrame, diff: str = "diff") -> DataFrame:
    """sha, path, old_start, old_count, new_start, new_count of unified diffs; a missing count is 1."""
    files = rows.select("sha", F.explode(F.split(F.concat(F.lit("\n"), F.col(diff)), "\ndiff --git ")).alias("part")).where("part <> ''")
    path = F.regexp_extract("part", r"(?m)^--- a/(.*)$", 1)
    heads = files.select("sha", path.alias("path"), F.explode(F.split("part", "\n")).alias("line")).where(F.col("line").rlike(HUNK) & (F.col("path") != ""))
    n = lambda k: F.coalesce(F.nullif(F.regexp_extract("line", HUNK, k), F.lit("")), F.lit("1")).cast("int")
    return heads.select("sha", "path", n(1).alias("old_start"), n(2).alias("old_count"), n(3).alias("new_start"), n(4).alias("new_count"))


def hunks_between(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """Changed line ranges of two texts, in the form of unified diff headers without context."""
    out = []
    for tag, a, b, c, d in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if tag != "equal":
            out.append((a + (b > a), b - a, c + (d > c), d - c))
    return out


def qualifies() -> Column:
    return (F.size("parents") == 1) & (F.length("subject") >= LEAST_SUBJECT) & ~F.col("subject").rlike(STOPLIST) & (F.size("files") <= MOST_FILES) & ~F.col("whitespace_only")


def touched(changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """sha, id, with a row for every hunk that overlaps a symbol of the same file."""
    over = hunk_overlaps(F.col("old_start"), F.col("old_count"), F.col("line_start"), F.col("line_end"))
    s = symbols.select(F.col("id"), F.col("file_path").alias("path"), "line_start", "line_end")
    return changes.join(s, "path").where(over).select("sha", "id", "path", "old_start")


def tasks(rows: DataFrame, symbols_at_parent: DataFrame) -> DataFrame:
    """sha, description, committed_at, truth_ids, truth_files, new_symbols_added. symbols_at_parent: symbols with ``sha``."""
    usable = rows.where(qualifies())
    changes = hunks(usable).where(F.col("path").endswith(".py"))
    over = hunk_overlaps(F.col("old_start"), F.col("old_count"), F.col("line_start"), F.col("line_end"))
    s = symbols_at_parent.select("sha", F.col("file_path").alias("path"), "id", "line_start", "line_end")
    hit = changes.join(s, ["sha", "path"], "left").withColumn("over", F.coalesce(over, F.lit(False)))
    per_hunk = hit.groupBy("sha", "path", "old_start", "old_count").agg(F.max("over").alias("matched"), F.collect_set(F.when(F.col("over"), F.col("id"))).alias("ids"))
    found = per_hunk.groupBy("sha").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("truth_ids"), F.array_sort(F.collect_set("path")).alias("truth_files"), (~F.bool_and("matched")).alias("new_symbols_added"))
    return usable.select("sha", F.col("subject").alias("description"), "committed_at").join(found, "sha", "left")


def symbols_before(rows: DataFrame, repo: str) -> DataFrame:
    """(sha, id, file_path, line_start, line_end) of the Python files that commits change, as their first parents have them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for sha, parent, path in zip(pdf["sha"], pdf["parent"], pdf["path"], strict=True):
                content = subprocess.run(["git", "-C", repo, "show", f"{parent}:{path}"], capture_output=True, check=True).stdout
                found += [(sha, s["id"], path, s["line_start"], s["line_end"]) for s in read_file(path, content)["symbols"]]
            yield pd.DataFrame(found, columns=["sha", "id", "file_path", "line_start", "line_end"])

    changed = hunks(rows).where(F.col("path").endswith(".py")).select("sha", "path").distinct()
    at = changed.join(rows.select("sha", F.col("parents")[0].alias("parent")), "sha").select("sha", "parent", "path")
    return at.mapInPandas(run, "sha string, id string, file_path string, line_start int, line_end int")


def split_by_time(rows: DataFrame, cutoff: float) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col("committed_at") < cutoff), rows.where(F.col("committed_at") >= cutoff)


def file_index(symbols: DataFrame) -> DataFrame:
    """(path, ids) for incremental refresh."""
    return symbols.groupBy(F.col("file_path").alias("path")).agg(F.sort_array(F.collect_list("id")).alias("ids"))


def stale_files(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files that are new or whose hash differs. files: (path, content); cache: (path, file_hash)."""
    now = files.withColumn("file_hash", F.sha2("content", 256))
    return now.join(cache.select("path", F.col("file_hash").alias("_old")), "path", "left").where(~F.col("file_hash").eqNullSafe(F.col("_old"))).drop("_old")


def newest_first(rows: DataFrame, most: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.orderBy(F.col("committed_at").desc(), "sha"))).where(F.col("_n") <= most).drop("_n")
