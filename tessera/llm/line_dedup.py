"""Line dedup by winnowing over line hashes. DataFrame functions only.

A document is the sequence of its lines that hold more than ASCII white space. A run is long enough if it has ``run`` lines,
or fewer with more than ``words`` words together. Of every window of that least length the line with the least hash (the
last of equals) is selected: two equal windows select the same line at the same place, so selected hashes are guaranteed
fingerprints. Positions are joined on them and those whose fingerprint occurs once are dropped. Around the others matches
are extended both ways, to all windows that selected the position; equal windows share a class, whose first occurrence (by
document, then line) stays. Every line of a later one is deleted; overlapping windows make up longer runs.

Lines are compared by two 64-bit hashes. Work and rows grow in proportion to the lines, however many a document has: a
window is a short row without its document's other lines, and deleted lines are cut as runs. Fingerprints and classes of
many rows are split over tasks.

Blank lines stay where they are. Null texts have no lines and stay null; an empty text is one blank line. Documents are
ordered by id (null first), then by the hash of their text; rows that agree in both are one document, and all of them keep
the same lines. Extra columns pass through. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, checkpointed, free_name, let, split_join

RUN, WORDS = 3, 50


def _windows(text: Column, run: int, words: int) -> Column:
    """array of (fp, at: the selected line; start, n: the window's lines; a, b: hashes of its lines). Lines are numbered
    among the non-blank ones, from 1."""
    number = F.regexp_count
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(7), x).alias("g"), number(x, F.lit(WORD)).alias("w")))

    def of_length(lines: Column, n: int) -> Column:
        def window(s: Column) -> Column:
            held = [F.element_at(lines, s + k) for k in range(n)]
            least = F.array_min(F.array(*[F.struct(x["h"].alias("h"), (-s - k).alias("at")) for k, x in enumerate(held)]))
            whole = [F.xxhash64(F.lit(n), *[x[c] for x in held]).alias(name) for c, name in (("h", "a"), ("g", "b"))]
            return F.struct(least["h"].alias("fp"), (-least["at"]).alias("at"), s.alias("start"), F.lit(n).alias("n"), *whole)

        starts = F.sequence(F.lit(1), F.size(lines) - n + 1)
        if n < run:
            starts = F.filter(starts, lambda s: sum((F.element_at(lines, s + k)["w"] for k in range(n)), F.lit(0)) > words)
        return F.when(F.size(lines) >= n, F.transform(starts, window))

    return let(F.filter(lines, lambda x: x["w"] > 0), lambda ls: F.flatten(F.filter(F.array(*[of_length(ls, n) for n in range(1, run + 1)]), lambda x: x.isNotNull())))


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, run: int = RUN, words: int = WORDS) -> DataFrame:
    """(doc, of, start, n): each window that has an earlier equal. ``of`` is the hash of the text."""
    # The hash and the windows are columns before the explode, so that no window carries its text.
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("of"), _windows(F.col(text_col), run, words).alias("ws"))
    # Short rows, read twice: cheaper to keep than to take from the texts again.
    windows = checkpointed(rows.select("doc", "of", F.explode("ws").alias("w")).select("doc", "of", "w.*"))
    # Selected positions: a fingerprint with a single one can't be in a repeated window.
    place = F.xxhash64("doc", "of", "at")
    shared = windows.groupBy("fp").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    near = checkpointed(split_join(windows.withColumnRenamed("n", "long"), checkpointed(shared.select("fp", "n")), ["fp"], ["a", "doc", "of"], "left_semi").drop("fp", "at"))
    # Extension: windows with equal lines around a shared fingerprint, and the first of each kind.
    place = F.struct("doc", "of", "start")
    kinds = near.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).where(~F.col("first").eqNullSafe(F.col("last")))
    later = split_join(near, checkpointed(kinds.drop("last")), ["a", "b"], ["doc", "of", "start"]).where(place > F.col("first"))
    return later.select("doc", "of", "start", F.col("long").alias("n"))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, words: int = WORDS) -> DataFrame:
    """The rows with their text cut, and n_lines and n_removed (such columns of the input are replaced)."""
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    of, gone, doc, key = (free_name(names, x) for x in ("_of", "_gone", "_doc", "_key"))
    windows = repeated_windows(docs, id_col, text_col, run, words)
    # Deleted lines as ascending numbers among the non-blank ones, each once.
    lines = F.flatten(F.transform(F.collect_set(F.struct("start", "n")), lambda w: F.sequence(w["start"], w["start"] + w["n"] - 1)))
    lost = windows.groupBy(F.col("doc").alias(doc), F.col("of").alias(key)).agg(F.array_sort(F.array_distinct(lines)).alias(gone))
    marked = docs.withColumn(of, F.xxhash64(text_col))
    out = marked.join(lost, marked[id_col].eqNullSafe(lost[doc]) & (marked[of] == lost[key]), "left")

    def cut(all_lines: Column) -> Column:
        """The text without the deleted lines: what lies between the runs of them is sliced out."""
        full = F.filter(F.transform(all_lines, lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
        at = let(full, lambda numbers: F.transform(F.col(gone), lambda g: F.element_at(numbers, g)))  # line numbers, from 0
        begins = lambda x: F.filter(F.zip_with(x, F.concat(F.array(F.lit(-2)), F.slice(x, 1, F.size(x) - 1)), lambda a, b: F.when(a != b + 1, a)), lambda a: a.isNotNull())
        ends = lambda x: F.filter(F.zip_with(x, F.concat(F.slice(x, 2, F.size(x)), F.array(F.lit(-2))), lambda a, b: F.when(a != b - 1, a + 1)), lambda a: a.isNotNull())
        pieces = lambda x: F.zip_with(F.concat(F.array(F.lit(0)), ends(x)), F.concat(begins(x), F.array(F.size(all_lines))), lambda a, e: F.slice(all_lines, a + 1, e - a))
        return F.array_join(F.flatten(let(at, pieces)), "\n")

    kept = let(F.split(F.col(text_col), "\n"), cut)
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(F.split(F.col(text_col), "\n"))).cast("long")
    n_removed = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long")
    return out.select(*[F.when(F.col(gone).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`") for c in names], n_lines.alias("n_lines"), n_removed.alias("n_removed"))
