"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share ``share`` of all words; a target stops
at ``cap`` times its source's words and the excess goes to the others by weight, until none is above (water-filling, in
closed form over the sorted ratios cap * words / weight).

Schedule: slot i has the point frac((i + 1) * golden ratio), in exact integers modulo 2^62, which falls into one source's interval of the cumulative
targets; so every prefix of the schedule is mixed nearly to target. The r-th slot of a source takes the r-th block of
that source: its documents in hash order, laid end to end (twice at most), cut into blocks of equally many words.

A block has total / 65536 words, 16 to 1024. A source gets its target to within a few blocks, never more than ``cap`` (2)
times its words. Null and empty texts have no words: they count as documents of their source and are never taken.
Repeated rows are documents of their own; documents of equal hash are ordered by key, size and the carried columns, and
rows that agree in all of them are interchangeable. A text of any length is its number of words. An empty table gives an
empty result.

All sums that meet in one task are over sources, over (source, bucket) pairs or over (segment, source) pairs, never over
the documents or slots of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, hash60

#: The golden ratio as an odd multiple of 2^-62.
GOLDEN = 2850178704830799621
CELLS, SEGMENT, MICRO = 4096, 65536, 1_000_000
#: Rows of a source that meet in one task, on average.
BUCKET_ROWS = 16384
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2


def targets(sized: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target and lo, hi (cumulative targets in millionths of a word) of each source."""
    every, upto = Window.orderBy("ratio", "pos"), Window.orderBy("pos")  # one row for each source
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights) + 1).cast("int")).cast("long")
    ranked = sums.withColumn("pos", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", w)
    ranked = ranked.withColumn("ratio", F.col("source_size") * cap / F.col("w"))
    # With the first j sources (by ratio) at their caps, the others' level is (total - capped) / weight left.
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    after = every.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    total = F.sum("source_size").over(all_rows).cast("double") * share
    levels = ranked.withColumn("level", (total - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap) / F.sum("w").over(after))
    # The first source whose cap is at or above the level ends the capped ones.
    found = levels.withColumn("stop", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "pos", "level"))).over(all_rows))
    target = F.when(F.col("stop").isNull() | (F.struct("ratio", "pos") < F.struct("stop.ratio", "stop.pos")), F.col("source_size").cast("double") * cap).otherwise(F.col("w") * F.col("stop.level"))
    out = found.withColumn("target", target).withColumn("micro", F.round(F.col("target") * MICRO).cast("long"))
    return out.select("source", "source_size", "rows", "target", "micro", "pos", F.sum("micro").over(upto).alias("hi")).withColumn("lo", F.col("hi") - F.col("micro"))


def laid_out(sized: DataFrame, key: Column, ties: list[Column], bits: int) -> DataFrame:
    """Each document's place in its source's stream: words [start, start + size) in hash order. The 2^bits ranges of the hash
    are summed apart; the order does not depend on them."""
    hashed = hash60(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.col("size").cast("string")), "mix")
    placed = sized.withColumn("at", hashed).withColumn("bucket", F.shiftright("at", 60 - bits))
    by_bucket = placed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    starts = by_bucket.select("source", "bucket", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("base"))
    order = Window.partitionBy("source", "bucket").orderBy("at", key, *[t.asc_nulls_first() for t in ties]).rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.withColumn("inner", F.sum("size").over(order) - F.col("size"))
    same = (inner["bucket"] == starts["bucket"]) & inner["source"].eqNullSafe(starts["source"])
    return inner.join(starts, same).select(*[inner[c] for c in sized.columns], (F.col("base") + F.col("inner")).alias("start"))


def golden(i: Column) -> Column:
    """i * GOLDEN modulo 2^62, without overflow: any number of points keeps its low discrepancy."""
    mask = (1 << 31) - 1
    high, low = F.shiftright(i, 31), i.bitwiseAND(F.lit(mask).cast("long"))
    g1, g0 = F.lit(GOLDEN >> 31).cast("long"), F.lit(GOLDEN & mask).cast("long")
    middle = (low * g1 + high * g0).bitwiseAND(F.lit(mask).cast("long"))
    return (low * g0 + F.shiftleft(middle, 31)).bitwiseAND(F.lit((1 << 62) - 1).cast("long"))


def schedule(goal: DataFrame, slots: int, total_micro: int) -> DataFrame:
    """pos (of the source) and block (rank of the slot among the source's) of every slot."""
    spark = goal.sparkSession
    cell = lambda x: F.floor(x / F.lit(total_micro) * CELLS).cast("long")
    # Each source's interval is listed in the cells that it touches: CELLS + sources rows in all.
    cells = goal.where("micro > 0").select("pos", "lo", "hi", F.explode(F.sequence(F.greatest(cell(F.col("lo")) - 1, F.lit(0)), cell(F.col("hi")) + 1)).alias("cell"))
    at = F.floor(golden(F.col("id") + 1).cast("double") / F.lit(float(1 << 62)) * F.lit(float(total_micro))).cast("long")
    points = spark.range(slots).select("id", at.alias("at")).withColumn("cell", cell(F.col("at")))
    drawn = points.join(cells, "cell").where("at >= lo and at < hi").select("id", "pos", F.floor(F.col("id") / SEGMENT).alias("segment"))
    firsts = drawn.groupBy("segment", "pos").count().select("segment", "pos", (F.sum("count").over(Window.partitionBy("pos").orderBy("segment")) - F.col("count")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("segment", "pos").orderBy("id")) - 1
    return drawn.withColumn("rank", rank).join(firsts, ["segment", "pos"]).select("id", "pos", (F.col("first") + F.col("rank")).cast("long").alias("block"))


def mix(docs: DataFrame, key: Column, source: Column, size: Column, *, carry: dict[str, Column] | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """A row per document: key, ``carry`` (of any names but those of the other result columns), source, size, source_size, target, taken, first_taken (words taken of its
    first appearance; the rest is of the repeat)."""
    # Carried columns go under names of their own, which can't clash with those used here.
    shown = {f"carried_{i}": n for i, n in enumerate(carry or {})}
    carry = dict(zip(shown, (carry or {}).values(), strict=True))
    sized = docs.select(key.alias("key"), source.alias("source"), size.cast("long").alias("size"), *[c.alias(n) for n, c in carry.items()])
    goal = checkpointed(targets(sized, weights=weights, share=share, cap=cap))  # a row for each source
    sums = goal.agg(F.sum("source_size").alias("words"), F.sum("micro").alias("micro"), F.sum("rows").alias("rows")).first()
    words, micro = sums["words"] or 0, sums["micro"] or 0
    block = max(16, min(1024, words // 65536))
    slots = round(micro / MICRO / block)
    bits = max(4, ((sums["rows"] or 0) // BUCKET_ROWS).bit_length())
    placed = laid_out(sized, F.col("key"), [F.col("size"), *map(F.col, carry)], bits)
    placed = placed.join(goal.select(F.col("source").alias("s"), "source_size", "target", "pos"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    named = [F.col(c).alias(n) for c, n in shown.items()]
    if not slots:
        return placed.select("key", *named, "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("first_taken"))
    # The words of each appearance that lie in each block.
    begin = F.col("start") + F.col("epoch") * F.col("source_size")
    spans = placed.where("size > 0").select("pos", "start", "size", F.explode(F.array(*map(F.lit, range(cap)))).alias("epoch"), "source_size").withColumn("a", begin).withColumn("b", F.col("a") + F.col("size"))
    pieces = spans.select("pos", "start", "size", "epoch", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))).alias("block"))
    pieces = pieces.select("pos", "start", "epoch", "block", (F.least("b", (F.col("block") + 1) * block) - F.greatest("a", F.col("block") * block)).alias("n"))
    got = pieces.join(schedule(goal, slots, micro), ["pos", "block"])
    got = got.groupBy("pos", "start").agg(F.sum("n").alias("taken"), F.coalesce(F.sum(F.when(F.col("epoch") == 0, F.col("n"))), F.lit(0)).alias("first_taken"))
    # Documents without words share their start with the next one, but take nothing.
    got = got.withColumnsRenamed({"pos": "p", "start": "s"})
    out = placed.join(got, (F.col("pos") == F.col("p")) & (F.col("start") == F.col("s")) & (F.col("size") > 0), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("key", *named, "source", "size", "source_size", "target", zero("taken"), zero("first_taken"))
