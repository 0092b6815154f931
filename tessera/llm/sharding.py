"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows fall into virtual partitions by a hash of the key and the tie columns, one for each ``TASK_ROWS`` rows. The matrix says how many rows each partition sends to each shard; its rows
sum to the partitions' counts, its columns to the shard sizes, and it is drawn from the multivariate hypergeometric law,
so that dealing it out after a local permutation equals cutting one global permutation. Within a shard rows are permuted
again, by sub-buckets, so no task ever orders a whole shard.

Law: ``rows`` (shard sizes at most one apart). Texts that are equal are dealt like any others. Null keys and null texts
are rows like others; texts of any length move once; an empty table gives an empty result. Rows that agree in every ordering column (repeated rows) are
interchangeable. Reruns over the same rows agree, whatever the number of tasks.

Everything is DataFrame code; only the partition counts (a short row for each ``TASK_ROWS`` rows) reach the driver, for the draw.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_name

#: Rows that a task orders, on average; at least PARTITIONS virtual partitions and sub-buckets of a shard.
TASK_ROWS, PARTITIONS, SEED = 1 << 18, 512, "deal"


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Exact draw: how many of ``draws`` balls out of good + bad are good. Inversion outwards from the mode."""
    lo, hi = max(0, draws - bad), min(good, draws)
    if lo >= hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    lg = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p_mode = math.exp(lg(good, mode) + lg(bad, draws - mode) - lg(good + bad, draws))
    left = rng.random() - p_mode
    up, down, p_up, p_down = mode, mode, p_mode, p_mode
    while left > 0 and (down > lo or up < hi):
        if up < hi:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > lo:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if p_up + p_down < 1e-300:
            break
    return mode


def communication_matrix(counts: list[int], shards: int, seed: str) -> list[list[int]]:
    """Rows sum to ``counts``; columns to shard sizes that differ by one at most."""
    rng, total = random.Random(seed), sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in counts:
        row, left, free = [], n, sum(room)
        for s in range(shards):
            x = hypergeometric(rng, room[s], free - room[s], left)
            free -= room[s]
            left -= x
            row.append(x)
        room = [r - x for r, x in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def _stride(n: int) -> int:
    """A number near the golden section of n without a common factor."""
    step = max(1, round(n * 0.6180339887498949))
    while math.gcd(step, n) > 1:
        step += 1
    return step


def deal(rows: DataFrame, key: Column, *, shards: int = 8, ties: list[Column] | None = None, seed: str = SEED, partitions: int = PARTITIONS) -> DataFrame:
    """``rows`` with int ``shard`` and long ``slot`` (gapless from 0 in each shard); such columns of the input are replaced.
    ``ties``: orders rows whose keys are equal."""
    rows = rows.drop("shard", "slot")
    names = rows.columns
    at, part, order, bucket, local, ends, start = (free_name(names, x) for x in ("_at", "_part", "_order", "_bucket", "_local", "_ends", "_start"))
    tie = [c.asc_nulls_first() for c in ties or []]
    # A hash of the key and the ties chooses the partition and the local order: rows of one key are dealt apart.
    placed = rows.withColumn(at, F.xxhash64(F.lit(f"{seed}/1"), key, *(ties or [])))
    fine = dict(placed.groupBy(F.pmod(F.col(at), F.lit(partitions)).alias(part)).count().collect())  # at most `partitions` rows
    total = sum(fine.values())
    wanted = -(-total // TASK_ROWS)
    if wanted > partitions:  # as many partitions as tasks are needed: a short row for each
        partitions = wanted
        fine = dict(placed.groupBy(F.pmod(F.col(at), F.lit(partitions)).alias(part)).count().collect())
    buckets = max(PARTITIONS, wanted // shards)
    counts = [fine.get(p, 0) for p in range(partitions)]
    matrix = communication_matrix(counts, shards, seed)
    listed = [(p, list(accumulate(m)), n, _stride(n)) for p, (m, n) in enumerate(zip(matrix, counts, strict=True))]
    ends_df = rows.sparkSession.createDataFrame(listed, f"`{part}` long, `{ends}` array<long>, _n long, _stride long")
    number = F.row_number().over(Window.partitionBy(part).orderBy(at, key, *tie)) - 1
    dealt = (
        placed.withColumn(part, F.pmod(F.col(at), F.lit(partitions)))
        .withColumn(local, number)
        .join(F.broadcast(ends_df), part)  # `partitions` short rows: one for each TASK_ROWS rows of the input
        # A local permutation by a stride, so that repeated rows part; then the matrix says who goes to which shard.
        .withColumn(order, F.pmod(F.col(local) * F.col("_stride"), F.col("_n")))
        .withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col(order))).cast("int"))
        .withColumn(order, F.xxhash64(F.lit(f"{seed}/2"), at, local))
        .drop(ends, part, "_n", "_stride")
        .withColumn(bucket, F.pmod(F.col(order), F.lit(buckets)).cast("int"))
    )
    # Where each sub-bucket begins in its shard: counted anew from the same plan, in at most shards x buckets groups.
    sizes = dealt.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias(part))
    starts = sizes.select("shard", bucket, (F.sum(part).over(Window.partitionBy("shard").orderBy(bucket)) - F.col(part)).alias(start))
    return (
        dealt.withColumn(local, F.row_number().over(Window.partitionBy("shard", bucket).orderBy(order, at, key, *tie)))
        .join(F.broadcast(starts), ["shard", bucket])  # shards x buckets short rows
        .withColumn("slot", F.col(start) + F.col(local) - 1)
        .select(*[F.col(f"`{c}`") for c in names], "shard", "slot")
    )
