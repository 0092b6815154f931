"""Exact top-k inner products by distributed histogram selection.

Vectors become integers, floor(scale * x) of each component. Queries are taken in groups whose vectors and whose
histograms have bounded bytes (``query_bytes``); a group is
broadcast, scored against every vector in blocks, and the score range is refined by global histograms: each round
counts, for each query, the scores that fall in each of ``BINS`` cells of its current interval and narrows the interval
to the cell that holds the kth highest, until a cell is one score wide. That score is the kth value. A last pass keeps
the scores at or above it; what exceeds k are ties at the kth value, broken by the smaller id.

A block counts only from the cell of its own kth highest upwards (lower ones cannot hold the global kth), so it sends
few rows, and of ties it sends at most the k smallest ids: copies of one vector do not multiply.

Null vectors, and vectors with null or non-finite components, take no part, as query or as candidate; neither do rows
with null ids. Vectors of different lengths are compared on the shorter one's components. Repeated rows are candidates of
their own (a query excludes every row of its own id). Fewer candidates than k: all are returned. Scores are 64-bit
integers; where float arithmetic could round, integers are used. Vectors of any length are read whole; extra columns are
not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shared_folder

BINS, QUERY_BYTES, BLOCK = 512, 8 << 20, 4096


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): integer vectors of the rows that take part."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    return vectors.where(x.isNotNull() & F.col(id_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows padded with zeros (or cut) to ``width``."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all() and sizes[0] == width:
        return flat.reshape(-1, width)
    out, starts = np.zeros((len(sizes), width), np.int64), np.r_[0, np.cumsum(sizes)]
    for i, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=False)):
        out[i, : min(n, width)] = flat[a : a + min(n, width)]
    return out


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if bound < 2**53 else q @ c.T


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for i in range(0, b.num_rows, BLOCK):
            part = b.slice(i, BLOCK)
            yield part.column(0).to_numpy(), _matrix(part.column(1), width)


def _histogram_pass(state, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, low, step, above = state.value
        total: dict[tuple[int, int], int] = {}
        for cid, c in _blocks(batches, q.shape[1]):
            for a in range(0, len(ids), 256):
                s = _scores(q[a : a + 256], c)
                own = ids[a : a + 256, None] == cid[None, :]
                # Cell BINS: above the interval (counted in earlier rounds); -1: below it.
                cell = np.clip((s - low[a : a + 256, None]) // step[a : a + 256, None], -1, BINS)
                cell[own] = -1
                if (n := cell.shape[1]) > k:
                    floor = np.partition(cell, n - k, axis=1)[:, n - k]
                    keep = (cell >= floor[:, None]) & (cell >= 0) & (cell < BINS)
                else:
                    keep = (cell >= 0) & (cell < BINS)
                row, col = np.nonzero(keep)
                pairs, counts = np.unique((row + a) * BINS + cell[row, col], return_counts=True)
                for p, m in zip(pairs.tolist(), counts.tolist(), strict=True):
                    total[p] = total.get(p, 0) + m
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["cell", "n"])

    return run


def _final_pass(state, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, kth = state.value
        for cid, c in _blocks(batches, q.shape[1]):
            qs, cs, ss = [], [], []
            for a in range(0, len(ids), 256):
                s = _scores(q[a : a + 256], c)
                keep = (s >= kth[a : a + 256, None]) & (ids[a : a + 256, None] != cid[None, :])
                row, col = np.nonzero(keep)
                order = np.lexsort((cid[col], -s[row, col], row))
                row, col = row[order], col[order]
                first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
                begin = np.maximum.accumulate(np.where(first, np.arange(len(row)), 0)) if len(row) else row
                top = np.arange(len(row)) - begin < k  # of a block no more than k can be needed
                qs.append(ids[a : a + 256][row[top]])
                cs.append(cid[col[top]])
                ss.append(s[row[top], col[top]])
            if qs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (qs, cs, ss)], names=["query_id", "id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank (from 1), id_col, score: the k highest of every query (``is_query`` reads the input's columns)."""
    spark = vectors.sparkSession
    candidates = usable(vectors, id_col, vector_col, scale)
    asked = usable(vectors.where(is_query), id_col, vector_col, scale)
    shape = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    bound = candidates.agg(F.max(F.aggregate("v", F.lit(0.0), lambda t, e: t + e.cast("double") * e.cast("double"))).alias("x")).first()["x"]
    written = False
    groups = -(-(shape["n"] or 0) * 8 * max(BINS, shape["width"] or 1) // query_bytes)
    folder = f"{shared_folder(spark)}/topk-{uuid.uuid4().hex}"
    for g in range(groups):
        # Of a group neither the vectors nor the histograms exceed query_bytes on average; its rows come by a hash of the id.
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).distinct().toPandas()
        if rows.empty:
            continue
        width = int(rows["v"].map(len).max())
        q = _matrix(pa.array(rows["v"].tolist(), pa.list_(pa.int64())), width)
        ids = rows["id"].to_numpy(np.int64)
        # |q . c| <= |q| |c|; each query's interval starts there, in cells of equal width.
        reach = np.ceil(np.sqrt((q.astype(np.float64) ** 2).sum(axis=1) * (bound or 0.0)) * (1 + 1e-9)).astype(np.int64) + 1
        low, above = -reach, np.zeros(len(ids), np.int64)
        step = np.ones(len(ids), np.int64)  # powers of BINS, so that intervals nest without overlap
        while (wide := step * BINS < 2 * reach + 1).any():
            step = np.where(wide, step * BINS, step)
        done = np.zeros(len(ids), bool)
        while not done.all():
            state = spark.sparkContext.broadcast((ids, q, low, step, above))
            cells = candidates.mapInArrow(_histogram_pass(state, k), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
            counts = np.zeros((len(ids), BINS), np.int64)
            counts[cells["cell"].to_numpy(np.int64) // BINS, cells["cell"].to_numpy(np.int64) % BINS] = cells["n"]
            upper = counts[:, ::-1].cumsum(axis=1) + above[:, None]  # scores in this cell or higher ones
            reached = upper >= k
            at = np.where(reached.any(axis=1), BINS - 1 - reached.argmax(axis=1), 0)  # fewer than k candidates: the lowest cell
            short = ~reached.any(axis=1)
            grow = ~done
            above = np.where(grow, np.where(at + 1 < BINS, np.take_along_axis(upper, np.maximum(BINS - 2 - at, 0)[:, None], 1)[:, 0], above), above)
            low = np.where(grow, low + at * step, low)
            finished = (step == 1) | short
            step = np.where(grow & ~finished, step // BINS, step)
            low = np.where(grow & short, -reach, low)
            done |= finished
            state.unpersist()
        state = spark.sparkContext.broadcast((ids, q, low))
        found = candidates.mapInArrow(_final_pass(state, k), "query_id long, id long, score long")
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
        found = found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
        if groups == 1:
            return found.withColumnRenamed("id", id_col)
        # Each group is written, so that the plan of the result is one scan, however many there are.
        found.write.mode("append").parquet(folder)
        written = True
    out = spark.read.parquet(folder) if written else spark.createDataFrame([], "query_id long, rank int, id long, score long")
    return out.withColumnRenamed("id", id_col)
