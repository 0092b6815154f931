"""Near copies by the similarity of word shingles: wide SimHash fingerprints that meet at anchor points of a covering code, then an exact check.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. A bit of their SimHash
fingerprints then differs with probability 0.151 at most (for a few small sets up to 0.161, and 0.188 for 4 shingles of 5),
so of 64 bits 10 on average and often 15. For this wider radius the scheme of ``simhash`` gets a longer fingerprint and more
blocks: ``WORDS`` words of 64 bits (the first one is the fingerprint of ``simhash`` over the set, the others take the same
shingle hashes, mixed), and ``BLOCKS`` blocks of 23 of their bits. The anchors of a block are the code words of the Golay code
(23,12), a perfect covering code of radius 3: every block is within 3 bits of exactly one, and goes there. Blocks of two
texts at the threshold reach the same anchor with probability 0.121; by calculation such a pair meets nowhere 3 times in a
million (at 0.161: 14, at 0.188: 350 times).

Rows at an anchor are compared in their first ``COMPARED`` words, at ``MAX_BITS``; the components of these links hold the
true components, but also texts less similar. Each such component then gets its texts, once a tile pair, and is split by
comparing whole shingle sets: no pair below the similarity links. Pairs are never listed: a text reached needs no second
link. A component with more than ``TILE`` texts or ``TILE_SHINGLES`` shingles is tiled and each pair of tiles is a group of
its own.

Anchors follow the data: where they would hold more than ``TILE`` / 2 rows on average, blocks get free bits. Each of these
doubles the anchors and adds a fifth of the blocks (with five, a pair at the threshold meets nowhere 6 times in a million,
at 0.188 1500 times). A hot anchor is tiled as in ``simhash``.

Texts with equal shingle sets are one node, so copies cost nothing; texts without words (null, empty) are one node too. A
text shorter than a shingle is one shingle. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed
from tessera.llm.components import components
from tessera.llm.simhash import SEED, TILE, _bits, met, shingle_hashes

SHINGLE, SIMILARITY, TILE_SHINGLES = 5, 0.8, 2_000_000
#: Words of a fingerprint, blocks without free bits, words compared at an anchor and the bits in which they may differ: 29 on
#: average at the threshold, more than 58 four times in 100 million; of unrelated texts 96, 58 or less twice in 100 million.
WORDS, BLOCKS, COMPARED, MAX_BITS = 16, 112, 3, 58
#: In the exact check pairs whose first words differ in more bits are not compared: at the threshold once in 80 billion.
FIRST_BITS = 32
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the Golay code of 23 bits.
LENGTH, RADIUS, GOLAY = 23, 3, 0b110001110101
_STEPS = np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(shingle_hashes(text, shingle))


def fingerprint(hashes: np.ndarray) -> bytes:
    """WORDS x 64 bits, each the majority over a set's hashes. The first word takes them as they are, the others mixed."""
    ones = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(hashes), 255):
        x = hashes[i : i + 255, None] + _STEPS[1:]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = np.concatenate([hashes[i : i + 255, None], x ^ (x >> np.uint64(31))], axis=1)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def _syndromes(blocks: np.ndarray) -> np.ndarray:
    """Remainders of blocks by the generator of the code: zero for code words."""
    for b in range(LENGTH - 1, 10, -1):
        blocks = blocks ^ ((blocks >> b & 1) * (GOLAY << (b - 11)))
    return blocks


@functools.cache
def _leaders() -> np.ndarray:
    """By syndrome: the one pattern of RADIUS bits at most that has it."""
    patterns = np.array([sum(1 << i for i in c) for k in range(RADIUS + 1) for c in combinations(range(LENGTH), k)], np.int64)
    out = np.zeros(1 << 11, np.int64)
    out[_syndromes(patterns)] = patterns
    return out


def nearest(blocks: np.ndarray) -> np.ndarray:
    """The code word within RADIUS bits of each block."""
    return blocks ^ _leaders()[_syndromes(blocks)]


@functools.cache
def _places(free: int) -> np.ndarray:
    """For each block the bits it takes, LENGTH + free of them."""
    every = np.tile(np.arange(64 * WORDS), (math.ceil(BLOCKS * 1.2**free), 1))
    return np.random.default_rng([SEED, free]).permuted(every, axis=1)[:, : LENGTH + free]


def anchors(prints: np.ndarray, free: int = 0) -> np.ndarray:
    """The anchor of each block (columns) of fingerprints (rows of bytes): block, nearest code word, free bits."""
    bits, at = np.unpackbits(prints, axis=1, bitorder="little"), _places(free)
    take = lambda a, b: sum(bits[:, at[:, i]].astype(np.int64) << (i - a) for i in range(a, b))
    code = nearest(take(0, LENGTH)) >> 11  # the first 12 bits tell code words apart
    return ((np.arange(len(at)) << 12 | code) << free) | take(LENGTH, LENGTH + free)


def free_bits(n: int) -> int:
    """Free bits of a block with which n rows put TILE / 2 at most at an anchor, on average."""
    return max(0, math.ceil(math.log2(max(n, 1) / (TILE // 2 << 12))))


def _meeting(classes: DataFrame, free: int) -> DataFrame:
    """(anchor, fp, fp1, ...) of classes (wide): a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                prints = np.frombuffer(b"".join(b.column(0).slice(i, 512).to_pylist()), np.uint8).reshape(-1, 8 * WORDS)
                found, words = anchors(prints, free), prints.view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([lists, *(pa.array(words[:, k]) for k in range(COMPARED))], names=["anchors", *names])

    names = ["fp", *(f"fp{k}" for k in range(1, COMPARED))]
    placed = classes.select("wide").mapInArrow(run, ", ".join(["anchors array<long>", *(f"{n} long" for n in names)]))
    return placed.select(F.explode("anchors").alias("anchor"), *names)


def _sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, text_hash, node, fp, n, wide) of each row. node: a hash of the whole shingle set; n: its members; wide: the fingerprint; fp: its first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, wide = [], [], []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                h = shingle_set(t, shingle)
                node.append(xxhash.xxh64_intdigest(h.tobytes(), SEED) if len(h) else 0)
                n.append(len(h))
                wide.append(fingerprint(h))
            nodes, fps = np.array(node, np.uint64).view(np.int64), np.frombuffer(b"".join(wide), np.int64).reshape(-1, WORDS)[:, 0]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes), pa.array(fps), pa.array(n, pa.int64()), pa.array(wide, pa.binary())], names=["id", "text_hash", "node", "fp", "n", "wide"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_hash(text_col).alias("text_hash"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, text_hash long, node long, fp long, n long, wide binary")


def text_hash(text_col: str):
    """64 bits that tell texts apart; null is not the empty text."""
    return F.xxhash64(F.col(f"`{text_col}`").isNull(), F.col(f"`{text_col}`"))


def similar(sets: list[np.ndarray], fps: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Places (a, b): a spanning forest of the pairs of sets at least this similar."""
    sizes, left, out = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            p = queue.pop()
            small, large = np.minimum(sizes[left], sizes[p]), np.maximum(sizes[left], sizes[p])
            at = np.flatnonzero((small >= similarity * large) & (small > 0) & (_bits(fps[left] ^ fps[p]) <= FIRST_BITS))
            if not len(at):
                continue
            other = left[at]
            members = np.concatenate([sets[i] for i in other.tolist()])
            place = np.minimum(np.searchsorted(sets[p], members), sizes[p] - 1)
            shared = np.add.reduceat((sets[p][place] == members).astype(np.int64), np.r_[0, np.cumsum(sizes[other])[:-1]])
            linked = shared >= similarity * (sizes[p] + sizes[other] - shared) - 1e-9
            out += [(p, i) for i in other[linked].tolist()]
            queue += other[linked].tolist()
            left = np.delete(left, at[linked])
    return out


def _exact_pass(shingle: int, similarity: float):
    """Rows (root, i, j, node, fp, text) come by (root, i, j); gives (u, v) of nodes."""

    def settle(nodes: list[int], fps: list[int], texts: list[bytes]) -> pa.RecordBatch:
        found = similar([shingle_set(t, shingle) for t in texts], np.array(fps, np.int64), similarity)
        return pa.RecordBatch.from_arrays([pa.array([nodes[a] for a, _ in found], pa.int64()), pa.array([nodes[b] for _, b in found], pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = ([], [], []), None
        for b in batches:
            *keys, nodes, fps = (b.column(k).to_pylist() for k in range(5))
            texts = b.column(5).cast(pa.binary()).to_pylist()
            for key, *row in zip(zip(*keys, strict=True), nodes, fps, texts, strict=True):
                if key != at and held[0]:
                    yield settle(*held)
                    held = ([], [], [])
                at = key
                for x, y in zip(held, row, strict=True):
                    x.append(y)
        if held[0]:
            yield settle(*held)

    return run


def firsts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(id_col, text_hash): of each component of near copies the row with the least id (null last), then text hash."""
    prints = checkpointed(_sketches(docs, id_col, text_col, shingle))
    key = F.struct(F.col("id").isNull().alias("last"), "id", "text_hash")
    classes = checkpointed(prints.groupBy("node").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("text_hash").alias("of"), F.min(key).alias("first"), F.first("wide").alias("wide")))
    with_words = classes.where("n > 0")
    total = with_words.count()
    free = free_bits(total)
    candidates = components(met(_meeting(with_words, free), MAX_BITS, tile, total * len(_places(free)))).select(F.col("node").alias("fp"), "root")
    placed = checkpointed(classes.drop("wide").join(candidates, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    k = F.ceil(F.greatest(F.count(F.lit(1)) / tile, F.sum("n") / TILE_SHINGLES)).cast("int")
    several = placed.groupBy("root").agg(F.count(F.lit(1)).alias("texts"), k.alias("k")).where("texts > 1").drop("texts")
    # Copies of a text collapse before the exchange.
    texts = docs.groupBy(text_hash(text_col).alias("of")).agg(F.first(F.col(f"`{text_col}`")).alias("text"))
    mine = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    wide = placed.select("root", "node", "fp", "of").join(several, "root").join(texts, "of").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    groups = wide.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "fp", "text")
    edges = groups.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_exact_pass(shingle, similarity), "u long, v long").distinct()
    roots = components(edges).withColumnRenamed("root", "of_node")
    least = placed.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("of_node", "node").alias("root")).agg(F.min("first").alias("first"))
    return least.select(F.col("first.id").alias(id_col), F.col("first.text_hash").alias("text_hash"))
