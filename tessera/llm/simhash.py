"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints: 64 bits, each the majority over the XXH64 (seed 42) values of the text's word shingles.

Linking at 3 or fewer differing bits: one of the two 32-bit halves then differs in at most one bit. For each half the
anchors are the code words of (31,26)-Hamming times one free bit, a covering code of radius 1: every half is within 1 of
an anchor. A fingerprint is replicated to every anchor within radius + 1 of either half (17 at most), so that both ends of
a link always meet at some anchor. Fingerprints are compared anchor by anchor and a spanning forest of the links found
there goes on to connected components: connectivity is whole though pairs are never listed.

Whole texts are read, however long; ``prints`` holds no text. Equal fingerprints are merged before anything else. An anchor with more than ``TILE`` fingerprints is split into tiles and
each pair of tiles is a group of its own, so no task gathers a hot anchor.

Null and empty texts and texts without words have fingerprint zero and link like any others. Rows with null ids belong
to their fingerprint's component, which is null only if all its ids are. Repeated rows give repeated rows. Empty tables
give empty results; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LISTED, checkpointed, split_join
from tessera.llm.components import components

SHINGLE, MAX_BITS, SEED, TILE = 3, 3, 42, 4096
_FORGET = 200_000


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 value of every word shingle of UTF-8 bytes; a text of fewer words is one shingle."""
    words = text.lower().split() if text else []  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], "<u8")
    starts = [0, *ends]
    return np.array([digest(joined[a : e - 1], SEED) for a, e in zip(starts, ends[shingle - 1 :], strict=False)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """Each bit's majority as an unsigned number; zero of no hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of UTF-8 bytes."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id_col, fp) of each row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fp long")


def _masks() -> list[list[int]]:
    """By syndrome: what to flip in a half to reach each anchor within distance 2. Bit p - 1 is position p; bit 31 is free."""
    free, out = 1 << 31, []
    bit = lambda p: 1 << (p - 1)
    for s in range(32):
        if s == 0:
            out.append([0, free])
        else:
            out.append([bit(s), bit(s) | free, *(bit(i) | bit(i ^ s) for i in range(1, 32) if i < i ^ s)])
    return out


def anchors(half: Column) -> Column:
    """The anchors (longs below 2^32) within distance 2 of a half."""
    syndrome = F.lit(0)
    for j in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1)
        syndrome = syndrome + F.pmod(F.bit_count(half.bitwiseAND(F.lit(mask))), F.lit(2)) * (1 << j)
    table = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in _masks()])
    return F.transform(F.element_at(table, (syndrome + 1).cast("int")), lambda m: half.bitwiseXOR(m))


def replicas(fps: DataFrame) -> DataFrame:
    """(anchor, fp): a row for every anchor of either half. Anchors of the upper half are negative."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    return fps.select(F.explode(F.concat(anchors(low), F.transform(anchors(high), lambda a: -1 - a))).alias("anchor"), "fp")


def tiled(rows: DataFrame, tile: int, total: int | None = None) -> DataFrame:
    """(anchor, i, j, mine, fp, *more): an anchor of n fingerprints becomes k = ceil(n / tile) tiles; group (i, j) holds tiles i and j.

    ``total``: the number of rows, where it is known. The list of hot anchors is then broadcast and has fewer than LISTED rows."""
    words = [c for c in rows.columns if c != "anchor"]
    limit = tile if total is None else max(tile, total // LISTED)
    hot = rows.groupBy("anchor").count().where(F.col("count") > limit).select("anchor", F.ceil(F.col("count") / limit).cast("int").alias("k"))
    k, mine = F.coalesce("k", F.lit(1)), F.pmod(F.xxhash64("fp"), F.coalesce("k", F.lit(1))).cast("int")
    met = rows.join(hot if total is None else F.broadcast(hot), "anchor", "left")
    wide = met.select("anchor", *words, mine.alias("mine"), F.explode(F.sequence(F.lit(0), k - 1)).alias("other"))
    return wide.select("anchor", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", *words)


class _Forest:
    """Union-find over fingerprints; forgets what it has seen when it grows large (links already made are reported)."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[p]
        return x

    def join(self, a: int, b: int) -> None:
        if (a := self.find(a)) != (b := self.find(b)):
            self.parent[max(a, b)] = min(a, b)
            self.links.append((max(a, b), min(a, b)))

    def drain(self) -> list[tuple[int, int]]:
        out, self.links = self.links, []
        if len(self.parent) > _FORGET:
            self.parent = {}
        return out


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))  # of signed numbers numpy would count the bits of the absolute value


def _apart(words: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The differing bits, over all words, of the rows at the places ``a`` and ``b``."""
    out = _bits(words[0][a] ^ words[0][b])
    for w in words[1:]:
        out = out + _bits(w[a] ^ w[b]).astype(np.uint16)
    return out


def _link_small(keys: np.ndarray, words: list[np.ndarray], forest: _Forest, max_bits: int, reach: int) -> None:
    """Groups lie together; compares each row with the next ones, ``reach`` at most, of its group. The first word names a row."""
    fps = words[0]
    for s in range(1, reach):
        same = np.flatnonzero(keys[s:] == keys[:-s])
        if not len(same):
            break
        near = same[_apart(words, same, same + s) <= max_bits]
        for a, b in zip(fps[near].tolist(), fps[near + s].tolist(), strict=True):
            forest.join(a, b)


def _link_large(words: list[np.ndarray], left: np.ndarray, right: np.ndarray, label: np.ndarray, forest: _Forest, max_bits: int) -> None:
    """``left`` x ``right`` (places in the words) by rows of 512. ``label``: the component so far of each place; only links
    that join two of them are reported."""
    fps = words[0]
    for i in range(0, len(left), 512):
        rows = left[i : i + 512]
        near = _apart(words, rows[:, None], right[None, :]) <= max_bits
        some = np.flatnonzero((near & (label[rows][:, None] != label[right][None, :])).any(axis=1))  # of the rest no link is new
        for k, touched in zip(rows[some].tolist(), near[some], strict=True):
            met, first = np.unique(label[right[touched]], return_index=True)
            others = met != label[k]
            if others.any():
                for at in right[touched][first[others]].tolist():
                    forest.join(int(fps[k]), int(fps[at]))
                label[np.isin(label, met)] = label[k]


def links(fps: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """(u, v): edges whose components are those of all pairs of distinct ``fp`` within ``max_bits`` (3 at most)."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the anchors cover distances up to 3")
    return met(replicas(fps), max_bits, tile)


def met(rows: DataFrame, max_bits: int, tile: int = TILE, total: int | None = None) -> DataFrame:
    """(u, v): edges whose components are those of all pairs within ``max_bits`` that share an anchor in ``rows`` (anchor, fp).

    Columns after fp are further words of a wider fingerprint: the bits of all words count, fp names the row."""
    n_words = len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()

        def work(key: np.ndarray, mine: np.ndarray, *words: np.ndarray) -> None:
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[cuts, len(key)])
            small = np.repeat(sizes <= 64, sizes) & np.repeat(sizes > 1, sizes)
            _link_small(key[small], [w[small] for w in words], forest, max_bits, 64)
            for a, n in zip(cuts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
                group, of = [w[a : a + n] for w in words], mine[a : a + n]
                at, label = np.arange(n), np.arange(n)
                if of.min() == of.max():
                    for i in range(0, n, 512):
                        _link_large(group, at[i : i + 512], at[i:], label, forest, max_bits)
                else:
                    _link_large(group, at[of == of.min()], at[of == of.max()], label, forest, max_bits)

        def out() -> pa.RecordBatch:
            got = forest.drain()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], names=["u", "v"])

        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            anchor, i, j, *columns = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4 + n_words))
            # Groups are told apart by a number that changes where (anchor, i, j) does.
            key = anchor.astype(np.int64) * 1_000_003 + i.astype(np.int64) * 50_021 + j
            if not len(key):
                continue
            if held and held[-1][0][-1] != key[0]:
                work(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
                yield out()
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            if last:
                parts = [*held, (key[:last], *(c[:last] for c in columns))]
                work(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                held = []
                yield out()
            held.append((key[last:], *(c[last:] for c in columns)))
        if held:
            work(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield out()

    groups = tiled(rows, tile, total)
    return groups.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """id_col, fingerprint (16 hex digits) and component_id (least id reachable) of every row."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    classes = prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n"))
    roots = components(links(classes.select("fp"), max_bits))
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    labels = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    label = checkpointed(placed.join(labels, "root").select("fp", "component_id", "n"))
    # A fingerprint that a third of all rows share is split by row.
    numbered = prints.withColumn("row", F.monotonically_increasing_id())
    return split_join(numbered, label, ["fp"], ["row"]).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
