"""Toxicity: cumulative-link ordinal regression on sparse text features.

Features: the distinct words of the lower-cased text and their beginnings of 5 to 8 bytes. One weight vector serves
every threshold: P(grade <= j) = logistic(threshold_j - w . x). Weights come from FTRL with elastic-net penalties, so
most are zero and a text without any weighted feature is left alone. Severity is the expected grade; a text whose
severity is at least ``REJECT`` is toxic.

Where labels are a flag only, ``grades`` splits the flagged examples at the median number of telling words (words of at
least ``TELLING`` flagged and no clean examples): 0 clean, 1 mild, 2 severe.

The model is fitted on at most ``SAMPLE`` flagged and ``SAMPLE`` x ``CLEAN`` other labelled texts, chosen by a hash of the
id; every whole text is scored. Null and empty texts have no features. Labels of one id are merged (the highest counts);
null ids and null labels are not learned from; of an id with several texts the one
of least hash is.  Without examples of two grades every severity is 0. Repeated rows are
judged alike, ties between grades go to the lower one; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name
from tessera.llm.ftrl import Ftrl

SAMPLE, CLEAN, TELLING, EPOCHS, REJECT, RARE = 2000, 3, 5, 10, 0.1, 3
#: Lengths in bytes of the beginnings of words; features expected to be kept by chance if none told anything.
BEGINNINGS, BY_CHANCE = (5, 6, 7, 8), 3
#: ASCII that is neither letter nor digit becomes a space.
_SPACED = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words(text: str | None) -> set[bytes]:
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()) if text else set()


def features(distinct: set[bytes]) -> set[bytes]:
    """Words end with a space, which no beginning of one does."""
    return {w + b" " for w in distinct} | {w[:n] for w in distinct for n in BEGINNINGS if len(w) >= n}


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Tally:
    """How many flagged and how many of all examples hold each feature, by a hash of 22 bits: what a fit holds of the
    sample's vocabulary does not depend on its size."""

    def __init__(self, bags: list[bytes], flagged: list[bool]):
        self.hit, self.all = np.zeros(1 << 22, np.int32), np.zeros(1 << 22, np.int32)
        for bag, y in zip(bags, flagged, strict=True):
            at = np.unique([self.slot(f) for f in features(set(bag.split()))]).astype(np.int64)
            self.all[at] += 1
            if y:
                self.hit[at] += 1
        share = min(max(sum(flagged) / max(1, len(flagged)), 1e-6), 1 - 1e-6)
        #: By Chernoff's bound at most BY_CHANCE features would be kept if none told anything.
        needed = np.log(max(1, int((self.all >= RARE).sum())) / BY_CHANCE)
        self.kept = np.zeros(len(self.all), bool)
        for i in range(0, len(self.all), 1 << 17):  # a block at a time, for the driver's memory
            n, k = self.all[i : i + (1 << 17)].astype(float), self.hit[i : i + (1 << 17)].astype(float)
            n1 = np.maximum(n, 1)
            self.kept[i : i + (1 << 17)] = (n >= RARE) & (xlogy(k, k / n1 / share) + xlogy(n - k, (n - k) / n1 / (1 - share)) >= needed)

    @staticmethod
    def slot(feature: bytes) -> int:
        return zlib.crc32(feature) & 0x3FFFFF

    def telling(self, word: bytes) -> bool:
        k = self.slot(word + b" ")
        return bool(self.hit[k] >= TELLING and self.hit[k] == self.all[k])


def xlogy(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.where(y > 0, y, 1.0)), 0.0)


def grades(flags: list[int], bags: list[bytes], tally: Tally) -> list[int]:
    """0 for unflagged examples; flagged ones are 2 where they hold more than the median number of telling words, else 1."""
    hits = [sum(map(tally.telling, bag.split())) if y else 0 for y, bag in zip(flags, bags, strict=True)]
    middle = np.median([h for y, h in zip(flags, hits, strict=True) if y]) if any(flags) else 0
    return [(1 + (h > middle)) if y else 0 for y, h in zip(flags, hits, strict=True)]


class Ordinal:
    """Shared weights by feature, and ordered thresholds."""

    def __init__(self, weights: dict[bytes, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self.keys = set(weights)

    @classmethod
    def fit(cls, bags: list[bytes], targets: list[int], tally: Tally | None = None, *, epochs: int = EPOCHS) -> Ordinal:
        """``bags``: the distinct words of each example, joined by spaces."""
        top = max(targets, default=0)
        if top == 0 or min(targets) == top:
            return cls({}, np.zeros(0))
        tally = tally or Tally(bags, [y > 0 for y in targets])
        index: dict[bytes, int] = {}
        rows = [np.array(sorted(index.setdefault(f, len(index)) for f in sorted(features(set(bag.split()))) if tally.kept[Tally.slot(f)]), np.int64) for bag in bags]
        share = np.array([np.mean([y <= j for y in targets]) for j in range(top)]).clip(0.01, 0.99)
        theta, seen = np.log(share / (1 - share)), np.zeros(top)
        model, rng = Ftrl(len(index), alpha=2.0, l1=0.5, l2=0.01), np.random.default_rng(11)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                ids, y = rows[i], targets[i]
                w = model.weights(ids)
                s = float(w.sum())
                upper = logistic(theta[y] - s) if y < top else 1.0
                lower = logistic(theta[y - 1] - s) if y else 0.0
                model.update(ids, np.full((len(ids), 1), 1 - upper - lower), w)  # of -log(upper - lower) by s
                p, g = max(upper - lower, 1e-9), np.zeros(top)
                if y < top:
                    g[y] -= upper * (1 - upper) / p
                if y:
                    g[y - 1] += lower * (1 - lower) / p
                g = g.clip(-1, 1)
                seen += g * g
                theta = np.maximum.accumulate(theta - 0.1 * g / np.sqrt(1 + seen))  # thresholds stay ordered
        final = model.weights()[:, 0]
        return cls({f: float(final[i]) for f, i in index.items() if final[i]}, theta)

    def judge(self, distinct: set[bytes]) -> tuple[float, int]:
        """Expected grade and the likeliest one."""
        if not len(self.thresholds):
            return 0.0, 0
        s = sum(sorted(self.weights[f] for f in features(distinct) & self.keys))
        below = np.r_[logistic(self.thresholds - s), 1.0]
        return float((1 - below).sum()), int(np.diff(np.r_[0.0, below]).argmax())


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Ordinal:
    merged = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    pick = lambda rows, n: rows.orderBy(F.xxhash64(id_col), id_col).limit(n)
    chosen = pick(merged.where("_y > 0"), sample).unionByName(pick(merged.where("_y <= 0"), sample * CLEAN))
    found = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)  # a bounded sample of ids
    # Of an id of many rows the text of least hash is learned from.
    found = found.groupBy(id_col, "_y").agg(F.min_by(text_col, F.struct(F.xxhash64(text_col), text_col)).alias(text_col))

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([b" ".join(sorted(words(t))) for t in b.column(2).to_pylist()], pa.binary())], names=["id", "y", "words"])

    rows = found.select(id_col, "_y", text_col).mapInArrow(bag, f"id {dict(docs.dtypes)[id_col]}, y int, words binary").collect()
    rows.sort(key=lambda r: (r["id"], bytes(r["words"])))
    bags, flags = [bytes(r["words"]) for r in rows], [max(0, r["y"]) for r in rows]
    del rows
    tally = Tally(bags, [y > 0 for y in flags])
    return Ordinal.fit(bags, grades(flags, bags, tally) if max(flags, default=0) <= 1 else flags, tally)


def score(docs: DataFrame, model: Ordinal, *, carry: list[str], text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """``carry`` columns with severity, grade and toxic of every row (underscored where ``carry`` has such a name)."""
    named = [free_name(carry, n) for n in ("severity", "grade", "toxic")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most the distinct features of a bounded sample
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.judge(words(t)) for t in b.column(len(carry)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(carry))), pa.array([s for s, _ in got], pa.float64()), pa.array([g for _, g in got], pa.int32()), pa.array([s >= reject for s, _ in got], pa.bool_())], names=[*carry, *named])

    schema = "".join(f"`{c}` {types[c]}, " for c in carry)
    source = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").alias(free_name(carry, "_text")))
    return source.mapInArrow(run, f"{schema}`{named[0]}` double, `{named[1]}` int, `{named[2]}` boolean")
