"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 characters of the lower-cased text are hashed to 2^14 features; a feature weighs
(1 + ln count) * idf and a text's features have unit length. Document frequencies count all texts that may be learned
from. The weights come from FTRL with elastic-net penalties on a sample of at most ``SAMPLE`` labelled texts, dealt
evenly to the languages by a hash of the id; a fifth of the sample is set aside to fit the temperature of the softmax.

Null texts, and texts without a letter, are ``und`` with score 0; so is every text where nothing can be learned. Null
languages are not learned from. Whole texts are read, a piece of 2^20 characters at a time; repeated rows
are judged alike and of a repeated id the text of least hash is learned from; of equally likely languages the first by name
is predicted. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.ftrl import Ftrl

BITS, ORDERS, SAMPLE, EPOCHS = 14, (1, 2, 3), 4000, 3
SIZE = 1 << BITS
LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)  # odd numbers that spread well


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(SIZE, np.int64)
    for i in range(0, len(codes), 1 << 20):  # whole texts, a piece at a time; pieces overlap by what n-grams span
        for n in ORDERS:
            piece = codes[i : i + (1 << 20) + n - 1]
            m = len(piece) - n + 1
            if m > 0:
                h = np.full(m, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
                for k in range(n):
                    h = (h ^ piece[k : k + m]) * _MULTIPLIERS[k]
                    h ^= h >> np.uint32(15)
                out += np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS), minlength=SIZE)
    return out


def features(c: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.flatnonzero(c)
    x = (1 + np.log(c[ids])) * idf[ids]
    norm = np.sqrt((x * x).sum())
    return ids, x / norm if norm else x


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the rows (one column: text) each feature occurs, and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(SIZE + 1, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                df[:SIZE] += counts(t) > 0
                df[SIZE] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["feature", "n"])

    rows = texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # one row for each feature
    out = np.zeros(SIZE + 1, np.int64)
    for r in rows:
        out[r["feature"]] = r["n"]
    return out[:SIZE], int(out[SIZE])


def train(sample: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, float]:
    """Weights (features x classes) and temperature. Every fifth example fits the temperature alone."""
    model, fit, held = Ftrl(SIZE, classes, alpha=0.5, l1=0.02, l2=0.01), [], []
    for i, e in enumerate(sample):
        (held if i % 5 == 4 else fit).append(e)
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            ids, x, y = fit[i]
            w = model.weights(ids)
            p = softmax(x @ w)
            p[y] -= 1
            model.update(ids, np.outer(x, p), w)
    weights = model.weights()
    if not held:
        return weights, 1.0
    scores, truth = np.array([x @ weights[ids] for ids, x, _ in held]), np.array([y for *_, y in held])
    loss = lambda t: -np.log(np.maximum(softmax(scores / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    return weights, float(min(np.geomspace(0.05, 5, 60), key=loss))


def identify(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """id_col, lang_pred and score of every row. ``learn``: the rows that may be learned from, where the language is not null."""
    spark = docs.sparkSession
    known = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    langs = sorted(r[0] for r in known.select(lang_col).distinct().collect())  # one row for each language
    each = max(20, sample // max(1, len(langs)))
    df, n = frequencies(known.select(text_col))
    idf = np.log((1 + n) / (1 + df)) + 1
    # The rows of least hash of each language, first in each of 64 parts of it; texts are fetched for these alone.
    h = F.xxhash64(id_col)
    ids = known.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), h.alias("_h"), F.pmod(h, F.lit(64)).alias("_part")).where("_id is not null")
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("_h", "_id"))
    ids = ids.withColumn("_k", first("_lang", "_part")).where(F.col("_k") <= each).withColumn("_rank", first("_lang")).where(F.col("_rank") <= each)
    chosen = known.select(id_col, lang_col, text_col).join(F.broadcast(ids.select("_id", "_lang", "_rank")), (F.col(id_col) == F.col("_id")) & (F.col(lang_col) == F.col("_lang")))
    # Of an id of many rows the text of least hash is learned from: at most `sample` rows.
    chosen = chosen.groupBy(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), "_rank").agg(F.min_by(text_col, F.struct(F.xxhash64(text_col), text_col)).alias("_text")).select("_id", "_lang", "_text", "_rank")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [counts(t) for t in b.column(2).to_pylist()]
            at = [np.flatnonzero(c).astype(np.int32) for c in rows]
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(1), pa.array(at, pa.list_(pa.int32())), pa.array([c[i].astype(np.int32) for c, i in zip(rows, at, strict=True)], pa.list_(pa.int32()))], names=["k", "lang", "ids", "counts"])

    examples = []
    for k, lang, ids, c in sorted((tuple(r) for r in chosen.mapInArrow(sparse, "k int, lang string, ids array<int>, counts array<int>").collect()), key=lambda r: r[:2]):
        dense = np.zeros(SIZE, np.int64)
        dense[ids] = c
        examples.append((*features(dense, idf), langs.index(lang)))
    weights, temperature = train(examples, len(langs)) if examples else (np.zeros((SIZE, 0)), 1.0)
    shared = spark.sparkContext.broadcast((langs, idf, weights / temperature))  # features x languages

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, idf, w = shared.value
        for b in batches:
            pred, score = [], []
            for t in b.column(1).to_pylist():
                if not langs or t is None or not LETTER.search(t):
                    pred.append("und")
                    score.append(0.0)
                    continue
                ids, x = features(counts(t), idf)
                p = softmax(x @ w[ids])
                pred.append(langs[int(p.argmax())])
                score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(predict, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double")
