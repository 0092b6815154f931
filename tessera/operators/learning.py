"""Learned parts: the ranker, the bandit and intent centroids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ["lexical_score", "semantic_score", "centrality_score"]
# Examples below which nothing is trained; similarity below which no centroid is chosen.
LEAST_EXAMPLES, CENTROID_THRESHOLD = 200, 0.65


class Ranker:
    """L2 logistic regression on the three signals; untrained it predicts nothing."""

    def __init__(self, model: LogisticRegressionModel | None = None):
        self.model = model

    @property
    def is_trained(self) -> bool:
        return self.model is not None

    def train(self, examples: DataFrame) -> bool:
        n = examples.count()
        if n < LEAST_EXAMPLES:
            return False
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(examples).select("features", F.col("symbol_edited").cast("double").alias("label"))
        self.model = LogisticRegression(regParam=1 / n, elasticNetParam=0.0, standardization=False).fit(rows)
        return True

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            return rows.withColumn("probability", F.lit(None).cast("double"))
        from pyspark.ml.functions import vector_to_array

        scored = self.model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
        return scored.withColumn("probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction")

    def coefficients(self) -> dict[str, float] | None:
        return None if self.model is None else dict(zip(FEATURES, map(float, self.model.coefficients), strict=True))

    def save(self, path: str) -> None:
        if self.model is not None:
            self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> Ranker:
        try:
            return cls(LogisticRegressionModel.load(path))
        except Exception as e:  # a model that was never saved is an untrained one
            if "does not exist" in str(e) or "PATH_NOT_FOUND" in str(e):
                return cls()
            raise


def choose_arm(posteriors: list[tuple[str, float, float]], rng: np.random.Generator) -> str:
    """Thompson sampling over (arm, alpha, beta) of one intent; arms never seen have alpha = beta = 1."""
    return max(sorted(posteriors), key=lambda p: rng.beta(p[1], p[2]))[0]


def nearest_centroid(vector: np.ndarray, centroids: dict[str, np.ndarray], threshold: float = CENTROID_THRESHOLD) -> str | None:
    def cosine(a, b):
        n = float(np.linalg.norm(a) * np.linalg.norm(b))
        return float(a @ b) / n if n else 0.0

    name, best = max(((k, cosine(vector, c)) for k, c in sorted(centroids.items())), key=lambda x: x[1], default=(None, -1.0))
    return name if best >= threshold else None


def classify(query: str, keyword_intent: str, embed: Callable[[str], np.ndarray], centroids: dict[str, np.ndarray]) -> str:
    """Keywords decide first; else the nearest centroid, if near enough."""
    if keyword_intent != "general":
        return keyword_intent
    return nearest_centroid(embed(query), centroids) or "general"
