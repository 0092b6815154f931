"""Follow-the-regularised-leader (proximal, per coordinate) with elastic-net penalties."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights of shape (features, outputs) that are zero until a coordinate's evidence exceeds ``l1``."""

    def __init__(self, features: int, outputs: int = 1, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 1.0, l2: float = 0.1):
        self.z, self.n = np.zeros((features, outputs)), np.zeros((features, outputs))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, ids: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, ids: np.ndarray, gradient: np.ndarray, current: np.ndarray) -> None:
        """``ids`` hold no repeats; ``current`` is weights(ids)."""
        n, g2 = self.n[ids], gradient * gradient
        self.z[ids] += gradient - (np.sqrt(n + g2) - np.sqrt(n)) / self.alpha * current
        self.n[ids] = n + g2
