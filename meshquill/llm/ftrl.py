"""FTRL-proximal with per-coordinate rates and elastic-net penalties, on sparse examples."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights of `classes` linear scores over `size` hashed features.

    Binary models use one column and a sigmoid, others a softmax. Only z and the sums of squared
    gradients are kept; weights follow from them, and are zero wherever |z| <= l1.
    """

    def __init__(self, size: int, classes: int = 1, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((size, classes))
        self.n = np.zeros((size, classes))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / rate)

    def step(self, at: np.ndarray, values: np.ndarray, target: np.ndarray, importance: float = 1.0) -> np.ndarray:
        """One example: distinct feature ids, their values, the target of each column. Returns the prediction."""
        w = self.weights(at)
        p = probabilities(values @ w)
        g = importance * values[:, None] * (p - target)[None, :]
        old = self.n[at]
        new = old + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(old)) / self.alpha * w
        self.n[at] = new
        return p


def probabilities(scores: np.ndarray) -> np.ndarray:
    """Sigmoid for one column, softmax over the last axis otherwise."""
    if scores.shape[-1] == 1:
        return 1.0 / (1.0 + np.exp(-np.clip(scores, -60, 60)))
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
