"""Linear models trained with follow-the-regularised-leader (FTRL-proximal)."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Sparse multinomial (``classes`` > 1) or logistic (``classes`` = 1) regression.

    Per-coordinate FTRL-proximal updates with an elastic net: ``l1`` keeps weights
    at exactly zero, ``l2`` shrinks the rest."""

    def __init__(self, dim: int, classes: int = 1, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((dim, classes))
        self.n = np.zeros((dim, classes))

    def weights(self, idx=slice(None)) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        return np.where(np.abs(z) <= self.l1, 0.0,
                        (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, idx: np.ndarray, val: np.ndarray, target: np.ndarray, weight: float = 1.0) -> None:
        """One example: distinct feature numbers, their values, the target vector."""
        w = self.weights(idx)
        g = weight * val[:, None] * (probabilities(val @ w) - target)[None, :]
        n = self.n[idx]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[idx] += g - sigma * w
        self.n[idx] = n + g * g


def probabilities(logits: np.ndarray) -> np.ndarray:
    """Logistic for one logit in the last axis, softmax for more."""
    if logits.shape[-1] == 1:
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -40, 40)))
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def epochs(rows: int, times: int, seed: int = 7):
    """Row orders of the passes: the same for the same number of rows."""
    rng = np.random.default_rng(seed)
    for _ in range(times):
        yield rng.permutation(rows).tolist()


def platt(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a one-dimensional logistic fit (Newton steps)."""
    a, b = 0.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        r, w = p - y, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * x).sum() + ridge * a, r.sum()])
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
