"""A small regularised logistic regression, fitted on the driver over a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Logistic:
    """``logit = bias + weights . (x - mean) / scale``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        return self.bias + ((features - self.mean) / self.scale) @ self.weights


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Logistic:
    """Newton steps with a ridge; without rows, or with one class only, the smoothed share of label 1."""
    width = features.shape[1] if features.ndim == 2 else 0
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    base = float(np.log(share / (1 - share)))
    if not len(labels) or labels.min() == labels.max():
        return Logistic(np.zeros(width), np.ones(width), np.zeros(width), base)
    mean, scale = features.mean(0), features.std(0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    x = np.column_stack([np.ones(len(labels)), (features - mean) / scale])
    w = np.zeros(width + 1)
    w[0] = base
    penalty = np.full(width + 1, ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (labels - p) - penalty * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, w[1:], float(w[0]))
