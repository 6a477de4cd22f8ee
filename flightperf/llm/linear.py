"""Logistic regression on small dense feature tables (numpy), used by the trained operators."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Logistic:
    """L2-regularised logistic regression on standardised features, fitted by Newton steps."""

    def __init__(self, l2: float = 1.0):
        self.l2 = l2

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 25) -> "Logistic":
        weight = np.ones(len(y)) if weight is None else weight
        self.mean = np.average(x, axis=0, weights=weight)
        self.spread = np.sqrt(np.average((x - self.mean) ** 2, axis=0, weights=weight))
        self.spread[self.spread < 1e-9] = 1.0
        z = self._z(x)
        ridge = np.full(z.shape[1], self.l2)
        ridge[0] = 1e-6
        self.coef = np.zeros(z.shape[1])
        for _ in range(steps):
            p = sigmoid(z @ self.coef)
            grad = z.T @ (weight * (p - y)) + ridge * self.coef
            hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
            move = np.linalg.solve(hess, grad)
            self.coef -= move * min(1.0, 5.0 / max(1e-9, np.abs(move).max()))
            if np.abs(move).max() < 1e-6:
                break
        return self

    def fit_sums(self, total, steps: int = 25) -> "Logistic | None":
        """``fit`` with both classes weighted alike, on examples that stay where they are: ``total(job)`` adds up the arrays
        ``job(x, y)`` of all batches of examples. None if a class has no example."""
        def sides(x, y):
            return np.concatenate([[y.sum(), len(y) - y.sum()], x[y == 1].sum(0), x[y == 0].sum(0)])

        found = total(sides)
        if not np.ndim(found) or found[:2].min() <= 0:
            return None
        n, n_features = found[:2].sum(), (len(found) - 2) // 2
        heavy, light = 0.5 / found[:2] * n          # the weight of an example of class 1, of class 0
        self.mean = (heavy * found[2:2 + n_features] + light * found[2 + n_features:]) / n
        mean = self.mean
        far = total(lambda x, y: (np.where(y == 1, heavy, light)[:, None] * (x - mean) ** 2).sum(0))
        self.spread = np.sqrt(far / n)
        self.spread[self.spread < 1e-9] = 1.0
        size = n_features + 1
        ridge = np.full(size, self.l2)
        ridge[0] = 1e-6
        self.coef = np.zeros(size)
        for _ in range(steps):
            now = Logistic(self.l2)
            now.mean, now.spread, now.coef = self.mean, self.spread, self.coef.copy()

            def slopes(x, y, now=now):
                z, weight = now._z(x), np.where(y == 1, heavy, light)
                p = sigmoid(z @ now.coef)
                return np.concatenate([z.T @ (weight * (p - y)), ((z * (weight * p * (1 - p))[:, None]).T @ z).ravel()])

            found = total(slopes)
            grad, hess = found[:size] + ridge * self.coef, found[size:].reshape(size, size) + np.diag(ridge)
            move = np.linalg.solve(hess, grad)
            self.coef = self.coef - move * min(1.0, 5.0 / max(1e-9, np.abs(move).max()))
            if np.abs(move).max() < 1e-6:
                break
        return self

    def _z(self, x):
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.spread, -8, 8)])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._z(x) @ self.coef
