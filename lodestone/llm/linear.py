"""Logistic regression small enough to fit on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np

#: Rows that are worked on at once.
BLOCK = 2048


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def logit(p: np.ndarray, edge: float = 1e-4) -> np.ndarray:
    p = np.clip(p, edge, 1 - edge)
    return np.log(p / (1 - p))


class Logistic:
    """Damped Newton's method on standardised columns with an L2 penalty. With one class only,
    or no rows at all, it gives the (smoothed) share of that class for every row."""

    def __init__(self, penalty: float = 1.0, rounds: int = 50) -> None:
        self.penalty, self.rounds = penalty, rounds

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        """Rows are widened to doubles BLOCK at a time, so ``x`` may stay in single precision."""
        x, y = np.asarray(x), np.asarray(y, np.float64)
        d = x.shape[1]
        weight = np.ones(len(y)) if weight is None else weight
        self.mean = x.mean(0, dtype=np.float64) if len(x) else np.zeros(d)
        self.scale = x.std(0, dtype=np.float64) if len(x) else np.ones(d)
        self.scale[self.scale < 1e-9] = 1.0
        share = (float((weight * y).sum()) + 0.5) / (float(weight.sum()) + 1.0)
        self.w, self.b = np.zeros(d), float(logit(np.array(share)))
        if len(y) == 0 or y.min() == y.max():
            return self
        ridge = np.full(d + 1, self.penalty)
        ridge[-1] = 1e-6

        def blocks():  # noqa: ANN202
            for k in range(0, len(x), BLOCK):
                z = (x[k : k + BLOCK] - self.mean) / self.scale
                yield np.hstack([z, np.ones((len(z), 1))]), y[k : k + BLOCK], weight[k : k + BLOCK]

        def loss(at: np.ndarray) -> float:
            total = 0.5 * float((ridge * at * at).sum())
            for z, t, w in blocks():
                score = z @ at
                total += float((w * (np.logaddexp(0.0, score) - t * score)).sum())
            return total

        beta = np.append(self.w, self.b)
        now = loss(beta)
        for _ in range(self.rounds):
            g, h = ridge * beta, np.diag(ridge)
            for z, t, w in blocks():
                p = sigmoid(z @ beta)
                g = g + z.T @ (w * (p - t))
                h = h + z.T @ (z * (w * np.maximum(p * (1 - p), 1e-6))[:, None])
            step = np.linalg.solve(h, g)
            # whole steps overshoot where the classes are almost apart: halve until the loss falls
            size = 1.0
            while (then := loss(beta - size * step)) > now - 1e-4 * size * float(g @ step) and size > 1e-6:
                size /= 2
            if then >= now:
                break
            beta, gain = beta - size * step, now - then
            now = then
            if np.abs(size * step).max() < 1e-6 or gain < 1e-9 * now:
                break
        self.w, self.b = beta[:-1], float(beta[-1])
        return self

    def decision(self, x: np.ndarray) -> np.ndarray:
        return ((np.asarray(x, np.float64) - self.mean) / self.scale) @ self.w + self.b

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.decision(x))
