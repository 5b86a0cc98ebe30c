"""Ridge logistic regression on the driver, for samples of bounded size."""

from __future__ import annotations

import numpy as np


def fit_dense(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps; the last coefficient is the intercept, which isn't shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(x.shape[1])

    def loss(b):
        z = x @ b
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ (b * b)

    now = loss(beta)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        gradient = x.T @ (p - y) + penalty * beta
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), gradient)
        size = 1.0
        while loss(beta - size * step) > now and size > 1e-4:
            size /= 2
        beta -= size * step
        was, now = now, loss(beta)
        if was - now < 1e-7 * max(1.0, abs(now)):
            break
    return beta


def fit_sparse(row: np.ndarray, column: np.ndarray, extra: np.ndarray, y: np.ndarray, columns: int, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """L-BFGS on 0/1 columns given by (row, column), dense extra columns, and an intercept, in that order."""
    n, d = len(y), columns + extra.shape[1] + 1
    penalty = np.full(d, ridge)
    penalty[-1] = 1e-6

    def value(b):
        z = np.bincount(row, b[column], n) + extra @ b[columns:-1] + b[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        e = p - y
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ (b * b), np.concatenate([np.bincount(column, e[row], columns), extra.T @ e, [e.sum()]]) + penalty * b

    b = np.zeros(d)
    f, g = value(b)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, weights = g.copy(), []
        for s, t in reversed(past):
            a = (s @ q) / (t @ s)
            q -= a * t
            weights.append(a)
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(g))
        for (s, t), a in zip(past, reversed(weights)):
            q += s * (a - (t @ q) / (t @ s))
        size, slope = 1.0, g @ q
        while True:
            new = b - size * q
            f2, g2 = value(new)
            if f2 <= f - 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
        s, t = new - b, g2 - g
        if s @ t > 1e-12:
            past = (past + [(s, t)])[-8:]
        done = f - f2 < 1e-6 * max(1.0, abs(f))
        b, f, g = new, f2, g2
        if done:
            break
    return b
