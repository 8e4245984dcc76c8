"""A linear support vector machine by dual coordinate descent, and a logistic scale for its margins."""

from __future__ import annotations

import numpy as np


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, passes: int = 40, weight: float = 1.0,
               seed: int = 7) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM, y in {-1, 1}; (weights, bias). ``weight`` multiplies the cost of the class +1."""
    rows = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    diag = 0.5 / (cost * np.where(y > 0, weight, 1.0))
    norm = np.einsum("ij,ij->i", rows, rows) + diag
    alpha, w = np.zeros(len(y)), np.zeros(rows.shape[1])
    spin = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in spin.permutation(len(y)):
            step = (1.0 - y[i] * (rows[i] @ w) - diag[i] * alpha[i]) / norm[i]
            new = max(0.0, alpha[i] + step)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * rows[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4 * (1.0 + alpha.max()):
            break
    return w[:-1], float(w[-1])


def newton_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, weight: np.ndarray | float = 1.0,
               steps: int = 40) -> tuple[np.ndarray, float]:
    """The same machine by Newton steps on the weights, for few columns and many rows; ``weight`` is per row."""
    rows = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    c = 2.0 * cost * weight * np.ones(len(y))
    w = np.zeros(rows.shape[1])

    def loss(v: np.ndarray) -> float:
        return 0.5 * float(v @ v) + 0.5 * float((c * np.maximum(0.0, 1.0 - y * (rows @ v)) ** 2).sum())

    now = loss(w)
    for _ in range(steps):
        slack = 1.0 - y * (rows @ w)
        inside = slack > 0
        held = rows[inside]
        gradient = w - held.T @ (c[inside] * y[inside] * slack[inside])
        step = np.linalg.solve(held.T @ (held * c[inside, None]) + np.eye(len(w)), gradient)
        size = 1.0
        while (new := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        w, gain, now = w - size * step, now - new, new
        if gain < 1e-6 * now:
            break
    return w[:-1], float(w[-1])


def logistic_scale(margin: np.ndarray, label: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(slope, offset) of P(1) = 1 / (1 + exp(-(slope * margin + offset))), by damped Newton steps."""
    n1, n0 = float(label.sum()), float(len(label) - label.sum())
    goal = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = p - goal, np.maximum(p * (1 - p), 1e-9)
        m = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(m, [(g * margin).sum(), g.sum()])
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
    return float(max(a, 1e-3)), float(b)
