"""Hashed n-grams and logistic regression on them, in NumPy: what the two trained classifiers share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Multipliers of the rolling hash and of its last mixing.
ROLL = np.uint64(1_000_003)
MIX = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points with a space at either end."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


#: n-grams that start in one window are hashed at once, so that memory does not grow with a text.
WINDOW = 1 << 18


def rolling(units: np.ndarray, orders: tuple[int, ...], bits: int, salt: int = 0) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of the given orders over a sequence of numbers, repeats included, window by window."""
    for at in range(0, len(units), WINDOW):
        part = units[at : at + WINDOW + max(orders) - 1]
        h = np.full(len(part), np.uint64(salt + 1))
        for n in range(1, min(max(orders), len(part)) + 1):
            h = (h[:-1] if n > 1 else h) * ROLL + part[n - 1 :]
            if n in orders:
                yield ((h[:WINDOW] + np.uint64(n)) * MIX >> np.uint64(64 - bits)).astype(np.int32)


def _minimise(f, x: np.ndarray, rounds: int) -> np.ndarray:
    """L-BFGS with backtracking; ``f`` gives value and gradient."""
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, kept = -g, []
        for s, y, rho in reversed(steps):
            a = rho * (s @ d)
            kept.append(a)
            d = d - a * y
        if steps:
            s, y, _ = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y, rho), a in zip(steps, reversed(kept), strict=True):
            d = d + s * (a - rho * (y @ d))
        slope, t = g @ d, 1.0
        if slope > -1e-10:
            break
        while True:
            new, h = f(x + t * d)
            if new <= value + 1e-4 * t * slope or t < 1e-6:
                break
            t *= 0.5
        s, y = t * d, h - g
        if s @ y > 1e-12:
            steps = [*steps[-7:], (s, y, 1 / (s @ y))]
        done = abs(value - new) < 1e-7 * max(1.0, abs(value))
        x, value, g = x + s, new, h
        if done:
            break
    return x


def logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, ridge: float, rounds: int = 80):
    """Weights and intercept of a ridge-penalised logistic regression on sparse rows."""
    n = len(y)

    def f(p):
        z = np.bincount(rows, values * p[cols], n) + p[width]
        loss = np.logaddexp(0, z) - y * z
        r = 1 / (1 + np.exp(-z)) - y
        g = np.append(np.bincount(cols, values * r[rows], width), r.sum()) / n
        g[:width] += ridge * p[:width]
        return loss.mean() + ridge / 2 * (p[:width] @ p[:width]), g

    p = _minimise(f, np.zeros(width + 1), rounds)
    return p[:width], p[width]


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make ``sigmoid(a z + b)`` a probability, by Newton steps on smoothed labels."""
    up, n = y.sum(), len(y)
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (n - up + 2))
    x = np.stack([z, np.ones(n)], 1)
    p = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        h = x.T @ (x * (q * (1 - q))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - q) - 1e-6 * p)
        p = p + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(p[0]), float(p[1])
