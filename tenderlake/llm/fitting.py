"""A small quasi-Newton minimiser for the models fitted in this subpackage."""

from __future__ import annotations

import numpy as np


def minimise(f, x: np.ndarray, steps: int = 60, memory: int = 8, tol: float = 1e-5) -> np.ndarray:
    """Limited-memory BFGS with backtracking; ``f(x)`` gives (value, gradient)."""
    value, grad = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(grad).max() < tol:
            break
        q, kept = -grad, []
        for s, y, r in reversed(pairs):
            a = r * s.dot(q)
            kept.append(a)
            q = q - a * y
        if pairs:
            s, y, _ = pairs[-1]
            q = q * (s.dot(y) / y.dot(y))
        for (s, y, r), a in zip(pairs, reversed(kept)):
            q = q + s * (a - r * y.dot(q))
        slope = grad.dot(q)
        if slope >= 0:
            pairs, q, slope = [], -grad, -grad.dot(grad)
        t = 1.0 if pairs else min(1.0, 1.0 / np.abs(grad).sum())
        for _ in range(25):
            new_value, new_grad = f(x + t * q)
            if new_value <= value + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = t * q, new_grad - grad
        if s.dot(y) > 1e-10:
            pairs = [*pairs[1 - memory:], (s, y, 1.0 / s.dot(y))] if memory > 1 else [(s, y, 1.0 / s.dot(y))]
        done = abs(value - new_value) < 1e-7 * max(1.0, abs(value))
        x, value, grad = x + s, new_value, new_grad
        if done:
            break
    return x
