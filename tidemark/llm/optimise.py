"""Minimising smooth functions, for the models that are trained here."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 50, memory: int = 8, tolerance: float = 1e-6) -> np.ndarray:
    """Limited-memory BFGS with backtracking. ``evaluate`` gives a value and its gradient; a round
    takes one evaluation, but for those in which a step must be shortened."""
    value, gradient = evaluate(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        way, kept = gradient.copy(), []
        for s, y, sy in reversed(past):
            kept.append((s @ way) / sy)
            way -= kept[-1] * y
        if past:
            s, y, sy = past[-1]
            way *= sy / (y @ y)
        for (s, y, sy), a in zip(past, reversed(kept), strict=True):
            way += (a - (y @ way) / sy) * s
        slope = -(gradient @ way)
        if slope >= 0:
            way, slope, past = gradient, -(gradient @ gradient), []
        if slope == 0:
            break
        step = 1.0 if past else min(1.0, 1 / np.sqrt(-slope))
        for _ in range(30):
            new = x - step * way
            found, there = evaluate(new)
            if found <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - x, there - gradient
        if s @ y > 1e-12:
            past = [*past, (s, y, s @ y)][-memory:]
        done = value - found <= tolerance * max(1.0, abs(value))
        x, value, gradient = new, found, there
        if done:
            break
    return x
