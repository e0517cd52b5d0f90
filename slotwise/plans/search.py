"""Search over a run's settings: trials are run in batches as one Spark job, the next settings are chosen on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def expected_improvement(x: np.ndarray, y: np.ndarray, at: np.ndarray, reach: float = 0.3, noise: float = 1e-6) -> np.ndarray:
    """By how much a Gaussian process through (x, y), squared-exponential, is expected to exceed max(y) at each row of `at`."""

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-0.5 * ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2) / reach**2)

    middle, spread = y.mean(), max(float(y.std()), 1e-12)
    z, k = (y - middle) / spread, near(at, x)
    inverse = np.linalg.inv(near(x, x) + noise * np.eye(len(x)))
    mean = k @ inverse @ z
    deviation = np.sqrt(np.maximum(1e-12, 1 - np.einsum("ij,jk,ik->i", k, inverse, k)))
    u = (mean - z.max()) / deviation
    below = 0.5 * (1 + np.array([math.erf(v / math.sqrt(2)) for v in u]))
    return spread * deviation * (u * below + np.exp(-0.5 * u * u) / math.sqrt(2 * math.pi))


def maximize(run: Callable[[list[dict]], list[float]], bounds: dict[str, tuple[float, float]], start: int = 5, rounds: int = 10, offers: int = 500, seed: int = 7) -> list[tuple[dict, float]]:
    """(settings, value) of all trials, best first. run gives the values of a list of settings.

    `start` random settings go as one batch; then each round tries the one of `offers` random settings that promises most.
    """
    rng, names = np.random.default_rng(seed), list(bounds)
    low, high = (np.array([bounds[n][i] for n in names], dtype=float) for i in (0, 1))

    def settings(unit: np.ndarray) -> list[dict]:
        return [dict(zip(names, row.tolist(), strict=True)) for row in low + unit * (high - low)]

    x = rng.random((start, len(names)))
    y = np.array(run(settings(x)), dtype=float)
    for _ in range(rounds):
        offered = rng.random((offers, len(names)))
        best = offered[[int(np.argmax(expected_improvement(x, y, offered)))]]
        x, y = np.vstack([x, best]), np.append(y, run(settings(best)))
    order = np.argsort(-y, kind="stable")
    return [(settings(x)[i], float(y[i])) for i in order]
