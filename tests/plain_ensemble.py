"""The ensemble's rule in plain sequential form, against which the distributed one is tested."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

FLOOR, LEAST = 1e-9, 1e-6


class NaiveBayes:
    """Gaussian, weighted; an empty class gets mean 0, variance 1 and prior 0. With missing_aware, NaNs are left out."""

    def __init__(self, missing_aware: bool = False):
        self.missing_aware = missing_aware

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> NaiveBayes:
        d = x.shape[1]
        self.mean, self.var, self.prior = np.zeros((2, d)), np.ones((2, d)), np.zeros(2)
        for c in (0, 1):
            at = y == c
            w = weight[at]
            if w.sum() <= 0:
                continue
            seen = ~np.isnan(x[at]) if self.missing_aware else np.ones_like(x[at], dtype=bool)
            ww, v = w[:, None] * seen, np.where(seen, x[at], 0.0)
            total = ww.sum(axis=0)
            safe = np.maximum(total, 1e-300)
            self.mean[c] = (ww * v).sum(axis=0) / safe
            self.var[c] = np.where(total > 0, (ww * (v - self.mean[c]) ** 2).sum(axis=0) / safe, 1.0)
            self.prior[c] = w.sum() / weight.sum()
        self.var = np.maximum(self.var, FLOOR)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """log P(1) - log P(0), feature by feature."""
        with np.errstate(divide="ignore"):
            out = np.full(len(x), np.log(self.prior[1]) - np.log(self.prior[0]))
        for f in range(x.shape[1]):
            far = [(x[:, f] - self.mean[c, f]) ** 2 / self.var[c, f] for c in (0, 1)]
            term = 0.5 * (np.log(self.var[0, f] / self.var[1, f]) + far[0] - far[1])
            out += np.where(np.isnan(term), 0.0, term) if self.missing_aware else term
        return out

    def proba(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -700, 700)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (self.margin(x) > 0).astype(int)


@dataclass
class Member:
    model: NaiveBayes
    created: int
    betas: list[float] = field(default_factory=list)


class DriftEnsemble:
    """Learn++.NSE: a new member each slot, members weighted by sigmoid-averaged recent errors, at most `most` of them."""

    def __init__(self, missing_aware: bool = False, slope: float = 0.5, offset: float = 10.0, most: int = 20):
        self.make, self.slope, self.offset, self.most = (lambda: NaiveBayes(missing_aware)), slope, offset, most
        self.members: list[Member] = []
        self.weights: list[float] = []

    def score(self, x: np.ndarray) -> np.ndarray:
        """Weighted mean of the members' P(1); 0.5 without members."""
        if not self.members or sum(self.weights) <= 0:
            return np.full(len(x), 0.5)
        return sum(w * m.model.proba(x) for w, m in zip(self.weights, self.members, strict=True)) / sum(self.weights)

    def vote(self, x: np.ndarray) -> np.ndarray:
        """Weighted majority; ties and an empty ensemble say 1."""
        if not self.members:
            return np.ones(len(x), dtype=int)
        ones = sum(w * m.model.predict(x) for w, m in zip(self.weights, self.members, strict=True))
        return (2 * ones >= sum(self.weights)).astype(int)

    def update(self, slot: int, x: np.ndarray, y: np.ndarray) -> None:
        """Rows that the ensemble got wrong weigh 1, others its error; the new member learns on these weights, and all members are
        weighed by their errors on them: those of a member's slots are averaged with recent ones ahead. Errors lie within [LEAST, 1 - LEAST], a member's at 0.5 at most."""
        if not len(y):
            return
        if self.members:
            wrong = self.vote(x) != y
            weight = np.where(wrong, 1.0, min(max(wrong.mean(), LEAST), 1 - LEAST))
        else:
            weight = np.ones(len(y))
        weight = weight / weight.sum()
        self.members.append(Member(self.make().fit(x, y, weight), slot))
        for m in self.members:
            e = max(LEAST, min(0.5, float(weight[m.model.predict(x) != y].sum())))
            m.betas.append(e / (1 - e))
        self.members = self.members[-self.most :]
        self.weights = []
        for m in self.members:
            ages = np.arange(len(m.betas))[::-1]
            recent = 1 / (1 + np.exp(self.slope * (ages - self.offset)))
            mean = float((recent * np.array(m.betas)).sum() / recent.sum())
            self.weights.append(math.log(1 / min(max(mean, LEAST), 1 - LEAST)))
