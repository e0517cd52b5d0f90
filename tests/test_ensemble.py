"""The distributed ensemble against its rule in plain sequential form; spark.ml learners by what they learn."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.operators import ensemble, labels, learn
from tests.plain_ensemble import DriftEnsemble


def made(missing: bool, slots: int = 6, n: int = 60, seed: int = 4):
    """slot -> (x, y); the classes change sides in some slots, a slot may hold one class only, some values are missing."""
    rng, out = np.random.default_rng(seed), {}
    for slot in range(1, slots + 1):
        y = (rng.random(n) < (0.3 if slot != 3 else 2.0)).astype(int)
        x = rng.normal(0, 1, (n, 3)) + y[:, None] * (1.5 if slot % 3 else -1.5)
        x[:, 2] = 7.0  # without spread
        if missing:
            x[rng.random((n, 3)) < 0.2] = np.nan
            x[y == 1, 1] = np.nan if slot == 2 else x[y == 1, 1]
        out[slot] = (x, y)
    return out


def frame(spark, data):
    rows = [(slot, i, f"o{i}", int(y[i]), *map(float, x[i])) for slot, (x, y) in data.items() for i in range(len(y))]
    return spark.createDataFrame(rows, "slot int, seq long, object_id string, y int, a double, b double, c double").repartition(3)


@pytest.mark.parametrize("missing", [False, True])
def test_naive_bayes_ensemble_equals_the_rule(spark, missing):
    data = made(missing)
    rows = frame(spark, data)
    fitted = ensemble.fit_ensembles(rows, ["a", "b", "c"], "nb_missing" if missing else "nb", most=3)
    plain, weights, errors, scores = DriftEnsemble(missing, most=3), [], [], {}
    for slot, (x, y) in data.items():
        scores |= {(slot, i): (s, v) for i, (s, v) in enumerate(zip(plain.score(x), plain.vote(x), strict=True))}
        errors.append((slot, len(plain.members), len(y), int((plain.vote(x) != y).sum()) if plain.members else 0))
        plain.update(slot, x, y)
        weights += [(slot, m.created, w) for m, w in zip(plain.members, plain.weights, strict=True)]
    got = fitted.weight_table(spark).orderBy("slot", "created").collect()
    assert [(r.slot, r.created) for r in got] == [w[:2] for w in weights] and [r.weight for r in got] == pytest.approx([w[2] for w in weights], abs=1e-9)
    assert [tuple(r) for r in fitted.error_table(spark).orderBy("slot").collect()] == errors
    for r in ensemble.score_requests(rows, fitted, ["a", "b", "c"]).collect():
        score, vote = scores[r.slot, r.seq]
        assert r.score == pytest.approx(score, abs=1e-9) and r.vote == vote


def test_later_slots_are_scored_by_the_last_ensemble(spark):
    data = made(False, 3)
    fitted = ensemble.fit_ensembles(frame(spark, data), ["a", "b", "c"])
    later = ensemble.score_requests(frame(spark, {9: data[3], 0: data[1]}), fitted, ["a", "b", "c"])
    assert {r.slot: r.n_members for r in later.select("slot", "n_members").distinct().collect()} == {9: 2, 0: 0}


def test_weighted_moments(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(w), None if m < 0.2 else float("nan") if m < 0.3 else float(v) + 1e6, None) for k, w, v, m in zip(rng.integers(0, 2, 300), rng.random(300), rng.normal(size=300), rng.random(300))]
    got = {r.k: r for r in learn.weighted_moments(spark.createDataFrame(rows, "k int, w double, a double, b double").repartition(4), ["k"], ["a", "b"], "w", missing=True).collect()}
    for k in (0, 1):
        w, v = (np.array(x) for x in zip(*[(r[1], r[2]) for r in rows if r[0] == k and r[2] is not None and r[2] == r[2]]))
        mean = (w * v).sum() / w.sum()
        assert got[k].n == pytest.approx(sum(r[1] for r in rows if r[0] == k)) and got[k].m_a == pytest.approx(mean, abs=1e-6)
        assert got[k].v_a == pytest.approx((w * (v - mean) ** 2).sum() / w.sum(), rel=1e-6)  # values near a million, deviations near one
        assert (got[k].m_b, got[k].v_b) == (0.0, 1.0)


def test_member_weight():
    assert ensemble.member_weight([1e-6 / (1 - 1e-6)], 0.5, 10.0) == pytest.approx(math.log((1 - 1e-6) / 1e-6), rel=1e-6)  # 13.8, a member without error
    assert ensemble.member_weight([0.1, 0.9], 0.5, 10.0) < ensemble.member_weight([0.9, 0.1], 0.5, 10.0)


@pytest.mark.parametrize("kind", ["svm", "tree"])
def test_trained_learners(spark, kind):
    """They tell apart what can be told apart, say the only class where there is one, and in later slots beat a baseline that knows one noisy feature."""
    learner = ensemble.make_learner(kind)
    rng = np.random.default_rng(3)
    apart = [(int(i < 50), *rng.normal(3 if i < 50 else -3, 0.5, 2).tolist(), 1 / 100) for i in range(100)]
    apart = spark.createDataFrame(apart, "y int, a double, b double, weight double")
    models = [learner.fit(apart, ["a", "b"]), learner.fit(apart.where("y = 1"), ["a", "b"])]
    margins = learner.margins(apart, models, ["a", "b"]).collect()
    assert all((r.margins[0] > 0) == (r.y == 1) and r.margins[1] == math.inf for r in margins)
    data = {}
    for slot in (1, 2, 3):
        y = (rng.random(200) < 0.3).astype(int)
        data[slot] = (np.column_stack([rng.normal(2.0 * y, 1), rng.normal(2.0 * y, 1), rng.normal(0.5 * y, 1)]), y)
    rows = frame(spark, data)
    fitted = ensemble.fit_ensembles(rows, ["a", "b", "c"], kind)
    assert [len(known) for known in fitted.before.values()] == [0, 1, 2]
    scored = ensemble.score_requests(rows, fitted, ["a", "b", "c"])
    assert scored.count() == 600 and scored.where("score < 0 or score > 1 or score is null").count() == 0
    both = scored.join(rows.select("slot", "seq", "y", "c"), ["slot", "seq"]).withColumn("first_seq", F.col("seq")).where("slot > 1")
    ours, base = ({r.slot: r.auc for r in labels.score_metrics(both.withColumn("score", F.col(c))).collect()} for c in ("score", "c"))
    assert all(ours[s] > base[s] + 0.1 for s in (2, 3))


def test_boosted_periods(spark):
    rng = np.random.default_rng(2)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3) | (x[:, 2] > 0.9)).astype(int)
    rows = spark.createDataFrame([(1 + i // 300, i, f"o{i}", int(y[i]), *map(float, x[i])) for i in range(600)], "slot int, seq long, object_id string, y int, a double, b double, c double")
    got = {r.seq: r.admit for r in ensemble.period_admission(rows, rows, ["a", "b", "c"], warmup=1, every=1, rounds=15, rate=0.3).collect()}
    assert len(got) == 600 and all(got[i] == 1 for i in range(300))  # nothing is known yet
    assert np.mean([got[i] == y[i] for i in range(300, 600)]) > 0.93
