"""The replay operators against plain request-by-request models, written from the stated rules."""

from __future__ import annotations

import math
import random
from collections import OrderedDict
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from slotwise.functions.fnv import fnv1a
from slotwise.operators import drift, replay
from tests.plain_ensemble import DriftEnsemble, NaiveBayes


def make_slots(seed, n_slots=14, size=120, objects=45):
    """Slots of requests with scores per request and labels for the most asked objects; interest drifts from slot to slot."""
    rng, slots, seq = random.Random(seed), [], 0
    for slot in range(1, n_slots + 1):
        asked = [f"o{int(rng.paretovariate(0.8) + slot * (slot % 3)) % objects}" for _ in range(size if slot < n_slots else size // 3)]
        top = set(sorted(set(asked), key=asked.count)[-len(set(asked)) // 5 :])
        rows = []
        for o in asked:
            rows.append((slot, seq, o, round(rng.random() * (1.0 if o in top else 0.7), 2), int(o in top)))
            seq += 1
        slots.append(pd.DataFrame(rows, columns=["slot", "seq", "object_id", "score", "y"]))
    return slots


def model(v, capacity, slots, raw, warmup):
    """(hits, candidates, budget, selected, alpha, drift, quality, gated, applied) a slot."""
    cache, out, pending, applied_sets = OrderedDict(), [], [], []
    ema, mean, var, spread_ema, last_spread, seen_cache = 0.0, None, 0.0, None, 0.0, False
    adwin, ph = [], [0, 0.0, 0.0, 0.0]
    for frame in slots:
        slot = frame.slot.iloc[0]
        for o in pending:
            cache[o] = None
            cache.move_to_end(o)
            if len(cache) > capacity:
                cache.popitem(last=False)
        if pending:
            applied_sets = [*applied_sets, set(pending)][-3:]
        applied, pending = len(pending), []
        if slot <= warmup:
            out.append((0, 0, 0, 0, None, None, None, False, applied))
            continue
        fill = len(cache) < math.ceil(0.9 * capacity)
        hits, best, order = 0, {}, []
        for o, s in zip(frame.object_id, frame.score):
            if o in cache:
                cache.move_to_end(o)
                hits += 1
            elif o not in best:
                best[o] = s
                order.append(o)
            else:
                best[o] = max(best[o], s)
        popular = {o for o, y in zip(frame.object_id, frame.y) if y}
        precision = max((len(a & popular) / len(a) for a in applied_sets), default=None)
        miss = (len(frame) - hits) / len(frame)
        value = raw.get(slot, 0.6) if seen_cache else 0.6
        seen_cache = True
        if v.detector == "adwin":
            adwin.append(miss)
            value = 0.0
            for cut in range(1, len(adwin)):
                a, b = adwin[:cut], adwin[cut:]
                if len(a) < 10 or len(b) < 10:
                    continue
                ratio = abs(np.mean(a) - np.mean(b)) / math.sqrt(0.5 * math.log(2 / 0.002) * (1 / len(a) + 1 / len(b)))
                value = max(value, ratio)
                if ratio > 1:
                    adwin = b
                    break
            value = min(1.0, value)
        elif v.detector == "page_hinkley":
            ph[0] += 1
            ph[1] += (miss - ph[1]) / ph[0]
            ph[2] += miss - ph[1] - 0.005
            ph[3] = min(ph[3], ph[2])
            value = min(1.0, (ph[2] - ph[3]) / 0.3)
        ema = 0.3 * value + 0.7 * ema
        if mean is None:
            mean = ema
        else:
            mean = 0.9 * mean + 0.1 * ema
            var = 0.9 * var + 0.1 * (ema - mean) ** 2
        drift_norm = 1 / (1 + math.exp(-max(-3, min(3, (ema - mean) / (math.sqrt(var) + 1e-6)))))
        counted = drift_norm
        if v.drift_guard and precision is not None and not (precision >= 0.06 and (last_spread if v.drift_guard == "last" else 0) >= 0.01):
            counted = 0.0
        scale = min(1.0, max(0.4, capacity / frame.object_id.nunique()))
        alpha = {"scaled": 0.08 * (1 + v.drift_gain * counted), "piecewise": 0.18 if counted >= 0.6 else 0.04, "fixed": 0.08}[v.control] * scale
        if v.fixed_alpha is not None:
            alpha = v.fixed_alpha
        base = min(0.2, max(0.005, alpha))
        adjust = 1.0
        if precision is not None and precision > 0.12:
            adjust += v.precision_sensitivity * (precision - 0.12) / 0.12
        alpha = min(0.2, max(0.005, max(base * adjust, 0.7 * base)))
        quality, gate = 1.0, v.gate
        if order:
            scores = [best[o] for o in order]
            last_spread = np.quantile(scores, 0.9) - np.quantile(scores, 0.5)
            spread_ema = last_spread if spread_ema is None else 0.2 * last_spread + 0.8 * spread_ema
            least = v.quality_min if scale >= 1 else min(v.quality_max, v.quality_min + (1 - scale) * v.quality_boost)
            quality = min(v.quality_max, max(least, last_spread / (spread_ema + 1e-6)))
            if v.adaptive_gate:
                gate = 0.02 + max(0.0, min(1.0, (spread_ema - 0.005) / 0.025)) * 0.18
        gain = v.miss_gain * (1 + (1 - scale)) if v.crowded_gain and scale < 1 else v.miss_gain
        pressure = (1 + gain * miss) * quality if v.fixed_alpha is None else 1.0
        budget, gated = math.ceil(capacity * alpha * pressure) if hits < len(frame) else 0, False
        if fill:
            budget = max(budget, math.ceil(0.05 * capacity))
        budget = min(budget, len(order))
        k = max(1, math.ceil(gate * len(order)))
        if order and not fill and budget > k and not (v.gate_if_poor and quality >= 1):
            budget, gated = k, True
        pending = sorted(order, key=lambda o: -best[o])[:budget]
        out.append((hits, len(order), budget, len(pending), alpha, drift_norm, quality, gated, applied))
    return out


def polluted(slots, admitted_sets, capacity, warmup):
    """Objects admitted for a slot and hit neither in it nor in the next, by replaying the admissions."""
    cache, hit, out = OrderedDict(), [], []
    for frame, admitted in zip(slots, admitted_sets):
        for o in admitted:
            cache[o] = None
            cache.move_to_end(o)
            if len(cache) > capacity:
                cache.popitem(last=False)
        here = set()
        for o in frame.object_id if frame.slot.iloc[0] > warmup else ():
            if o in cache:
                cache.move_to_end(o)
                here.add(o)
        hit.append(here)
    for i, admitted in enumerate(admitted_sets):
        out.append(len(set(admitted) - hit[i] - (hit[i + 1] if i + 1 < len(hit) else set())))
    return out


RUNS = [*replay.VARIANTS.values(), replace(replay.VARIANTS["drift_only"], detector="adwin"), replace(replay.VARIANTS["drift_only"], detector="page_hinkley"), replace(replay.VARIANTS["drift_adaptive"], drift_guard="last"), replace(replay.VARIANTS["guard"], fixed_alpha=0.1)]


@pytest.mark.parametrize("v", RUNS, ids=lambda v: f"{v.name}-{v.detector}-{v.drift_guard}-{v.fixed_alpha}")
def test_guarded_run_equals_the_model(v):
    for seed, capacity, n in ((1, 6, 14), (2, 20, 30), (3, 60, 14)):
        slots = make_slots(seed, n)
        raw = {s: random.Random(s * seed).random() for s in range(1, n + 1)}
        log, want = replay.guarded_run(v, capacity, slots, raw, 2), model(v, capacity, slots, raw, 2)
        for row, m in zip(log, want, strict=True):
            assert (row[5], row[7], row[8], row[9], row[16], row[18]) == (m[0], m[1], m[2], m[3], m[7], m[8])
            if m[4] is not None:
                assert row[10:13] == pytest.approx(m[4:7], abs=1e-8)


def test_pollution_of_admitted_objects():
    slots = make_slots(5, 12)
    v, capacity = replay.VARIANTS["no_guard"], 8
    log = replay.guarded_run(v, capacity, slots, {}, 2)
    want = polluted(slots, model_admissions(v, capacity, slots), capacity, 2)
    assert [r[19] for r in log] == want and sum(want) > 0


def model_admissions(v, capacity, slots):
    """Objects that each slot begins with inserting."""
    out = []
    for i in range(len(slots)):
        # a run over the slots up to here tells what was pending at its end
        out.append(pending_after(v, capacity, slots[:i]) if i else [])
    return out


def pending_after(v, capacity, slots):
    seen = []
    insert = replay.Lru.insert

    class Spy(replay.Lru):
        def insert(self, key):
            seen[-1].append(key)
            insert(self, key)

    original = replay.Lru
    replay.Lru = Spy
    try:
        last = slots[-1]
        extra = last.assign(slot=last.slot + 1, seq=last.seq + 10_000)
        seen.append([])
        replay.guarded_run(v, capacity, slots, {}, 2)
        before = list(seen[-1])
        seen.append([])
        replay.guarded_run(v, capacity, [*slots, extra], {}, 2)
        return seen[-1][len(before) :]
    finally:
        replay.Lru = original


def test_precision_beyond_its_target_raises_the_share():
    control = replay.BudgetController(replay.VARIANTS["precision_only"], 100)
    low, high = control.alpha(0.5, 1.0, 0.06, 0.5)[0], control.alpha(0.5, 1.0, 0.18, 0.5)[0]
    assert low == pytest.approx(0.08) and high == pytest.approx(0.08 * 1.5)


def test_quality_of_scores_without_spread_is_the_least():
    assert replay.BudgetController(replay.VARIANTS["guard"], 10).quality(np.full(5, 0.5), 1.0) == 0.7
    assert replay.BudgetController(replay.VARIANTS["guard"], 10).quality(np.full(5, 0.5), 0.4) == pytest.approx(0.76)


def test_drift_scores_by_hand():
    d = drift.DriftScore()
    assert d.update(1.0) == 0.5 and d.ema == 0.3 and d.var == 0
    got, ema, mean = d.update(0.0), 0.21, 0.9 * 0.3 + 0.1 * 0.21
    var = 0.1 * (ema - mean) ** 2
    assert got == pytest.approx(1 / (1 + math.exp(-max(-3, (ema - mean) / (math.sqrt(var) + 1e-6)))))
    one = drift.OneSidedDrift()
    assert one.update(0.5) == 0 and one.update(0.1) == 0 and one.update(0.9) == pytest.approx((0.9 - 0.504) / math.sqrt(0.9 * 0.1 * 0.16 + 0.1 * 0.44**2) / 2.5)


def test_adaptive_window_keeps_all_values_until_a_split():
    w = drift.AdaptiveWindow()
    assert [w.update(0.25) for _ in range(500)] == [0.0] * 500 and len(w.values) == 500
    scores = [w.update(0.9) for _ in range(12)]
    assert max(scores) == 1.0 and len(w.values) < 30
    p = drift.PageHinkley()
    assert max(p.update(0.1) for _ in range(50)) < 0.05 and p.update(0.9) == 1.0 and p.found


@pytest.mark.parametrize("name", ["LRU2", "LFUDA", "TINYLFU"])
def test_policies_equal_plain_models(name):
    rng = random.Random(7)
    keys = [f"k{int(rng.paretovariate(0.7)) % 60}" for _ in range(3000)]
    for capacity in (1, 7, 25):
        cache = replay.POLICIES[name](capacity)
        if name == "TINYLFU":
            cache.period = 500
        got = []
        for k in keys:
            got.append(cache.access(k))
            if not got[-1]:
                cache.insert(k)
        assert got == PLAIN[name](keys, capacity) and any(got)


def plain_lru2(keys, capacity):
    held, misses, out = [], {}, []
    for k in keys:
        out.append(k in held)
        if k in held:
            held.remove(k)
            held.append(k)
            continue
        misses[k] = misses.get(k, 0) + 1
        if misses[k] >= 2:
            held = [*held, k][-capacity:]
    return out


def plain_lfuda(keys, capacity):
    held, age, n, out = {}, 0, 0, []  # key -> [rank, pushed, freq]
    for k in keys:
        out.append(k in held)
        n += 1
        if k in held:
            held[k] = [age + held[k][2] + 1, n, held[k][2] + 1]
            continue
        if len(held) >= capacity:
            gone = min(held, key=lambda x: held[x][:2])
            age = held.pop(gone)[0]
        held[k] = [age + 1, n, 1]
    return out


def plain_tinylfu(keys, capacity, period=500):
    rows, door, held, n, out = [[0] * 16384 for _ in range(4)], [False] * 65536, [], 0, []

    def cells(k):
        return [((fnv1a(k) + i * 0x9E3779B97F4A7C15) % 2**64) % 16384 for i in range(4)]

    def estimate(k):
        return min(r[c] for r, c in zip(rows, cells(k)))

    for k in keys:
        for r, c in zip(rows, cells(k)):
            r[c] += 1
        n += 1
        if n == period:
            rows, door, n = [[x // 2 for x in r] for r in rows], [False] * 65536, 0
        out.append(k in held)
        if k in held:
            held.remove(k)
            held.append(k)
        elif not door[fnv1a(k) % 65536]:
            door[fnv1a(k) % 65536] = True
        elif len(held) < capacity:
            held.append(k)
        elif estimate(k) >= estimate(held[0]):
            held = [*held[1:], k]
    return out


PLAIN = {"LRU2": plain_lru2, "LFUDA": plain_lfuda, "TINYLFU": plain_tinylfu}


def test_ensemble_weights_equal_the_stated_rule():
    rng = np.random.default_rng(4)
    ensemble, members, betas = DriftEnsemble(most=3), [], []
    for slot in range(1, 8):
        y = (rng.random(80) < 0.3).astype(int)
        x = rng.normal(0, 1, (80, 2)) + y[:, None] * (1.5 if slot % 3 else -1.5)
        if members:
            votes = [sum(w * (m.predict(x)[i] == c) for w, m in zip(weights, members)) for i in range(80) for c in (0, 1)]
            guess = np.array([int(votes[2 * i + 1] >= votes[2 * i]) for i in range(80)])
            e = min(max((guess != y).mean(), 1e-6), 1 - 1e-6)
            w = np.where(guess != y, 1.0, e)
        else:
            w = np.ones(80)
        w = w / w.sum()
        members.append(NaiveBayes().fit(x, y, w))
        betas.append([])
        for m, b in zip(members, betas):
            e = max(1e-6, min(0.5, w[m.predict(x) != y].sum()))
            b.append(e / (1 - e))
        members, betas, weights = members[-3:], betas[-3:], []
        for b in betas:
            s = [1 / (1 + math.exp(0.5 * ((len(b) - 1 - i) - 10))) for i in range(len(b))]
            weights.append(math.log(1 / min(max(sum(p * q for p, q in zip(s, b)) / sum(s), 1e-6), 1 - 1e-6)))
        ensemble.update(slot, x, y)
        assert ensemble.weights == pytest.approx(weights) and len(ensemble.members) == len(members)
    easy = DriftEnsemble()
    easy.update(1, np.array([[-5.0], [-5.1], [5.0], [5.1]]), np.array([0, 0, 1, 1]))
    assert easy.weights == pytest.approx([math.log((1 - 1e-6) / 1e-6)])  # 13.8, a member without error
