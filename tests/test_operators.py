from __future__ import annotations

import gzip
import random
import tarfile

import numpy as np
import pytest

from slotwise.functions.fnv import PUBLISHED_OFFSET, fnv1a
from slotwise.operators import drift, gated, labels, replay
from slotwise.operators import requests as req
from slotwise.plans import schedules, search
from slotwise.sources import trace as src
from tests.plain_ensemble import DriftEnsemble, NaiveBayes


def trace_of(spark, objects, slot_size=10):
    rows = [(i, float(i + 1), str(o)) for i, o in enumerate(objects)]
    return src.with_slots(spark.createDataFrame(rows, "seq long, ts double, object_id string"), slot_size)


def test_worked_gaps_and_labels(spark):
    trace = trace_of(spark, [1, 2, 3, 4, 1, 2, 3, 1, 2, 1, 1, 2, 4, 3, 2, 4, 4, 3, 1, 4])
    got = {r.seq + 1: (r.g1, r.g2, r.g3) for r in req.with_gaps(trace, 3, 0.0).collect()}
    assert got[5] == (4, 0, 0) and got[8] == (3, 7, 0) and got[10] == (2, 5, 9) and got[17] == (1, 4, 13) and got[20] == (3, 4, 7)
    top = labels.label_top_share(req.slot_objects(trace), 0.5).where("y = 1").collect()
    assert sorted((r.slot, r.object_id) for r in top) == [(1, "1"), (1, "2"), (2, "1"), (2, "4")]


def test_clamp_equals_the_sequential_rule(spark):
    rng = random.Random(5)
    raw = [None if rng.random() < 0.2 else float(rng.randint(0, 30)) for _ in range(60)]
    want, last = [], None
    for i, t in enumerate(raw):
        last = (last + 1 if last is not None else i + 1) if t is None else max(t, last if last is not None else t)
        want.append(last)
    rows = src.with_slots(spark.createDataFrame(list(enumerate(raw)), "seq long, raw_ts double"), 7)
    assert [r.ts for r in req.clamp_time(rows).orderBy("seq").collect()] == want


def test_reuse_distance_equals_lru(spark):
    rng = random.Random(2)
    trace = trace_of(spark, [int(rng.paretovariate(1)) for _ in range(400)])
    curve = {r.capacity: r.hits for r in replay.lru_curve(replay.reuse_distances(trace), (1, 3, 10)).collect()}
    same = {r.capacity: r.hits for r in replay.replay_policies(trace, (1, 3, 10), policies=("LRU",)).collect()}
    assert curve == same and list(curve.values()) == sorted(curve.values())
    for most, stretch in ((10, 37), (10, 1000), (25, 3)):
        near = replay.lru_distances(trace, most, stretch=stretch)
        assert {r.capacity: r.hits for r in replay.lru_curve(near, (1, 3, 10)).collect()} == curve
        exact = {r.seq: r.distance for r in replay.reuse_distances(trace).collect()}
        assert {r.seq: r.distance for r in near.collect()} == {s: d if d is not None and d < most else None for s, d in exact.items()}


def test_policies_hold_no_more_than_they_may():
    rng = random.Random(1)
    for make in replay.POLICIES.values():
        for capacity in (1, 5):
            cache = make(capacity)
            for _ in range(500):
                key = rng.randint(0, 20)
                if not cache.access(key):
                    cache.insert(key)
                assert len(cache.held) <= capacity
    assert fnv1a("", PUBLISHED_OFFSET) == 0xCBF29CE484222325 and fnv1a("a", PUBLISHED_OFFSET) == 0xAF63DC4C8601EC8C
    assert fnv1a("") == 1469598103934665603 and fnv1a("a") == ((1469598103934665603 ^ 97) * 1099511628211) % 2**64


def test_ensemble_adapts_to_a_swap():
    rng = np.random.default_rng(0)
    model = DriftEnsemble()
    for slot, sign in enumerate((1, 1, -1), 1):
        y = np.repeat([0, 1], 200)
        x = np.where(y[:, None] == 1, 2.0, -2.0) * sign + rng.normal(0, 0.5, (400, 2))
        before = (model.vote(x) == y).mean()
        model.update(slot, x, y)
        assert len(model.members) == slot and all(np.isfinite(model.weights))
    assert before < 0.1
    for slot in range(4, 40):
        model.update(slot, x, y)
    assert len(model.members) == 20 and (model.vote(x) == y).all()


def test_nb_of_one_class_and_constant_features():
    nb = NaiveBayes().fit(np.ones((5, 2)), np.zeros(5, dtype=int), np.ones(5))
    assert nb.prior.tolist() == [1, 0] and nb.var[0].tolist() == [1e-9, 1e-9] and not nb.predict(np.ones((3, 2))).any()


def test_detectors_see_a_jump():
    a, p = drift.AdaptiveWindow(), drift.PageHinkley()
    assert any([a.update(v) for v in [0.1] * 60 + [0.9] * 60]) and any([p.update(v) for v in [0.1] * 60 + [0.9] * 60])


def test_readers(spark, tmp_path):
    spaced = tmp_path / "t.gz"
    spaced.write_bytes(gzip.compress(b"1 10.5 http://a/A -\n2 11.5 http://a/A B -\n3 9.0 http://a/C save\n"))
    got = src.read_trace(spark, str(spaced)).orderBy("seq").collect()
    assert [(r.seq, r.object_id, r.timestamp) for r in got] == [(0, "http://a/A", 10.5), (1, "http://a/A B", 11.5), (2, "http://a/C", 9.0)]
    lines = b"0 17 1024 3\nx 18 2048\n1 19\n2 17 1024\n"
    sized = tmp_path / "x_wiki2018.gz"
    sized.write_bytes(gzip.compress(lines))
    want = [(0, "17", 0.0, 1024), (1, "17", 2.0, 1024)]
    assert [tuple(r) for r in src.read_trace(spark, str(sized)).orderBy("seq").collect()] == want
    (tmp_path / "a.tr").write_bytes(lines)
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as archive:
        archive.add(tmp_path / "a.tr", "d/a.tr")
    assert [tuple(r) for r in src.read_trace(spark, str(tmp_path / "t.tar.gz")).orderBy("seq").collect()] == want
    spliced = src.read_spliced(spark, f"{spaced}::2||{sized}::1").orderBy("seq").collect()
    assert [(r.seq, r.object_id) for r in spliced] == [(0, "http://a/A"), (1, "http://a/A B"), (2, "17")]
    with pytest.raises(ValueError):
        src.read_trace(spark, "x.csv")


def test_schedules_keep_the_total(spark):
    rows = [("a", 100, s, b) for s, b in enumerate((5, 0, 9, 3), 3)] + [("b", 100, 3, 4), ("c", 100, 3, 0), ("c", 100, 4, 0)]
    log = spark.createDataFrame(rows, "variant string, capacity long, slot int, selected long")
    even = {(r.variant, r.slot): r.scheduled for r in schedules.even_schedule(log).collect()}
    assert even == {("a", 3): 4, ("a", 4): 4, ("a", 5): 4, ("a", 6): 5, ("b", 3): 4, ("c", 3): 0, ("c", 4): 0}
    drawn = schedules.permuted_schedule(log).collect()
    assert sorted(r.scheduled for r in drawn if r.variant == "a") == [0, 3, 5, 9] and len(drawn) == 7
    assert sorted(map(tuple, schedules.permuted_schedule(log).collect())) == sorted(map(tuple, drawn))
    assert not schedules.even_schedule(log.limit(0)).collect()


def slot_frame(slot, pairs, positive=()):
    import pandas as pd

    return pd.DataFrame([(slot, o, s, int(o in positive)) for o, s in pairs], columns=["slot", "object_id", "score", "y"])


def test_gated_run_by_hand():
    gate = gated.Gate(tail=2, enough=10**9, least_rate=0.5, most_rate=0.5, smooth=1.0)
    warm = slot_frame(1, [("a", 0.9), ("b", 0.8), ("c", 0.1), ("d", 0.2)], "a")
    # The threshold is the median 0.5; the cache starts with a, b. c falls short; e does not outscore the weakest, b; f replaces b.
    use = slot_frame(2, [("a", 0.9), ("c", 0.1), ("e", 0.7), ("f", 0.85), ("b", 0.8), ("f", 0.85)], "f")
    log = gated.gated_run(gate, 2, [warm, use], 1)
    assert log[0][9] == 0.5 and log[1][:8] == (2, 2, "cache", 6, 2, 1, 1, 2)
    assert gated.gated_run(gate, 0, [warm, use], 1)[1][4:6] == (0, 0)
    assert gated.gated_run(gate, 50, [warm, use], 1)[1][4] == 4  # all four warm objects are held, and f the second time


def test_threshold_without_enough_misses():
    keep, none = (gated.Threshold(gated.Gate(fallback=f), 10) for f in ("keep", "none"))
    for t in (keep, none):
        t.update(0.2, [0.5] * 600, np.array([0.1]))
        assert t.value == 0.5
        t.update(0.2, [], np.array([0.1]))
    assert keep.value == 0.5 and none.value is None


def test_grid_and_search_find_the_best():
    grid = replay.grid_variants(replay.VARIANTS["guard"], gate=(0.02, 0.05), miss_gain=(0.0, 0.5))
    assert len({v.name for v in grid}) == 4 and {(v.gate, v.miss_gain) for v in grid} == {(a, b) for a in (0.02, 0.05) for b in (0.0, 0.5)}
    found = search.maximize(lambda trials: [-((t["a"] - 3) ** 2) - (t["b"] + 1) ** 2 for t in trials], {"a": (0, 10), "b": (-5, 5)}, rounds=20)
    assert len(found) == 25 and abs(found[0][0]["a"] - 3) < 0.6 and abs(found[0][0]["b"] + 1) < 0.6


def test_schedule_replaces_the_budget():
    import pandas as pd

    slots = [pd.DataFrame([(s, 10 * s + i, f"o{(i * s) % 7}", 0.1 * i, 0) for i in range(10)], columns=["slot", "seq", "object_id", "score", "y"]) for s in (1, 2, 3)]
    log = replay.guarded_run(replay.VARIANTS["no_guard"], 3, slots, {}, 1, {2: 0, 3: 2})
    assert [r[9] for r in log[1:]] == [0, 2]
