"""Runs over shared tables: what a run is sent, and that it comes to what the run over the requests themselves does."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotwise import queries
from slotwise.operators import gated, replay, runs
from tests.test_replay_model import make_slots


def as_table(spark, slots):
    frame = pd.concat(slots)
    return spark.createDataFrame(frame, "slot int, seq long, object_id string, score double, y int")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_guard_logs_of_objects_in_reach_equal_the_runs_over_requests(spark):
    slots = make_slots(4, 9, size=150, objects=120)
    slots[4].loc[slots[4].index[:3], "object_id"] = None
    raw = {3: 0.2, 5: 0.9, 7: 0.4}
    drift = spark.createDataFrame([*raw.items(), (6, None)], "slot int, drift_raw double")
    scheduled = {(4, 3): 2, (4, 5): 50, (30, 4): 0, (30, 6): 12}
    schedule = spark.createDataFrame([(*k, v) for k, v in scheduled.items()], "capacity long, slot int, scheduled long")
    variants = [*replay.VARIANTS.values(), replace(replay.VARIANTS["switched"], name="fixed_alpha", fixed_alpha=0.15), replace(replay.VARIANTS["drift_only"], name="adwin", detector="adwin")]
    table = as_table(spark, slots)
    for plan in (None, schedule):
        got = {}
        for r in replay.guard_slot_log(table, drift, variants, (0, 4, 30, 500), schedule=plan).collect():
            got.setdefault((r.variant, r.capacity), []).append(tuple(r))
        for v in variants:
            for c in (0, 4, 30, 500):
                want = replay.guarded_run(v, c, slots, raw, 2, {s: n for (k, s), n in scheduled.items() if k == c} if plan else None)
                assert sorted(got.pop((v.name, c)), key=lambda r: r[2]) == want
        assert not got


def test_what_guarded_runs_are_sent_does_not_follow_the_requests_or_the_objects(spark):
    def reached(objects: int) -> int:
        asked = spark.range(12 * objects).select((F.col("id") % 3 + 1).cast("int").alias("slot"), F.col("id").alias("seq"), F.concat(F.lit("o"), F.floor(F.col("id") / 3) % objects).alias("object_id"), F.rand(1).alias("score"), F.lit(0).alias("y"))
        return replay.reached_objects(replay.placed_objects(asked), 5, F.lit(3)).count()

    small, large = reached(200), reached(2000)
    assert 0 < small and large <= 3 * (3 * 8 + 2 * 12) and abs(large - small) < 40


@pytest.fixture
def scored(spark, monkeypatch):
    table = as_table(spark, make_slots(6, 6, size=90, objects=60))
    top = table.groupBy("slot", "object_id").agg(F.count("*").alias("freq"), F.max("y").alias("y"))
    monkeypatch.setattr(queries, "_scored", lambda *a: table)
    monkeypatch.setattr(queries, "_top", lambda *a: top)


def by_run(rows, columns):
    return sorted(tuple(r[c] for c in columns) for r in rows)


@pytest.mark.parametrize("name", ["guard_slot_log", "guard_runs", "guard_grid", "scheduled_runs", "drift_detector_runs"])
def test_no_run_gathers_its_requests(spark, scored, name):
    found = queries.QUERIES[name](spark, "")
    assert "FlatMapGroups" not in plan_of(found) and found.count()


def test_guard_runs_are_the_sums_of_runs_over_requests(spark, scored):
    got = by_run(queries.guard_runs(spark, "").collect(), ("variant", "capacity", "hits", "requests", "admitted"))
    drift = {r.slot: r.drift_raw for r in queries.drift.slot_drift(queries._top(spark, "").where("y = 1")).collect()}
    logs = {(n, c): [r for r in replay.guarded_run(v, c, make_slots(6, 6, size=90, objects=60), drift, 2) if r[3] == "cache"] for n, v in replay.VARIANTS.items() for c in (25, 100)}
    assert got == sorted((n, c, sum(r[5] for r in log), sum(r[4] for r in log), sum(r[9] for r in log)) for (n, c), log in logs.items())


def test_replays_by_blocks_equal_the_policies_request_by_request(spark):
    rng = random.Random(3)
    rows = [(i, f"k{int(rng.paretovariate(0.7)) % 60}" if i % 97 else None, None if i % 31 == 0 else int(rng.random() < 0.7)) for i in range(10, 3010)]
    trace = spark.createDataFrame(rows, "seq long, object_id string, ok int").repartition(7)
    for admit in (None, "ok"):
        got = {(r.policy, r.capacity): (r.hits, r.requests) for r in replay.replay_policies(trace, (0, 1, 7, 25), 20, admit=admit, block=64).collect()}
        want = {}
        for name, make in replay.POLICIES.items():
            for c in (0, 1, 7, 25):
                cache, hits = make(c), 0
                for _, key, ok in rows[10:]:
                    if cache.access(key):
                        hits += 1
                    elif admit is None or ok != 0:  # null may
                        cache.insert(key)
                want[name, c] = (hits, len(rows) - 10)
        assert got == want


def test_a_replay_sees_its_trace_a_block_at_a_time(spark):
    trace = spark.range(100_000).select(F.col("id").alias("seq"), F.concat(F.lit("o"), F.col("id") % 50).alias("object_id"))
    assert "FlatMapGroupsInPandas [policy" not in plan_of(replay.replay_policies(trace, (4,), policies=("LRU",)))
    coded = runs.blocks(trace.withColumn("may", F.lit(1)), [], replay.MAY).collect()
    assert sorted(len(r.codes) // 2 for r in coded) == [100_000 % runs.BLOCK, *[runs.BLOCK] * (100_000 // runs.BLOCK)] and all(len(r.names) == 50 for r in coded)


def test_policies_keep_nothing_of_each_hit_or_each_object():
    lfuda, lru2 = replay.LfuDa(3), replay.Lru2(3)
    for i in range(20_000):
        if not lfuda.access(i % 3):
            lfuda.insert(i % 3)
        if not lru2.access(i):
            lru2.insert(i, first=True)
    assert len(lfuda.heap) <= 2 * 3 + 65 and not lru2.missed and not lru2.held


@pytest.mark.parametrize("gate", [gated.Gate(enough=20), gated.Gate(), gated.Gate(tail=3, refresh=2, stale=0, enough=0, fallback="keep"), gated.Gate(tail=1, stale=2, fallback="none", prefill=False)])
def test_gated_logs_by_blocks_equal_the_runs_over_requests(spark, gate):
    slots = make_slots(9, 7, size=200, objects=90)
    got: dict = {}
    for r in gated.gated_slot_log(as_table(spark, slots).repartition(5), (0, 5, 40, 300), gate, 2, block=32).collect():
        got.setdefault(r.capacity, []).append(tuple(r))
    for c in (0, 5, 40, 300):
        assert sorted(got[c], key=lambda r: r[1]) == plain_gated(gate, c, slots, 2) == gated.gated_run(gate, c, slots, 2)


def plain_gated(gate, capacity, slots, warmup):
    """The rules with all of a slot's scores at hand."""
    held, known, tau, log = [], {}, None, []  # least recent first

    def put(key, score, slot, victim=None):
        if not capacity:
            return
        if len(held) >= capacity and key not in held:
            gone = held[0] if victim is None else victim
            held.remove(gone)
            del known[gone]
        if key in held:
            held.remove(key)
        held.append(key)
        known[key] = (score, slot)

    for frame in slots:
        slot, fresh, missed, n = int(frame.slot.iloc[0]), {}, [], [0, 0, 0, 0]
        for key, score in zip(frame.object_id, frame.score):
            fresh[key] = score
            if slot <= warmup:
                continue
            if key in held:
                held.remove(key)
                held.append(key)
                n[0] += 1
                continue
            missed.append(score)
            if score <= 0.5 if tau is None else score < tau:
                n[2] += 1
                continue
            victim = None
            if tau is not None and capacity and len(held) >= capacity:
                tail = held[: gate.tail]
                for k in tail:
                    if gate.stale and slot - known[k][1] >= gate.stale and k in fresh:
                        known[k] = (fresh[k], slot)
                victim = min(tail, key=lambda k: known[k][0])
                if score <= known[victim][0]:
                    n[3] += 1
                    continue
            put(key, score, slot, victim)
            n[1] += bool(capacity)
        first = frame.drop_duplicates("object_id")
        rate = min(gate.most_rate, max(gate.least_rate, min(float((first.y == 1).mean()), gate.gain * capacity / len(first))))
        scores = missed if len(missed) >= gate.enough else first.score if gate.fallback == "objects" else []
        if len(scores):
            new = float(np.quantile(scores, 1 - rate))
            tau = new if tau is None else gate.smooth * new + (1 - gate.smooth) * tau
        elif gate.fallback == "none":
            tau = None
        for k in held[: gate.refresh]:
            if k in fresh:
                known[k] = (fresh[k], slot)
        if gate.prefill and slot == warmup:
            for row in first.sort_values("score", ascending=False, kind="stable").head(capacity).itertuples():
                put(row.object_id, row.score, slot)
        log.append((capacity, slot, "cache" if slot > warmup else "warmup", len(frame), *n, round(rate, 9), None if tau is None else round(tau, 9)))
    return log


def test_a_gated_run_holds_scores_of_its_cache_only():
    run = gated.GatedRun(gated.Gate(), 4, 0)
    for i in range(5_000):
        run.play(1, [f"o{i}"], [0.6 + i / 20_000])
    assert len(run.fresh) <= 4 and len(run.cache.held) == len(run.cache.known) == 4 and run.missed.itemsize * len(run.missed) == 40_000


def test_scheduled_runs_admit_what_the_guarded_run_did(spark, scored):
    slots = make_slots(6, 6, size=90, objects=60)
    drift = {r.slot: r.drift_raw for r in queries.drift.slot_drift(queries._top(spark, "").where("y = 1")).collect()}
    guarded = {r[2]: r[9] for r in replay.guarded_run(replay.VARIANTS["guard"], 100, slots, drift, 2) if r[3] == "cache"}
    got = [tuple(r)[:-1] for r in queries.scheduled_runs(spark, "").where("schedule = 'matched'").orderBy("slot").collect()]
    assert got == replay.guarded_run(replay.VARIANTS["no_guard"], 100, slots, drift, 2, guarded)


def test_boosted_admission_replays_by_blocks(spark, monkeypatch):
    judged = pd.concat(make_slots(8, 5, size=300)).assign(admit=lambda f: (f.score > 0.3).astype(int))
    monkeypatch.setattr(queries, "_vector_rows", lambda *a: None)
    monkeypatch.setattr(queries, "_request_rows", lambda *a: None)
    monkeypatch.setattr(queries.ensemble, "period_admission", lambda *a, **k: spark.createDataFrame(judged[["slot", "seq", "object_id", "admit"]]).repartition(3))
    found = queries.gbt_admission(spark, "")
    assert "FlatMapGroupsInPandas [policy" not in plan_of(found)
    asked = judged[judged.slot > 2]
    for r in found.collect():
        cache, hits = replay.Lru(r.capacity), 0
        for key, ok in zip(asked.object_id, asked.admit):
            if cache.access(key):
                hits += 1
            elif ok:
                cache.insert(key)
        assert (r.policy, r.hits, r.requests) == ("LRU", hits, len(asked))
