"""Cache replay: LRU by reuse distance as a relational query; other policies and budgeted admission one run a group."""

from __future__ import annotations

import heapq
import math
from collections import OrderedDict, deque
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, replace
from functools import reduce
from itertools import islice, product
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.functions.fnv import fnv1a
from slotwise.operators import ranks
from slotwise.operators.drift import AdaptiveWindow, DriftScore, PageHinkley
from slotwise.operators.runs import BLOCK, arrow_schema, blocks, consecutive, requests_of, run_by_run
from slotwise.sources.scratch import written


def reuse_distances(trace: DataFrame, start: int = 0) -> DataFrame:
    """seq, object_id, distance: distinct objects requested since the object's last request (null: none), from seq `start` on.

    An LRU cache of capacity C hits just where distance < C. Between the last request p of an object and this one at s,
    the distinct objects are those whose next request lies beyond s: the requests after p, minus those
    that recur before s. For a request that is s - p - 1 minus the number of pairs (p', s') with
    p < p' and s' < s: nested reuse intervals, counted with a Fenwick tree. One pass over one trace, in one
    group: a cache's state is sequential, and a trace of 10^9 requests is 16 GB of (seq, prev).
    """
    mine = Window.partitionBy("object_id").orderBy("seq")
    pairs = trace.where(F.col("seq") >= start).select("seq", "object_id").withColumn("prev", F.lag("seq").over(mine))

    def nested(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        seqs, prevs = frame.seq.to_numpy(), frame.prev.to_numpy(dtype=float)
        low = int(seqs[0]) if len(seqs) else 0
        size = int(seqs[-1]) - low + 2 if len(seqs) else 1
        tree = np.zeros(size + 1, dtype=np.int64)
        out = []
        seen = 0
        for s, p in zip(seqs.tolist(), prevs.tolist(), strict=True):
            if math.isnan(p):
                out.append(None)
                continue
            i, smaller = int(p) - low + 1, 0
            while i > 0:
                smaller += tree[i]
                i -= i & -i
            out.append(s - int(p) - 1 - (seen - smaller))
            i, seen = int(p) - low + 1, seen + 1
            while i <= size:
                tree[i] += 1
                i += i & -i
        return pd.DataFrame({"seq": seqs, "object_id": frame.object_id.to_numpy(), "distance": pd.array(out, dtype="Int64")})

    return pairs.groupBy(F.lit(0).alias("run")).applyInPandas(nested, "seq long, object_id string, distance long")


def lru_distances(trace: DataFrame, most: int, start: int = 0, stretch: int = 50_000) -> DataFrame:
    """seq, object_id, distance as of reuse_distances, but null where it is `most` or more: all that caches up to that size ask for.

    The trace is cut into stretches that are counted in parallel. What a stretch leaves behind are its `most` last objects; an LRU
    stack of that size before each stretch follows from those of the stretches before, in one pass over
    at most `most` rows a stretch. With its stack put before it, a stretch is complete by itself.
    """
    used = trace.where(F.col("seq") >= start).select("seq", "object_id", F.floor(F.col("seq") / stretch).alias("stretch"))
    recent = Window.partitionBy("stretch").orderBy(F.desc("last"))
    left = used.groupBy("stretch", "object_id").agg(F.max("seq").alias("last")).withColumn("n", F.row_number().over(recent)).where(F.col("n") <= most).select("stretch", "object_id", "last")

    def stack(frame: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, int] = {}
        out = []
        for number, part in frame.sort_values(["stretch", "last"]).groupby("stretch"):
            out += [(number, obj, last) for obj, last in held.items()]
            for obj, last in zip(part.object_id.tolist(), part["last"].tolist(), strict=True):
                held.pop(obj, None)
                held[obj] = last
            held = dict(list(held.items())[-most:])
        return pd.DataFrame(out, columns=["stretch", "object_id", "last"])

    stacks = left.groupBy(F.lit(0).alias("run")).applyInPandas(stack, "stretch long, object_id string, last long")

    def count(key, frame: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        frame, before = frame.sort_values("seq"), before.sort_values("last")
        keys = before.object_id.tolist() + frame.object_id.tolist()
        found = _nested_distances(keys)[len(before) :]
        near = [None if d is None or d >= most else d for d in found]
        return pd.DataFrame({"seq": frame.seq.tolist(), "object_id": frame.object_id.tolist(), "distance": pd.array(near, dtype="Int64")})

    return used.groupBy("stretch").cogroup(stacks.groupBy("stretch")).applyInPandas(count, "seq long, object_id string, distance long")


def _nested_distances(keys: list) -> list[int | None]:
    """For each key the number of distinct keys since it stood last; None the first time. A Fenwick tree holds the last places of keys."""
    n = len(keys)
    tree, last, out, held = [0] * (n + 1), {}, [], 0
    for i, key in enumerate(keys, 1):
        p = last.get(key)
        if p is None:
            out.append(None)
            held += 1
        else:
            before, j = 0, p
            while j:
                before += tree[j]
                j &= j - 1
            out.append(held - before)
            j = p
            while j <= n:
                tree[j] -= 1
                j += j & -j
        j = i
        while j <= n:
            tree[j] += 1
            j += j & -j
        last[key] = i
    return out


def lru_curve(distances: DataFrame, capacities: tuple[int, ...]) -> DataFrame:
    """capacity, hits, requests, hit_ratio of LRU for all capacities in one pass."""
    hits = distances.agg(F.count("*").alias("requests"), *[F.sum(F.coalesce((F.col("distance") < c).cast("long"), F.lit(0))).alias(f"c{c}") for c in capacities])
    rows = hits.select("requests", F.explode(F.array(*[F.struct(F.lit(c).cast("long").alias("capacity"), F.col(f"c{c}").alias("hits")) for c in capacities])).alias("s"))
    return rows.select("s.capacity", "s.hits", "requests", F.round(F.col("s.hits") / F.col("requests"), 9).alias("hit_ratio"))


class Lru:
    def __init__(self, capacity: int):
        self.capacity, self.held = max(0, capacity), OrderedDict()

    def access(self, key) -> bool:
        if key in self.held:
            self.held.move_to_end(key)
            return True
        return False

    def insert(self, key) -> None:
        if not self.capacity:
            return
        self.held[key] = None
        self.held.move_to_end(key)
        if len(self.held) > self.capacity:
            self.held.popitem(last=False)


class Lru2(Lru):
    """Admits at an object's second miss; misses are never forgotten. The first is kept in mind, unless the caller knows it: before
    its second an object is never held, so its first miss is its first request that may be inserted."""

    def __init__(self, capacity: int):
        super().__init__(max(1, capacity))
        self.missed: set = set()

    def insert(self, key, first: bool | None = None) -> None:
        if first is None:
            first = key not in self.missed
            self.missed.add(key)
        if not first:
            super().insert(key)


class LfuDa:
    """Evicts the least age + frequency, oldest first, and makes that the age of what comes in. What the heap holds of objects that were asked
    for since, or are gone, is thrown out once it is the greater part."""

    def __init__(self, capacity: int):
        self.capacity, self.age, self.pushed = max(1, capacity), 0, 0
        self.held: dict = {}
        self.heap: list = []

    def _push(self, key, freq: int) -> None:
        self.pushed += 1
        self.held[key] = (freq, self.pushed)
        heapq.heappush(self.heap, (self.age + freq, self.pushed, key))
        if len(self.heap) > 2 * len(self.held) + 64:
            self.heap = [x for x in self.heap if x[2] in self.held and self.held[x[2]][1] == x[1]]
            heapq.heapify(self.heap)

    def access(self, key) -> bool:
        if key not in self.held:
            return False
        self._push(key, self.held[key][0] + 1)
        return True

    def insert(self, key) -> None:
        while len(self.held) >= self.capacity:
            rank, pushed, old = heapq.heappop(self.heap)
            if old in self.held and self.held[old][1] == pushed:
                self.age = rank
                del self.held[old]
        self._push(key, 1)


class TinyLfu:
    """LRU with a count-min sketch (rows of 2^14, halved now and then) and a doorkeeper of 2^16 bits at the gate, which lets
    an object in if its bit is set, be it by another object."""

    # The sketch's shape, the odd step between its rows, the doorkeeper's bits.
    WIDTH, DEPTH, STEP, DOOR = 1 << 14, 4, 0x9E3779B97F4A7C15, 1 << 16

    # Hashes that are kept for the next request of the object.
    KEPT = 1 << 16

    def __init__(self, capacity: int):
        self.capacity, self.held = max(0, capacity), OrderedDict()
        self.sketch, self.door, self.seen = [[0] * self.WIDTH for _ in range(self.DEPTH)], set(), 0
        self.period = max(100_000, 10 * self.capacity)
        self.known: dict = {}

    def _places(self, key) -> tuple[list[int], int]:
        """The sketch's and the doorkeeper's."""
        if key not in self.known:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            h = fnv1a(str(key))
            self.known[key] = [((h + i * self.STEP) & 0xFFFFFFFFFFFFFFFF) % self.WIDTH for i in range(self.DEPTH)], h % self.DOOR
        return self.known[key]

    def access(self, key) -> bool:
        for row, p in zip(self.sketch, self._places(key)[0], strict=True):
            row[p] += 1
        self.seen += 1
        if self.seen >= self.period:
            self.sketch = [[n // 2 for n in row] for row in self.sketch]
            self.door.clear()
            self.seen = 0
        if key in self.held:
            self.held.move_to_end(key)
            return True
        return False

    def estimate(self, key) -> int:
        return min(row[p] for row, p in zip(self.sketch, self._places(key)[0], strict=True))

    def insert(self, key) -> None:
        if not self.capacity:
            return
        bit = self._places(key)[1]
        if bit not in self.door:
            self.door.add(bit)
            return
        if len(self.held) >= self.capacity:
            victim = next(iter(self.held))
            if self.estimate(key) < self.estimate(victim):
                return
            del self.held[victim]
        self.held[key] = None


POLICIES: dict[str, Callable] = {"LRU": Lru, "LRU2": Lru2, "LFUDA": LfuDa, "TINYLFU": TinyLfu}


#: Of a request: whether it may be inserted (1), and if so for the first time (2).
MAY = {"may": "uint8"}


def replay_policies(trace: DataFrame, capacities=(4, 25, 100), start: int = 0, policies=tuple(POLICIES), admit: str | None = None, block: int = BLOCK) -> DataFrame:
    """policy, capacity, hits, requests: each (policy, capacity) is a task that replays a copy of the trace, of objects and admit, block by block.

    admit: a 0/1 column of trace; if given, only misses with 1 are inserted. A cache's state is sequential, so a run is one task; what it
    holds is a cache and some blocks. LRU2 also wants to know each object's first request that may be inserted, which is found by an aggregation.
    """
    requests = trace.where(F.col("seq") >= start).select("seq", "object_id", F.coalesce((F.col(admit) if admit else F.lit(1)).cast("int"), F.lit(1)).alias("admit"))
    requests = requests.withColumn("may", F.when(F.col("admit") != 0, 1).otherwise(0)).drop("admit")
    if "LRU2" in policies:
        requests = written(requests, "replay-requests")  # read twice
        firsts = requests.where("may = 1").groupBy(F.col("object_id").alias("_object")).agg(F.min("seq").alias("_first"))
        joined = requests.join(firsts, F.col("object_id").eqNullSafe(F.col("_object")), "left")
        requests = joined.withColumn("may", F.when(F.col("seq") == F.col("_first"), 2).otherwise(F.col("may"))).drop("_object", "_first")
    runs = [(p, int(c)) for p in policies for c in capacities]

    def play(run: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        policy, capacity = runs[run]
        cache, hits, n = POLICIES[policy](capacity), 0, 0
        access, insert = cache.access, cache.insert
        for batch in batches:
            for objects, (may,) in requests_of(batch, MAY):
                n += len(objects)
                for obj, ok in zip(objects, may, strict=True):
                    if access(obj):
                        hits += 1
                    elif ok:
                        insert(obj, ok == 2) if policy == "LRU2" else insert(obj)
        yield pa.RecordBatch.from_pydict({"policy": [policy], "capacity": [capacity], "hits": [hits], "requests": [n]})

    return run_by_run(blocks(requests, [], MAY, block), len(runs), ["block"], play, "policy string, capacity long, hits long, requests long")


@dataclass(frozen=True)
class Variant:
    """A row of the ablation table of budgeted admission.

    control: how drift sets the budget's share alpha: "scaled" (by 1 + drift_gain * drift), "piecewise" (high or low) or "fixed".
    quality_boost: what the least quality gains as the cache falls short of the slot's objects. gate_if_poor: gate only when
    the spread of scores is below its average. crowded_gain: the miss gain grows as the cache falls short. drift_guard: drift
    counts only with a precision and a spread of scores large enough; "last" takes the spread of the slot before,
    "published" takes 0, as the published runs do, so that drift counts only until a precision is known.
    """

    name: str
    drift_gain: float = 0.0
    miss_gain: float = 0.5
    quality_min: float = 1.0
    quality_max: float = 1.0
    quality_boost: float = 0.0
    precision_sensitivity: float = 0.0
    gate: float = 1.0
    adaptive_gate: bool = False
    detector: str | None = None
    control: str = "scaled"
    drift_guard: str | None = None
    base_alpha: float = 0.08
    least_alpha: float = 0.005
    most_alpha: float = 0.2
    fixed_alpha: float | None = None
    gate_if_poor: bool = False
    crowded_gain: bool = False


_QUALITY = {"quality_min": 0.7, "quality_max": 1.3}
# What the ablations differ in.
VARIANTS = {
    v.name: v
    for v in (
        Variant("fixed", miss_gain=0.0),
        Variant("no_guard"),
        Variant("guard", **_QUALITY, quality_boost=0.1, precision_sensitivity=1.0, gate=0.05),
        Variant("no_gate", **_QUALITY, quality_boost=0.1, precision_sensitivity=1.0),
        Variant("no_quality", precision_sensitivity=1.0, gate=0.05),
        Variant("quality_only", **_QUALITY, quality_boost=0.1),
        Variant("precision_only", precision_sensitivity=1.0),
        Variant("drift_only", drift_gain=1.0, miss_gain=0.0),
        Variant("piecewise", miss_gain=0.0, control="piecewise"),
        Variant("full", drift_gain=1.0, **_QUALITY, precision_sensitivity=1.0, gate=0.05),
        Variant("drift_adaptive", drift_gain=1.5, **_QUALITY, quality_boost=0.1, precision_sensitivity=1.0, adaptive_gate=True, drift_guard="published"),
        Variant("switched", drift_gain=1.0, **_QUALITY, precision_sensitivity=1.0, gate=0.05, gate_if_poor=True, crowded_gain=True),
    )
}
# The precision aimed at, the least precision and spread for drift to count, the piecewise shares and their border,
# the adaptive gate's ends and the spreads that they belong to.
TARGET, GUARDED, PIECEWISE, GATES, SPREADS = 0.12, (0.06, 0.01), (0.04, 0.18, 0.6), (0.02, 0.2), (0.005, 0.03)

SLOT_LOG = (
    "variant string, capacity long, slot int, phase string, requests long, hits long, hit_ratio double, candidates long, budget long, selected long, alpha double, drift double, "
    "quality double, spread double, precision double, fill boolean, gated boolean, scale double, applied long, polluted long"
)


SLOT_LOG_SCHEMA = arrow_schema(SLOT_LOG)
#: Of the candidates' scores; their distance is the spread.
QUANTILES = (0.9, 0.5)


class BudgetController:
    """Admission budget of a cache slot from drift, misses, score quality and the precision of earlier admissions."""

    def __init__(self, v: Variant, capacity: int):
        self.v, self.capacity, self.spread, self.last_spread, self.drift = v, capacity, None, 0.0, DriftScore()
        self.detector = {"adwin": AdaptiveWindow, "page_hinkley": PageHinkley}[v.detector]() if v.detector else None

    def scale(self, n_objects: int) -> float:
        return min(1.0, max(0.4, self.capacity / n_objects)) if n_objects else 1.0

    def alpha(self, drift_raw: float, scale: float, precision: float | None, miss_rate: float) -> tuple[float, float]:
        """(share of the capacity, drift). Precision beyond its target raises the share; what follows is never below 0.7 of what drift set."""
        v = self.v
        drift = counted = self.drift.update(self.detector.update(miss_rate) if self.detector else drift_raw)
        if v.drift_guard and precision is not None:
            spread = self.last_spread if v.drift_guard == "last" else 0.0
            counted = drift if precision >= GUARDED[0] and spread >= GUARDED[1] else 0.0
        share = {"scaled": v.base_alpha * (1 + v.drift_gain * counted), "piecewise": PIECEWISE[counted >= PIECEWISE[2]], "fixed": v.base_alpha}[v.control]
        clip = lambda a: min(v.most_alpha, max(v.least_alpha, a))
        base = clip(share * scale if v.fixed_alpha is None else v.fixed_alpha)
        raised = 1 + v.precision_sensitivity * max(0.0, ((precision or 0.0) - TARGET) / TARGET)
        return clip(max(0.7 * base, base * raised)), drift

    def quality(self, scores: np.ndarray, scale: float) -> float:
        """Spread of the candidates' scores (90% over the median) by its EMA, within bounds; 1 without candidates."""
        return self.spread_quality(float(np.quantile(scores, 0.9) - np.quantile(scores, 0.5)), scale) if len(scores) else 1.0

    def spread_quality(self, spread: float, scale: float) -> float:
        v = self.v
        self.last_spread = spread
        self.spread = spread if self.spread is None else 0.2 * spread + 0.8 * self.spread
        return min(v.quality_max, max(min(v.quality_max, v.quality_min + (1 - scale) * v.quality_boost), spread / (self.spread + 1e-6)))

    def budget(self, alpha: float, scale: float, miss_rate: float, quality: float, candidates: int, filling: bool) -> tuple[int, bool]:
        """(objects to admit, whether the gate cut them)."""
        if not candidates:
            return 0, False
        v = self.v
        gain = v.miss_gain * (2 - scale if v.crowded_gain else 1)
        pressure = 1.0 if v.fixed_alpha is not None else (1 + gain * miss_rate) * quality
        b = math.ceil(self.capacity * alpha * pressure)
        if filling:
            return min(candidates, max(b, math.ceil(0.05 * self.capacity))), False
        gate = v.gate
        if v.adaptive_gate:
            x = ((self.spread or 0.0) - SPREADS[0]) / (SPREADS[1] - SPREADS[0])
            gate = GATES[0] + min(1.0, max(0.0, x)) * (GATES[1] - GATES[0])
        most = candidates if v.gate_if_poor and quality >= 1 else max(1, math.ceil(gate * candidates))
        return min(candidates, b, most), min(candidates, b) > most

    def most_budget(self) -> int:
        """No budget is larger, whatever a slot brings, but a scheduled one."""
        v = self.v
        pressure = 1.0 if v.fixed_alpha is not None else (1 + max(0.0, v.miss_gain) * (2 if v.crowded_gain else 1)) * max(1.0, v.quality_max)
        return max(math.ceil(self.capacity * max(0.0, v.most_alpha) * pressure), math.ceil(0.05 * self.capacity)) + 1


@dataclass
class SlotObjects:
    """What a run asks of a slot: its requests and distinct objects; of objects in reach, how often they are asked for, when last, and if they are positive;
    and the objects and scores at places in order of falling best score, ties by first request (from 1)."""

    slot: int
    requests: int
    n_objects: int
    asked: dict[Any, tuple[int, int, int, bool]]  # by object: n, last, place, positive
    placed: dict[int, tuple[Any, float]]

    @classmethod
    def of_requests(cls, frame: pd.DataFrame) -> SlotObjects:
        """From a slot's requests: slot, seq, object_id, score, y."""
        found = frame.assign(positive=frame.y == 1).groupby("object_id").agg(n=("seq", "size"), last=("seq", "max"), first=("seq", "min"), score=("score", "max"), positive=("positive", "max"))
        found = found.sort_values(["score", "first"], ascending=[False, True]).reset_index()
        found["place"] = range(1, len(found) + 1)
        return cls.of_objects(int(frame.slot.iloc[0]), len(frame), len(found), found)

    @classmethod
    def of_objects(cls, slot: int, requests: int, n_objects: int, rows: pd.DataFrame) -> SlotObjects:
        asked, placed = {}, {}
        for obj, n, last, place, positive, score in zip(*[rows[c].tolist() for c in ("object_id", "n", "last", "place", "positive", "score")], strict=True):
            asked[obj], placed[place] = (n, last, place, bool(positive)), (obj, score)
        return cls(slot, requests, n_objects, asked, placed)

    def quantile(self, q: float, gone: list[int]) -> float:
        """Of the scores of objects but those at the places gone, which are in rising order; as np.quantile has it."""
        at = (self.n_objects - len(gone) - 1) * q
        low = math.floor(at)
        return float(np.quantile([self._score(i, gone) for i in (low, math.ceil(at))], at - low))

    def _score(self, i: int, gone: list[int]) -> float:
        """The i-th least score, from 0."""
        place = self.n_objects - len(gone) - i
        for g in gone:
            place += g <= place
        return self.placed[place][1]

    def best(self, n: int, gone: list[int]) -> list:
        """The first n objects but those at the places gone."""
        out = set(gone)
        places = (p for p in range(1, self.n_objects + 1) if p not in out)
        return [self.placed[p][0] for p in islice(places, n)]


def guarded_run(v: Variant, capacity: int, slots: Iterable[pd.DataFrame], drift_raw: dict[int, float], warmup: int, scheduled: dict[int, int] | None = None) -> list[tuple]:
    """guarded_log of slots given as their requests: slot, seq, object_id, score, y in the order of requests."""
    return guarded_log(v, capacity, map(SlotObjects.of_requests, slots), drift_raw, warmup, scheduled)


def guarded_log(v: Variant, capacity: int, slots: Iterable[SlotObjects], drift_raw: Mapping[int, float], warmup: int, scheduled: Mapping[int, int] | None = None) -> list[tuple]:
    """Slot log of one run; within a slot nothing is inserted. scheduled: budgets of some slots, in place of the controller's.

    So hits are the requests of resident objects, and the order of eviction at the slot's end is that of last
    requests. Admissions go in before the next slot by falling score, ties by first miss. Those of a slot are polluted
    if none of them was hit in that slot or the next. The drift of the first cache slot is that against nothing.
    """
    cache, control = Lru(capacity), BudgetController(v, capacity)
    pending: list = []
    recent: deque = deque(maxlen=3)  # sets admitted
    unhit: deque = deque(maxlen=2)  # (row of the log, objects not hit since)
    log: list[list] = []
    for here in slots:
        slot, n = here.slot, here.requests
        caching = slot > warmup
        for obj in pending:
            cache.insert(obj)
        applied = set(pending)
        if applied:
            recent.append(frozenset(applied))
        row = [v.name, capacity, slot, "cache" if caching else "warmup", n, 0, 0.0, 0, 0, 0, v.base_alpha, 0.0, 1.0, None, None, False, False, 1.0, len(applied), 0]
        log.append(row)
        unhit.append((row, applied))
        if not caching:
            pending = []
            continue
        filling = len(cache.held) < math.ceil(0.9 * capacity)
        hit = sorted((obj for obj in cache.held if obj in here.asked), key=lambda obj: here.asked[obj][1])
        for obj in hit:
            cache.access(obj)
        for _, objects in unhit:
            objects.difference_update(hit)
        if len(unhit) == 2:
            unhit[0][0][-1] = len(unhit[0][1])
        precision = max((sum(obj in here.asked and here.asked[obj][3] for obj in s) / len(s) for s in recent), default=None)
        hits, gone = sum(here.asked[obj][0] for obj in hit), sorted(here.asked[obj][2] for obj in hit)
        candidates, miss_rate = here.n_objects - len(hit), (n - hits) / n
        scale = control.scale(here.n_objects)
        first = drift_raw.get(slot, 0.6) if any(r[3] == "cache" for r in log[:-1]) else 0.6
        alpha, drift = control.alpha(first, scale, precision, miss_rate)
        quality = control.spread_quality(here.quantile(0.9, gone) - here.quantile(0.5, gone), scale) if candidates else 1.0
        budget, gated = control.budget(alpha, scale, miss_rate, quality, candidates, filling)
        if scheduled and slot in scheduled:
            budget, gated = min(candidates, scheduled[slot]), False
        pending = here.best(budget, gone)
        spread = None if control.spread is None else round(control.spread, 9)
        row[5:18] = hits, round(hits / n, 9), candidates, budget, len(pending), round(alpha, 9), round(drift, 9), round(quality, 9), spread, precision, filling, gated, round(scale, 9)
    if unhit:
        unhit[-1][0][-1] = len(unhit[-1][1])
    return [tuple(r) for r in log]


def grid_variants(base: Variant, **choices) -> list[Variant]:
    """A variant for each combination of the fields' values, named by them."""
    return [replace(base, name=f"{base.name}[{','.join(f'{k}={v}' for k, v in zip(choices, values, strict=True))}]", **dict(zip(choices, values, strict=True))) for values in product(*choices.values())]


def placed_objects(scored: DataFrame) -> DataFrame:
    """slot, object_id, n, last, score (the best), positive, place (from 1 by falling score, ties by first request), n_objects: one row for each object of
    a slot, from tables of its own; requests without an object are one row without a place. No task holds a slot."""
    one = scored.groupBy("slot", "object_id").agg(F.count("*").alias("n"), F.max("seq").alias("last"), F.min("seq").alias("first_seq"), F.max("score").alias("score"), F.max(F.coalesce((F.col("y") == 1).cast("int"), F.lit(0))).alias("positive"))
    one = written(one, "slot-objects")
    placed = ranks.in_order(one.where("object_id is not null"), "score", {"place": F.lit(1)}).withColumnRenamed("place_all", "n_objects")
    return written(placed.drop("place_above").unionByName(one.where("object_id is null"), allowMissingColumns=True).drop("first_seq"), "slot-places")


def reached_objects(placed: DataFrame, capacity: int, budget: Column) -> DataFrame:
    """Of placed_objects, those that some run of that capacity, whose slots admit `budget` objects at most, can ask for.

    At most `capacity` objects of a slot are resident, all others are candidates. So what a run admits is among the first budget + capacity of
    a slot; what it holds was among them in some slot; and the candidates' quantiles lie within `capacity` places of the slot's.
    """
    above = F.col("n_objects") - F.col("place")  # from 0 by rising score
    ends = [(F.floor(F.lit(q) * (F.col("n_objects") - capacity - 1)), F.floor(F.lit(q) * (F.col("n_objects") - 1)) + 1 + capacity) for q in QUANTILES]
    near = reduce(lambda a, b: a | b, [above.between(low, high) for low, high in ends])
    marked = placed.where("object_id is not null").withColumns({"_top": F.col("place") <= budget + capacity, "_near": near})
    once = marked.where("_top").select("object_id").distinct().withColumn("_once", F.lit(True))
    return marked.join(once, "object_id", "left").where("_near or _once").drop("_top", "_near", "_once")


def guard_slot_log(scored: DataFrame, drift: DataFrame, variants=tuple(VARIANTS), capacities=(25, 100), warmup: int = 2, detector: str | None = None, schedule: DataFrame | None = None) -> DataFrame:
    """guard_object_log of scored requests: slot, seq, object_id, score, y."""
    return guard_object_log(placed_objects(scored), drift, variants, capacities, warmup, detector, schedule)


def guard_object_log(placed: DataFrame, drift: DataFrame, variants=tuple(VARIANTS), capacities=(25, 100), warmup: int = 2, detector: str | None = None, schedule: DataFrame | None = None) -> DataFrame:
    """The slot log of every (variant, capacity): a task a run, which is sent the objects in a run's reach, slot by slot, and none of the requests.

    placed: placed_objects. variants: names of the table or variants of one's own. schedule: capacity, slot, scheduled; the budgets of those slots.
    """
    chosen = {v.name: v for v in (VARIANTS[v] if isinstance(v, str) else v for v in variants)}
    runs = [(replace(v, detector=detector) if detector else v, int(c)) for v in chosen.values() for c in capacities]
    totals = placed.groupBy("slot").agg(F.sum("n").alias("requests"), F.count("object_id").alias("n_objects")).join(drift.select("slot", "drift_raw"), "slot", "left")
    if schedule is None:
        planned = totals.select("slot", F.lit(None).cast("array<struct<capacity:long,scheduled:long>>").alias("scheduled"))
    else:
        planned = schedule.where("scheduled is not null").groupBy("slot").agg(F.collect_list(F.struct(F.col("capacity").cast("long").alias("capacity"), F.col("scheduled").cast("long").alias("scheduled"))).alias("scheduled"))
    most, budget = max(c for _, c in runs), max(BudgetController(v, c).most_budget() for v, c in runs)
    asked = F.greatest(F.lit(budget), F.array_max(F.transform("scheduled", lambda x: x["scheduled"])))  # greatest passes over nulls
    reached = reached_objects(placed.join(planned, "slot", "left"), most, asked).select("slot", "object_id", "n", "last", "score", "positive", "place")
    shared = totals.join(planned, "slot", "left").join(reached, "slot", "left")

    def play(run: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, capacity = runs[run]
        raw: dict[int, float] = {}
        scheduled: dict[int, int] = {}

        def slots() -> Iterator[SlotObjects]:
            for slot, pieces in consecutive(batches, "slot"):
                rows = pa.Table.from_batches(list(pieces))
                first = rows.slice(0, 1).to_pylist()[0]
                if first["drift_raw"] is not None:
                    raw[slot] = first["drift_raw"]
                scheduled.update({slot: x["scheduled"] for x in first["scheduled"] or () if x["capacity"] == capacity})
                objects = rows.select(["object_id", "n", "last", "place", "positive", "score"]).filter(pc.field("object_id").is_valid())
                yield SlotObjects.of_objects(slot, first["requests"], first["n_objects"], objects.to_pandas())

        log = guarded_log(v, capacity, slots(), raw, warmup, scheduled)
        yield pa.RecordBatch.from_pylist([dict(zip(SLOT_LOG_SCHEMA.names, row, strict=True)) for row in log], schema=SLOT_LOG_SCHEMA)

    return run_by_run(shared, len(runs), ["slot"], play, SLOT_LOG)
