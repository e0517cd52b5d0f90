"""Per-request and per-slot operators: clamping, gaps, frequencies, feature sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.operators import ranks

#: Gap of an object without so long a history.
SENTINEL = 1e6
GAPS = 6
#: Completed slots that the short, middle and long frequency sum up.
SPANS = {"f_short": 1, "f_mid": 7, "f_long": 30}
FEATURE_SETS = {"A0": ("gaps",), "A1": ("gaps",), "A2": ("gaps", "f_short", "f_mid", "f_long", "f_cum"), "A3": ("f_short", "f_mid", "f_long", "f_cum"), "A1-old": ("gaps", "f_short"), "A3-old": ("gaps", "f_short", "f_mid", "f_long", "f_cum", "f_slot")}


def clamp_time(trace: DataFrame, raw: str = "raw_ts", last: float | None = None) -> DataFrame:
    """trace with ts: a late timestamp is lifted to the largest so far, a null is the one before plus 1 (first: 1).

    last: the ts of the request before the first of trace, where trace goes on from another.

    With c nulls up to a row, ts - c never falls, so ts = c + the running maximum of raw - c over non-null rows, 0 at
    least if the first row is null. Both runs are two-level: within slots, and over the slots' totals.
    """
    within = Window.partitionBy("slot").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    over_slots = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    missing = F.col(raw).isNull().cast("long")
    per_slot = trace.groupBy("slot").agg(F.sum(missing).alias("n"))
    nulls = per_slot.select("slot", F.coalesce(F.sum("n").over(over_slots), F.lit(0)).alias("before"))
    counted = trace.join(nulls, "slot").withColumn("c", F.col("before") + F.sum(missing).over(within)).drop("before").withColumn("x", F.when(F.col(raw).isNull() & (F.col("seq") == 0), 0.0).otherwise(F.col(raw) - F.col("c")))
    tops = counted.groupBy("slot").agg(F.max("x").alias("top"))
    earlier = tops.select("slot", F.max("top").over(over_slots).alias("top"))
    run = F.greatest(F.max("x").over(within), F.col("top"), F.lit(last).cast("double"))  # greatest passes over nulls
    return counted.join(earlier, "slot").withColumn("ts", F.col("c") + run).drop("c", "x", "top")


def clamp_counters(clamped: DataFrame, raw: str = "raw_ts") -> DataFrame:
    """Corrected timestamps of each slot: number, share and nulls."""
    late = F.coalesce((F.col(raw) < F.col("ts")).cast("long"), F.lit(0))
    return clamped.groupBy("slot").agg(F.count("*").alias("n_requests"), F.sum(late).alias("n_late"), F.sum(F.col(raw).isNull().cast("long")).alias("n_null"), F.round(F.avg(late), 9).alias("late_share"))


#: Places of the trace over which one task looks at an object's requests.
STRETCH = 65_536


def with_gaps(trace: DataFrame, gaps: int = GAPS, sentinel: float = SENTINEL, stretch: int = STRETCH) -> DataFrame:
    """trace with g1..g<gaps>: time since the object's i-th last request; and hist_len: how many there were, gaps at most.

    An object's requests are looked at a stretch of the trace at a time, so the hottest object fills no task. What its first requests in a stretch need is
    carried in: the last timestamps of each stretch, `gaps` at most, of which those of the last `gaps` stretches with the object are enough.
    """
    here, there = Window.partitionBy("object_id", "_part").orderBy("seq"), Window.partitionBy("object_id", "_part")
    lags = {f"_g{i}": F.lag("ts", i).over(here) for i in range(1, gaps + 1)}
    placed = trace.withColumn("_part", F.floor(F.col("seq") / stretch)).withColumns({"_at": F.row_number().over(here), "_all": F.count("*").over(there), **lags})
    last = placed.where(F.col("_all") - F.col("_at") < gaps).groupBy("object_id", "_part").agg(F.max("_all").alias("_n"), F.sort_array(F.collect_list(F.struct("_at", "ts")), False)["ts"].alias("_last"))
    before = Window.partitionBy("object_id").orderBy("_part")
    earlier = F.flatten(F.filter(F.array(*[F.lag("_last", i).over(before) for i in range(1, gaps + 1)]), lambda x: x.isNotNull()))
    carried = last.select(F.col("object_id").alias("_object"), F.col("_part").alias("_of"), F.slice(earlier, 1, gaps).alias("_carried"), F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = placed.join(carried, F.col("object_id").eqNullSafe(F.col("_object")) & (F.col("_part") == F.col("_of")))
    at = F.col("_at")
    known = {i: F.when(at > i, F.col(f"_g{i}")).otherwise(F.try_element_at("_carried", F.lit(i + 1) - at)) for i in range(1, gaps + 1)}
    columns = {f"g{i}": F.coalesce(F.col("ts") - t, F.lit(sentinel)) for i, t in known.items()}
    found = joined.withColumns(columns | {"hist_len": F.least(F.col("_before") + at - 1, F.lit(gaps)).cast("int")})
    return found.select(*trace.columns, *columns, "hist_len")


def slot_objects(trace: DataFrame) -> DataFrame:
    """slot, object_id, freq, first_seq."""
    return trace.groupBy("slot", "object_id").agg(F.count("*").alias("freq"), F.min("seq").alias("first_seq"))


def slot_gaps(gapped: DataFrame, gaps: int = GAPS) -> DataFrame:
    """For each (slot, object) freq, first_seq and the gaps at its last (g) and first (first_g) request of the slot."""
    names = [f"g{i}" for i in range(1, gaps + 1)] + ["hist_len"]
    ends = gapped.groupBy("slot", "object_id").agg(F.count("*").alias("freq"), F.min("seq").alias("first_seq"), F.max_by(F.struct(*names), "seq").alias("last"), F.min_by(F.struct(*names), "seq").alias("first"))
    return ends.select("slot", "object_id", "freq", "first_seq", *[F.col(f"last.{n}").alias(n) for n in names], *[F.col(f"first.{n}").alias(f"first_{n}") for n in names])


def with_history(objects: DataFrame) -> DataFrame:
    """objects with f_short, f_mid, f_long and f_cum: requests in completed slots before."""
    mine = Window.partitionBy("object_id").orderBy("slot")
    spans = {name: F.coalesce(F.sum("freq").over(mine.rangeBetween(-n, -1)), F.lit(0)) for name, n in SPANS.items()}
    return objects.withColumns(spans | {"f_cum": F.coalesce(F.sum("freq").over(mine.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})


def feature_vector(kind: str, gaps: int = GAPS, prefix: str = "") -> Column:
    """array<double> of a feature set; prefix "first_" takes the gaps at the first request of the slot."""
    parts: list[str] = []
    for name in FEATURE_SETS[kind]:
        parts += [f"{prefix}g{i}" for i in range(1, gaps + 1)] if name == "gaps" else ["freq" if name == "f_slot" else name]
    return F.array(*[F.col(p).cast("double") for p in parts])


def log_frequency(freq: Column, slot_size: int | None = None) -> Column:
    return F.log1p(freq) if slot_size is None else F.log1p(freq) / F.log1p(F.lit(float(slot_size)))


def log_gap(gap: Column, top: float = SENTINEL, missing_as_nan: bool = False) -> Column:
    scaled = F.log1p(F.least(F.greatest(gap, F.lit(0.0)), F.lit(top)))
    return F.when(gap == top, F.lit(float("nan"))).otherwise(scaled) if missing_as_nan else scaled


def relative_times(trace: DataFrame) -> DataFrame:
    """Time views for audits: counter, and log of the seconds since the slot's start."""
    start = F.min("ts").over(Window.partitionBy("slot"))
    return trace.withColumns({"counter": F.col("seq") + 1, "relative_log": F.log1p(F.greatest(F.lit(0.0), F.col("ts") - start))})


def capacities(trace: DataFrame, percents=(0.8, 1, 2, 3, 4, 5), least: int = 0) -> DataFrame:
    """percent, capacity: that share of the distinct objects, rounded down."""
    total = trace.agg(F.countDistinct("object_id").alias("n_objects"))
    return total.select("n_objects", F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("percent")).withColumn("capacity", F.greatest(F.lit(least), F.floor(F.col("n_objects") * F.col("percent") / 100)).cast("long"))


def gap_audit(gapped: DataFrame, gaps: int = GAPS, sentinel: float = SENTINEL) -> DataFrame:
    """Per slot: negative gaps, requests with a real gap larger than the next, and quantiles of the first gap."""
    real = F.filter(F.array(*[f"g{i}" for i in range(1, gaps + 1)]), lambda g: g != sentinel)
    disorder = F.exists(F.sequence(F.lit(1), F.greatest(F.size(real) - 1, F.lit(1))), lambda i: (i < F.size(real)) & (F.try_element_at(real, i) > F.try_element_at(real, i + 1)))
    g1 = F.when(F.col("g1") != sentinel, F.col("g1"))
    found = gapped.groupBy("slot").agg(F.sum(F.exists(real, lambda g: g < 0).cast("long")).alias("n_negative"), F.sum(disorder.cast("long")).alias("n_disorder"))
    names = {f"g1_p{int(100 * p)}": p for p in (0.5, 0.9, 0.99)}
    return found.join(ranks.quantiles(gapped, g1, names, ["slot"]).select("slot", *[F.round(k, 6).alias(k) for k in names]), "slot", "left")


def gap_dimensions(gapped: DataFrame, gaps: int = GAPS, sentinel: float = SENTINEL, digits: int = 5) -> DataFrame:
    """Per slot and gap g1..: how many are real, and their mean, median, 90% quantile and greatest."""
    values = F.explode(F.array(*[F.struct(F.lit(f"g{i}").alias("gap"), F.col(f"g{i}").alias("v")) for i in range(1, gaps + 1)])).alias("s")
    each = gapped.select("slot", values).select("slot", "s.gap", F.when(F.col("s.v") != sentinel, F.col("s.v")).alias("v"))
    found = each.groupBy("slot", "gap").agg(F.count("v").alias("n_real"), F.round(F.avg("v"), digits).alias("mean"), F.round(F.max("v"), digits).alias("most"))
    middle = ranks.quantiles(each, "v", {"p50": 0.5, "p90": 0.9}, ["slot", "gap"]).select("slot", "gap", *[F.round(k, digits).alias(k) for k in ("p50", "p90")])
    return found.join(middle, ["slot", "gap"], "left").select("slot", "gap", "n_real", "mean", "p50", "p90", "most")


def time_inversions(trace: DataFrame, raw: str = "raw_ts") -> DataFrame:
    """Objects with a timestamp before that of their last request, and how many."""
    before = F.lag(raw).over(Window.partitionBy("object_id").orderBy("seq"))
    return trace.withColumn("_b", before).where(F.col(raw) < F.col("_b")).groupBy("object_id").agg(F.count("*").alias("n_inversions"))
