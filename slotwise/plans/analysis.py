"""Analyses of runs' slot logs (variant, capacity, slot, ...): averages, matrices, lagged pairs, shifts, events, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.operators.labels import correlations, pearson
from slotwise.plans.compare import resampled

RUN = ["variant", "capacity"]


def run_averages(log: DataFrame, means: tuple[str, ...], shares: tuple[str, ...] = ()) -> DataFrame:
    """Per run: slots, mean of each column in means (nulls left out), share of slots where a flag of shares is set."""
    found = [F.round(F.avg(m), 9).alias(f"mean_{m}") for m in means]
    found += [F.round(F.avg(F.col(s).cast("int")), 9).alias(f"share_{s}") for s in shares]
    return log.groupBy(*RUN).agg(F.count("*").alias("n_slots"), *found)


def running_extremes(log: DataFrame, column: str) -> DataFrame:
    """log with the least, the greatest and the sum of column over the run's slots so far."""
    so_far = Window.partitionBy(*RUN).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumns({"least": F.min(column).over(so_far), "greatest": F.max(column).over(so_far), "total": F.round(F.sum(column).over(so_far), 9)})


def lagged_correlation(log: DataFrame, metric: str, outcome: str) -> DataFrame:
    """Per run: pairs of a slot's outcome and the metric of the slot before, and their Pearson correlation; pairs with a null are left out."""
    before = F.lag(metric).over(Window.partitionBy(*RUN).orderBy("slot"))
    pairs = log.select(*RUN, before.cast("double").alias("x"), F.col(outcome).cast("double").alias("y")).where("x is not null and y is not null")
    return pairs.groupBy(*RUN).agg(F.count("*").alias("n_pairs"), F.round(pearson("x", "y"), 6).alias("pearson"))


def gain_matrix(runs: DataFrame, baseline: str, value: str = "hit_ratio") -> DataFrame:
    """runs (variant, capacity, value) with the gain over the baseline's value at the same capacity; null where it has none."""
    base = runs.where(F.col("variant") == baseline).select("capacity", F.col(value).alias("_base"))
    return runs.join(base, "capacity", "left").select(*RUN, value, F.round(F.col(value) - F.col("_base"), 9).alias("gain"))


def admission_intensity(log: DataFrame) -> DataFrame:
    """Per run: admissions a slot, candidates a slot, admissions per candidate, mean miss rate."""
    sums = log.groupBy(*RUN).agg(F.avg("selected").alias("a"), F.avg("candidates").alias("c"), F.sum("selected").alias("n"), F.sum("candidates").alias("m"), F.avg(1 - F.col("hits") / F.col("requests")).alias("r"))
    rate = F.when(F.col("m") > 0, F.col("n") / F.col("m"))
    return sums.select(*RUN, F.round("a", 9).alias("selected_per_slot"), F.round("c", 9).alias("candidates_per_slot"), F.round(rate, 9).alias("admit_rate"), F.round("r", 9).alias("miss_rate"))


def stability(log: DataFrame, column: str = "hr") -> DataFrame:
    """Per run: mean and population deviation of column over slots, the mean step between neighbouring slots, the least value."""
    step = F.abs(F.col(column) - F.lag(column).over(Window.partitionBy(*RUN).orderBy("slot")))
    return log.withColumn("_step", step).groupBy(*RUN).agg(F.round(F.avg(column), 9).alias("mean"), F.round(F.stddev_pop(column), 6).alias("deviation"), F.round(F.avg("_step"), 9).alias("mean_step"), F.min(column).alias("least"))


def control_correlations(log: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman of two columns over each run's slots."""
    named = log.withColumn("_run", F.concat_ws("/", *RUN))
    names = named.select("_run", *RUN).distinct()
    return names.join(correlations(named.select("_run", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "x", "y", "_run"), "_run").drop("_run")


def best_variants(runs: DataFrame, by: str | None = "capacity", value: str = "hit_ratio") -> DataFrame:
    """The variant of the greatest mean value, for each `by` or of all; of equal ones the first by name."""
    keys = [by] if by else []
    means = runs.groupBy(*keys, "variant").agg(F.round(F.avg(value), 9).alias("mean"))
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("mean"), "variant")
    return means.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def compare_by(runs: DataFrame, keys: list[str], a: str, b: str, value: str = "hit_ratio", keep: bool = False) -> DataFrame:
    """keys, value of a and of b, their difference; rows that only one has go, or with keep those of a stay as "missing"."""
    left = runs.where(F.col("variant") == a).select(*keys, F.col(value).alias(f"{value}_a"))
    right = runs.where(F.col("variant") == b).select(*keys, F.col(value).alias(f"{value}_b"))
    d = F.col(f"{value}_a") - F.col(f"{value}_b")
    both = left.join(right, keys, "left" if keep else "inner").withColumn("delta", F.round(d, 9))
    return both.withColumn("outcome", F.when(d.isNull(), "missing").when(F.abs(d) < 1e-6, "tie").when(d > 0, "win").otherwise("lose"))


def shift_miss_area(log: DataFrame, change: int, window: int = 30) -> DataFrame:
    """Per run: sum of the miss ratios of the first `window` slots from slot `change` on, and how many there are."""
    after = log.where((F.col("slot") >= change) & (F.col("slot") < change + window))
    return after.groupBy(*RUN).agg(F.count("*").alias("n_slots"), F.round(F.sum(1 - F.col("hr")), 9).alias("miss_area"))


def pick_events(log: DataFrame, signal: str, before: int = 5, after: int = 10, most: int = 8, gap: int = 3) -> DataFrame:
    """variant, capacity, event (a slot): a run's slots of the greatest signal, the later of equal ones first, with room on both sides and more
    than `gap` places apart. A native fold over a run's slots, greatest first; null and NaN are never picked."""
    order = Window.partitionBy(*RUN).orderBy("slot")
    n = F.count("*").over(Window.partitionBy(*RUN))
    placed = log.select(*RUN, "slot", F.col(signal).cast("double").alias("v"), (F.row_number().over(order) - 1).alias("at"), n.alias("n"))
    roomy = placed.where((F.col("at") >= before) & (F.col("at") < F.col("n") - after) & F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    ranked = roomy.groupBy(*RUN).agg(F.sort_array(F.collect_list(F.struct("v", "at", "slot")), False).alias("c"))
    take = lambda s, x: F.when((F.size(s) < most) & F.forall(s, lambda p: F.abs(p["at"] - x["at"]) > gap), F.array_append(s, F.struct(x["at"].alias("at"), x["slot"].cast("int").alias("slot")))).otherwise(s)
    picked = F.aggregate("c", F.array().cast("array<struct<at:int,slot:int>>"), take)
    return ranked.select(*RUN, F.explode(picked).alias("s")).select(*RUN, F.col("s.slot").alias("event"))


def event_study(log: DataFrame, signal: str, value: str = "hr", before: int = 5, after: int = 10, most: int = 8, gap: int = 3) -> DataFrame:
    """Per run and offset from -before to after: mean of value around the slots of the greatest signal, and of how many events."""
    wide = pick_events(log, signal, before, after, most, gap).withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("slot", F.col("event") + F.col("offset"))
    return wide.join(log.select(*RUN, "slot", F.col(value).alias("_v")), [*RUN, "slot"]).groupBy(*RUN, "offset").agg(F.count("*").alias("n_events"), F.round(F.avg("_v"), 9).alias("mean"))


def empirical_distribution(log: DataFrame, value: str) -> DataFrame:
    """variant, capacity, value, share: even ranks from 0 to 1 of a run's values in ascending order, equal ones by slot."""
    order = Window.partitionBy(*RUN).orderBy(value, "slot")
    place, n = F.row_number().over(order) - 1, F.count("*").over(Window.partitionBy(*RUN))
    return log.select(*RUN, "slot", value, F.round(F.when(n > 1, place / (n - 1)).otherwise(0.0), 9).alias("share"))


def weight_changes(weights: DataFrame, eps: float = 1e-6) -> DataFrame:
    """weights (slot, created, weight) per slot: mean, deviation, least, greatest, share at or below eps, and L1 change of the
    normalised weights from the slot before, by place (oldest first); null where either sums to 0."""
    place = F.row_number().over(Window.partitionBy("slot").orderBy("created"))
    shares = weights.withColumn("place", place).withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("slot")))
    now, last = shares.select("slot", "place", F.col("share").alias("p")), shares.select((F.col("slot") + 1).alias("slot"), "place", F.col("share").alias("q"))
    moved = now.join(last, ["slot", "place"], "full_outer").groupBy("slot").agg(F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))).alias("l1"), F.count("p").alias("n"), F.count("q").alias("m"))
    stats = weights.groupBy("slot").agg(F.count("*").alias("n_members"), F.avg("weight").alias("mean"), F.stddev_pop("weight").alias("deviation"), F.min("weight").alias("least"), F.max("weight").alias("greatest"), F.avg((F.col("weight") <= eps).cast("int")).alias("frozen"))
    return stats.join(moved.where("n > 0").select("slot", F.when(F.col("m") > 0, F.col("l1")).alias("l1_change")), "slot", "left")


def bootstrap_gain(values: DataFrame, a: str, b: str, column: str = "hr", block: int = 5, draws: int = 2000, seed: int = 7) -> DataFrame:
    """Moving-block bootstrap per capacity of a's gain over b on slots that both have: difference of means and relative miss
    reduction, each with the central 95%. The same blocks are drawn from both."""
    left = values.where(F.col("variant") == a).select("capacity", "slot", F.col(column).alias("a"))
    both = left.join(values.where(F.col("variant") == b).select("capacity", "slot", F.col(column).alias("b")), ["capacity", "slot"])
    delta = F.col("a") - F.col("b")
    gains = {"delta": delta, "rmr": delta / F.greatest(F.lit(1e-12), 1 - F.col("b"))}
    spread = [F.percentile(g, F.lit(p)).alias(f"{k}_{end}") for k, g in gains.items() for p, end in ((0.025, "low"), (0.975, "high"))]
    drawn = resampled(both, ["a", "b"], ["capacity"], "slot", block, draws, seed).groupBy("capacity").agg(*spread)
    whole = both.groupBy("capacity").agg(F.count("*").alias("n_slots"), F.avg("a").alias("a"), F.avg("b").alias("b")).select("capacity", "n_slots", *[g.alias(k) for k, g in gains.items()])
    return whole.join(drawn, "capacity").select("capacity", "n_slots", "delta", "delta_low", "delta_high", "rmr", "rmr_low", "rmr_high")


def older_drift(miss_rate: Column, jsd: Column, sensitivity: float = 10.0, miss_weight: float = 0.2, jsd_weight: float = 0.8) -> Column:
    """Drift of misses and identities together, times the sensitivity, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sensitivity * (miss_weight * miss_rate + jsd_weight * jsd)))
