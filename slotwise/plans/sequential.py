"""Sequential scores of logged series as native folds: a run's values, one a slot, are sorted into an array and folded in the JVM.

A run's array has as many values as it has slots, each of which stands for many requests; runs are folded in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.operators.drift import EPS


def folded(log: DataFrame, value: str, by: list[str], name: str, start: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]], order: str = "slot") -> DataFrame:
    """by, order and name: what step gives for each value of a run in turn. step: (state, value) -> (new state, output)."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("v"))))
    empty = F.array().cast("array<struct<at:int,out:double>>")

    def merge(state: Column, pair: Column) -> Column:
        new, out = step(state, pair["v"])
        told = F.struct(pair["at"].cast("int").alias("at"), out.cast("double").alias("out"))
        return F.struct(*[new[k].alias(k) for k in start], F.array_append(state["told"], told).alias("told"))

    found = F.aggregate("pairs", F.struct(*[c.alias(k) for k, c in start.items()], empty.alias("told")), merge, lambda s: s["told"])
    runs = log.groupBy(*by).agg(pairs.alias("pairs")) if by else log.agg(pairs.alias("pairs"))
    return runs.select(*by, F.explode(found).alias("s")).select(*by, F.col("s.at").alias(order), F.col("s.out").alias(name))


def _none() -> Column:
    return F.lit(None).cast("double")


def exponential_means(log: DataFrame, value: str, by: list[str], rate: float = 0.2, name: str = "ema") -> DataFrame:
    """The exponential mean of a run's values, from its first value on."""
    new = lambda s, v: F.when(s["m"].isNull(), v).otherwise(rate * v + (1 - rate) * s["m"])
    return folded(log, value, by, name, {"m": _none()}, lambda s, v: ({"m": new(s, v)}, new(s, v)))


def drift_scores(log: DataFrame, value: str, by: list[str], smooth: float = 0.3, slow: float = 0.1, clip: float = 3.0, eps: float = 1e-6) -> DataFrame:
    """score: the exponential mean of a raw drift from 0 on, in deviations from its own slow mean, clipped, and squashed into 0..1.

    The first value is the mean; after it, the variance takes the distance from the mean as it has just moved.
    """

    def step(s: Column, v: Column) -> tuple[dict[str, Column], Column]:
        ema = smooth * v + (1 - smooth) * s["ema"]
        mean = F.when(s["mean"].isNull(), ema).otherwise((1 - slow) * s["mean"] + slow * ema)
        var = F.when(s["mean"].isNull(), 0.0).otherwise((1 - slow) * s["var"] + slow * (ema - mean) * (ema - mean))
        z = F.least(F.lit(clip), F.greatest(F.lit(-clip), (ema - mean) / (F.sqrt(var) + eps)))
        return {"ema": ema, "mean": mean, "var": var}, 1 / (1 + F.exp(-z))

    return folded(log, value, by, "score", {"ema": F.lit(0.0), "mean": _none(), "var": F.lit(0.0)}, step)


def one_sided_scores(log: DataFrame, value: str, by: list[str], slow: float = 0.1, top: float = 2.5) -> DataFrame:
    """score: how far a value lies above the exponential mean of values, in deviations of steps from it, as a share of `top`; 0 below, and for the first."""

    def step(s: Column, v: Column) -> tuple[dict[str, Column], Column]:
        moved = v - s["mean"]
        mean = F.coalesce(s["mean"] + slow * moved, v)
        var = F.coalesce((1 - slow) * s["var"] + slow * moved * moved, F.lit(0.0))
        above = F.least(F.lit(top), F.greatest(F.lit(0.0), (v - mean) / F.sqrt(var + EPS))) / top
        return {"mean": mean, "var": F.when(s["mean"].isNull(), 0.0).otherwise(var)}, F.when(s["mean"].isNull(), 0.0).otherwise(above)

    return folded(log, value, by, "score", {"mean": _none(), "var": F.lit(0.0)}, step)


def page_hinkley(log: DataFrame, value: str, by: list[str], delta: float = 0.005, threshold: float = 0.3, order: str = "slot") -> DataFrame:
    """score: the running sum of what values exceed the running mean by, less delta each, minus its running minimum (0 at most), as a share of the
    threshold, 1 at most; and alarm: whether it is beyond. Three windows over a run."""
    so_far = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    excess = log.select(*by, order, (F.col(value) - F.avg(value).over(so_far) - delta).alias("_excess"))
    sums = excess.withColumn("_sum", F.sum("_excess").over(so_far))
    share = (F.col("_sum") - F.least(F.lit(0.0), F.min("_sum").over(so_far))) / threshold
    return sums.select(*by, order, F.least(F.lit(1.0), share).alias("score"), (share > 1).alias("alarm"))


def adaptive_window_scores(log: DataFrame, value: str, by: list[str], delta: float = 0.002, least: int = 10) -> DataFrame:
    """score: of the splits of the values kept, `least` on either side at least, the largest distance of the two means in units of the Hoeffding
    bound, 1 at most. At the first split beyond the bound, from the oldest on, the older part is dropped."""
    bound = 0.5 * math.log(2 / delta)

    def step(s: Column, v: Column) -> tuple[dict[str, Column], Column]:
        kept = F.array_append(s["kept"], v)
        n, total = F.size(kept), F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
        start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), F.lit(0).alias("cut"))

        def look(a: Column, x: Column) -> Column:
            i, left = a["i"] + 1, a["left"] + x
            open_ = (a["cut"] == 0) & (i >= least) & (n - i >= least)
            gap = F.abs(left / i - (total - left) / (n - i)) / F.sqrt(bound * (1 / i + 1 / (n - i)))
            top = F.when(open_, F.greatest(a["top"], gap)).otherwise(a["top"])
            return F.struct(i.alias("i"), left.alias("left"), top.alias("top"), F.when(open_ & (top > 1), i).otherwise(a["cut"]).alias("cut"))

        seen = F.aggregate(kept, start, look)
        return {"kept": F.slice(kept, seen["cut"] + 1, n)}, F.least(F.lit(1.0), seen["top"])

    return folded(log, value, by, "score", {"kept": F.array().cast("array<double>")}, step)
