"""Comparison of runs: win/tie/lose, relative miss reduction, pivots, smoothing, bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.plans.sequential import exponential_means

TIE = 1e-6


def compare_runs(runs: DataFrame, a: str, b: str) -> DataFrame:
    """runs: variant, capacity, hit_ratio. Per capacity a against b: difference, relative miss reduction and outcome."""
    left = runs.where(F.col("variant") == a).select("capacity", F.col("hit_ratio").alias("hr_a"))
    right = runs.where(F.col("variant") == b).select("capacity", F.col("hit_ratio").alias("hr_b"))
    d = F.col("hr_a") - F.col("hr_b")
    return left.join(right, "capacity").select("capacity", "hr_a", "hr_b", F.round(d, 9).alias("delta_hr"), F.round(d / F.greatest(F.lit(1e-12), 1 - F.col("hr_b")), 9).alias("rmr"), F.when(F.abs(d) < TIE, "tie").when(d > 0, "win").otherwise("lose").alias("outcome"))


def summarize_outcomes(compared: DataFrame) -> DataFrame:
    counts = [F.sum((F.col("outcome") == o).cast("long")).alias(o) for o in ("win", "tie", "lose")]
    return compared.agg(F.round(F.avg("delta_hr"), 9).alias("mean_delta"), F.round(F.avg("rmr"), 9).alias("mean_rmr"), *counts)


def hit_ratio_pivot(runs: DataFrame, capacities) -> DataFrame:
    return runs.groupBy("variant").pivot("capacity", list(capacities)).agg(F.first("hit_ratio"))


def trailing_mean(values: DataFrame, column: str, window: int = 5, by: str | None = None, order: str = "slot") -> DataFrame:
    spec = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(order).rowsBetween(1 - window, 0)
    return values.withColumn(f"{column}_smooth", F.round(F.avg(column).over(spec), 9))


def exponential_mean(values: DataFrame, column: str, rate: float = 0.2, order: str = "slot") -> DataFrame:
    """slot and EMA of column, from the first value on: a native fold over the slots, one row each."""
    found = exponential_means(values.withColumn("slot", F.col(order)), column, [], rate, f"{column}_ema")
    return found.select(F.col("slot").alias(order), F.round(f"{column}_ema", 9).alias(f"{column}_ema"))


def resampled(values: DataFrame, columns: list[str], by: list[str], order: str = "slot", block: int = 3, draws: int = 500, seed: int = 7) -> DataFrame:
    """by, draw and the mean of each column: moving-block resamples of each group's series, as rows.

    A draw strings blocks of neighbouring values together until it has as many as the series; where a block starts is decided by the md5 of
    `seed:draw:block`, so anyone can draw the same, and the columns' blocks are the same.
    """
    here = Window.partitionBy(*by)
    placed = values.select(*by, *columns, (F.row_number().over(here.orderBy(order)) - 1).alias("_place"), F.count("*").over(here).alias("_n"))
    sizes = placed.groupBy(*by).agg(F.first("_n").alias("_n"))
    picked = sizes.select(*by, "_n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select("*", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("_n") / block) - 1).cast("int"))).alias("_block"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "draw", "_block").cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
    begun = picked.withColumn("_start", F.floor(drawn * F.greatest(F.lit(1), F.col("_n") - block + 1)))
    taken = begun.select(*by, "_n", "draw", F.col("_block"), "_start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("_k")).where(F.col("_block") * block + F.col("_k") < F.col("_n"))
    at = taken.select(*by, "draw", F.least(F.col("_start") + F.col("_k"), F.col("_n") - 1).cast("int").alias("_place"))
    return at.join(placed, [*by, "_place"]).groupBy(*by, "draw").agg(*[F.avg(c).alias(c) for c in columns])


def bootstrap_interval(values: DataFrame, column: str, by: str, order: str = "slot", block: int = 3, draws: int = 500, seed: int = 7) -> DataFrame:
    """Moving-block bootstrap of the mean of each group's series: mean, low and high of the central 95%."""
    means = resampled(values, [column], [by], order, block, draws, seed).groupBy(by).agg(F.percentile(column, F.lit(0.025)).alias("low"), F.percentile(column, F.lit(0.975)).alias("high"))
    return values.groupBy(by).agg(F.avg(column).alias("mean")).join(means, by)
