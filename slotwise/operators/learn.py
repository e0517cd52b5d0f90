"""Gaussian naive Bayes in relational form: moments per class, weighted and with missing values, and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least variance.
FLOOR = 1e-9


def class_moments(rows: DataFrame, features: list[str], weight: Column | None = None) -> DataFrame:
    """slot, y, n, and mean and population variance (floored) of each feature; two passes, since gaps can be 1e6."""
    w = F.lit(1.0) if weight is None else weight
    means = rows.groupBy("slot", "y").agg(F.sum(w).alias("n"), *[(F.sum(w * F.col(f)) / F.sum(w)).alias(f"m_{f}") for f in features])
    centred = rows.join(means, ["slot", "y"])
    spread = centred.groupBy("slot", "y").agg(*[F.greatest(F.sum(w * (F.col(f) - F.col(f"m_{f}")) ** 2) / F.sum(w), F.lit(FLOOR)).alias(f"v_{f}") for f in features])
    return means.join(spread, ["slot", "y"])


def weight_groups(rows: DataFrame, keys: list[str], features: list[str], weight: str, missing: bool = False) -> DataFrame:
    """keys, _w (a weight), _n (rows of it), and per feature _n_ (values), _m_ (mean) and _v_ (population variance).

    Rows of equal weight are summed up by counts, means and squared deviations, which merge from task to task without loss. missing: null and NaN are left out,
    feature by feature; without it, one such value makes its feature's moments null or NaN.
    """
    value = {f: F.when(~F.isnan(f), F.col(f)) if missing else F.col(f) for f in features}
    found = [F.count("*").cast("double").alias("_n")]
    for f, v in value.items():
        found += [(F.count(v) if missing else F.count("*")).cast("double").alias(f"_n_{f}"), F.avg(v).alias(f"_m_{f}"), F.var_pop(v).alias(f"_v_{f}")]
    return rows.groupBy(*keys, F.col(weight).alias("_w")).agg(*found)


def weighted_moments(rows: DataFrame, keys: list[str], features: list[str], weight: str, missing: bool = False) -> DataFrame:
    """keys, n (sum of weights), and mean m_ and population variance v_ (floored) of each feature, weighted: the groups of equal weight, merged.

    missing: as above; a feature without values has mean 0 and variance 1.
    """
    groups = weight_groups(rows, keys, features, weight, missing)
    share = {f: F.col("_w") * F.col(f"_n_{f}") for f in features}
    totals = groups.groupBy(*keys).agg(F.sum(F.col("_w") * F.col("_n")).alias("n"), *[F.sum(share[f]).alias(f"_t_{f}") for f in features], *[F.try_divide(F.sum(share[f] * F.col(f"_m_{f}")), F.sum(share[f])).alias(f"m_{f}") for f in features])
    both = groups.join(totals.withColumnRenamed("n", "_total"), keys)
    spread = both.groupBy(*keys).agg(F.max("_total").alias("n"), *[F.max(f"m_{f}").alias(f"m_{f}") for f in features], *[F.try_divide(F.sum(share[f] * (F.col(f"_v_{f}") + (F.col(f"_m_{f}") - F.col(f"m_{f}")) ** 2)), F.max(f"_t_{f}")).alias(f"v_{f}") for f in features])
    empty = {"m": 0.0, "v": 1.0}
    seen = lambda k, f: F.coalesce(f"{k}_{f}", F.lit(empty[k])) if missing else F.col(f"{k}_{f}")
    return spread.select(*keys, "n", *[seen("m", f).alias(f"m_{f}") for f in features], *[F.greatest(seen("v", f), F.lit(FLOOR)).alias(f"v_{f}") for f in features])


def count_moments(rows: DataFrame, features: list[str]) -> DataFrame:
    """The same of whole-number features, unweighted: from exact sums in one pass, so equal whatever the order of rows."""
    total = {f: F.col(f).cast("decimal(19,0)") for f in features}
    sums = rows.groupBy("slot", "y").agg(F.count("*").cast("double").alias("n"), *[F.sum(x).cast("decimal(38,0)").alias(f"s_{f}") for f, x in total.items()], *[F.sum((x * x).cast("decimal(38,0)")).alias(f"q_{f}") for f, x in total.items()])
    n = F.col("n").cast("decimal(19,0)")
    spread = {f: (n * F.col(f"q_{f}") - F.col(f"s_{f}") * F.col(f"s_{f}")).cast("double") / (F.col("n") * F.col("n")) for f in features}
    return sums.select("slot", "y", "n", *[(F.col(f"s_{f}").cast("double") / F.col("n")).alias(f"m_{f}") for f in features], *[F.greatest(v, F.lit(FLOOR)).alias(f"v_{f}") for f, v in spread.items()])


def score_next_slot(rows: DataFrame, moments: DataFrame, features: list[str]) -> DataFrame:
    """rows of each slot with p: P(y = 1) by the naive Bayes of the slot before. One model a slot and class."""
    wide = None
    for c in (0, 1):
        one = moments.where(F.col("y") == c).select((F.col("slot") + 1).alias("slot"), F.col("n").alias(f"n{c}"), *[F.col(f"{k}_{f}").alias(f"{k}{c}_{f}") for k in "mv" for f in features])
        wide = one if wide is None else wide.join(one, "slot")
    # Class against class, feature by feature: terms that are alike cancel exactly, however large a floored variance makes them.
    against = F.log(F.col("n0") / F.col("n1"))
    for f in features:
        far = {c: (F.col(f) - F.col(f"m{c}_{f}")) ** 2 / F.col(f"v{c}_{f}") for c in (0, 1)}
        against = against + 0.5 * (F.log(F.col(f"v1_{f}") / F.col(f"v0_{f}")) + (far[1] - far[0]))
    return rows.join(wide, "slot").withColumn("p", 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), against)))))
