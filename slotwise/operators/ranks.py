"""Exact order statistics of groups of any size: ranks, running sums and quantiles, of which no task holds a group.

Rows are counted for each value first. Values' counts are summed up over ranges of values, then within a range; rows of one
value, of which there may be very many, over stretches of their first_seq, then within a stretch. Only small tables are joined to
the rows, which are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Distinct values of a range, and places of the trace in a stretch, that one task puts in order.
STRETCH = 65_536
_INF = float("inf")


def _key(value: str | Column) -> Column:
    """Null is the lowest value, tied with minus infinity; NaN is the greatest."""
    return F.coalesce((F.col(value) if isinstance(value, str) else value).cast("double"), F.lit(-_INF))


def _cut(values: DataFrame, by: list[str], name: str, stretch: int) -> DataFrame:
    """values with column name: the range of _v within by, rising with it; as many equal ranges as it takes for `stretch` values each."""
    finite = F.when(F.abs("_v") < _INF, F.col("_v"))
    ends = values.groupBy(*by).agg(F.min(finite).alias("_low"), F.max(finite).alias("_high"), F.ceil(F.count("*") / stretch).alias("_parts"))
    place = F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * F.col("_parts"))
    inner = F.when(F.col("_high") > F.col("_low"), F.least(place, F.col("_parts") - 1)).otherwise(0)
    at = F.when(F.col("_v") == -_INF, -1).when(F.col("_v") >= _INF, F.col("_parts")).otherwise(inner)
    return values.join(ends, by).withColumn(name, at.cast("long")).drop("_low", "_high", "_parts")


def add_above(values: DataFrame, sums: list[str], by: list[str], ranged: bool = True, stretch: int = STRETCH) -> DataFrame:
    """values (one row for each by and _v) with <name>_above, the sum over greater values of the group, and <name>_all, over all.

    ranged: whether a group may hold so many distinct values that they have to be cut into ranges, twice, since they may lie close together
    somewhere. Frequencies need none: n requests have sqrt(2 n) different ones at most. The tables of ranges have a row for each range, those of a
    group's ends one for each group, and AQE broadcasts them only if they are found to be small.
    """
    down = Window.partitionBy(*by).orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, 0)
    if not ranged:
        whole = Window.partitionBy(*by)
        return values.withColumns({f"{c}_above": F.sum(c).over(down) - F.col(c) for c in sums} | {f"{c}_all": F.sum(c).over(whole) for c in sums})
    cut = _cut(_cut(values, by, "_r1", stretch), [*by, "_r1"], "_r2", stretch)
    cells = [*by, "_r1", "_r2"]
    totals = cut.groupBy(*cells).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    over, whole = Window.partitionBy(*by).orderBy(F.desc("_r1"), F.desc("_r2")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    before = totals.select(*cells, *[(F.sum(f"_t_{c}").over(over) - F.col(f"_t_{c}")).alias(f"_b_{c}") for c in sums], *[F.sum(f"_t_{c}").over(whole).alias(f"{c}_all") for c in sums])
    within = Window.partitionBy(*cells).orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, 0)
    found = cut.join(before, cells).withColumns({f"{c}_above": F.col(f"_b_{c}") + F.sum(c).over(within) - F.col(c) for c in sums})
    return found.drop("_r1", "_r2", *[f"_b_{c}" for c in sums])


def in_order(rows: DataFrame, value: str, sums: dict[str, Column], by: str = "slot", ranged: bool = True, stretch: int = STRETCH) -> DataFrame:
    """rows with, for each of sums: <name>, its sum over the group's rows of greater value, or of the same and no later first_seq; <name>_above, over
    those of greater value; <name>_all, over all. Rows of the same value and first_seq come in any order."""
    names = list(sums)
    keyed = rows.withColumns({"_v": _key(value), "_s": F.floor(F.col("first_seq") / stretch)} | {f"_x_{k}": c for k, c in sums.items()})
    cells = keyed.groupBy(by, "_v", "_s").agg(*[F.sum(f"_x_{k}").alias(k) for k in names])
    values = add_above(cells.groupBy(by, "_v").agg(*[F.sum(k).alias(k) for k in names]), names, [by], ranged, stretch)
    over = Window.partitionBy(by, "_v").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    earlier = cells.select(by, "_v", "_s", *[(F.sum(k).over(over) - F.col(k)).alias(f"_e_{k}") for k in names])
    earlier = earlier.join(values.drop(*names), [by, "_v"])
    within = Window.partitionBy(by, "_v", "_s").orderBy("first_seq").rowsBetween(Window.unboundedPreceding, 0)
    found = keyed.join(earlier, [by, "_v", "_s"]).withColumns({k: F.col(f"{k}_above") + F.col(f"_e_{k}") + F.sum(f"_x_{k}").over(within) for k in names})
    return found.select(*rows.columns, *names, *[f"{k}_above" for k in names], *[f"{k}_all" for k in names])


def value_counts(rows: DataFrame, value: str | Column, by: list[str], more: dict[str, Column] | None = None, stretch: int = STRETCH) -> DataFrame:
    """by, _v, n, and sums of more, for each value of a group; n_above, n_all; rank: ascending, equal values sharing their mean rank."""
    values = rows.groupBy(*by, _key(value).alias("_v")).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in (more or {}).items()])
    found = add_above(values, ["n"], by, stretch=stretch)
    return found.withColumn("rank", F.col("n_all") - F.col("n_above") - (F.col("n") - 1) / 2)


def quantiles(rows: DataFrame, value: str | Column, shares: dict[str, float], by: list[str], stretch: int = STRETCH) -> DataFrame:
    """by and a column for each share: that quantile of the group's values that are not null, interpolated between the two beside it."""
    value = F.col(value) if isinstance(value, str) else value
    values = value_counts(rows.where(value.isNotNull()), value, by, stretch=stretch)
    below = F.col("n_all") - F.col("n_above") - F.col("n")
    found = {}
    for name, share in shares.items():
        at = (F.col("n_all") - 1) * F.lit(share)
        low, high = (F.max(F.when((below <= i) & (i < below + F.col("n")), F.col("_v"))) for i in (F.floor(at), F.ceil(at)))
        found[name] = low + (high - low) * F.max(at - F.floor(at))
    return values.groupBy(*by).agg(*[c.alias(k) for k, c in found.items()])


def rank_correlations(pairs: DataFrame, x: str, y: str, by: str, stretch: int = STRETCH) -> DataFrame:
    """by, spearman: the correlation of average ranks; null where a column is constant. Equal pairs are counted before they meet their ranks."""
    counted = pairs.groupBy(by, _key(x).alias("_x"), _key(y).alias("_y")).agg(F.count("*").alias("n"))
    both = counted
    for c, of in (("_x", x), ("_y", y)):
        off = F.col("rank") - (F.col("n_all") + 1) / 2  # a group's mean rank is known
        both = both.join(value_counts(pairs, of, [by], stretch=stretch).select(by, F.col("_v").alias(c), off.alias(f"d{c}")), [by, c])
    n, dx, dy = F.col("n"), F.col("d_x"), F.col("d_y")
    spread = F.sqrt(F.sum(n * dx * dx) * F.sum(n * dy * dy))
    return both.groupBy(by).agg(F.when(spread > 0, F.sum(n * dx * dy) / spread).alias("spearman"))
