"""Budget schedules from a slot log: what another run admitted, the same total evenly, or in another order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RUN = ("variant", "capacity")


def matched_schedule(log: DataFrame, budget: str = "selected") -> DataFrame:
    """variant, capacity, slot, scheduled: each slot's own figure."""
    return log.select(*RUN, "slot", F.col(budget).cast("long").alias("scheduled"))


def even_schedule(log: DataFrame, budget: str = "selected") -> DataFrame:
    """The run's mean (half to even) in each slot; the last takes what is left of the total, 0 at least."""
    totals = log.groupBy(*RUN).agg(F.sum(budget).alias("total"), F.count("*").alias("n"), F.max("slot").alias("last"))
    mean = F.bround(F.col("total") / F.col("n")).cast("long")
    rest = F.greatest(F.lit(0).cast("long"), (F.col("total") - mean * (F.col("n") - 1)).cast("long"))
    return log.select(*RUN, "slot").join(totals, list(RUN)).select(*RUN, "slot", F.when(F.col("slot") == F.col("last"), rest).otherwise(mean).alias("scheduled"))


def permuted_schedule(log: DataFrame, budget: str = "selected", seed: int = 7) -> DataFrame:
    """The run's figures dealt to its slots in an order that the seed decides; a window's rows are one run's slots."""
    here = log.select(*RUN, "slot", F.row_number().over(Window.partitionBy(*RUN).orderBy("slot")).alias("_place"))
    drawn = F.row_number().over(Window.partitionBy(*RUN).orderBy(F.md5(F.concat_ws(":", F.lit(seed), "slot").cast("binary")), "slot"))
    there = log.select(*RUN, drawn.alias("_place"), F.col(budget).cast("long").alias("scheduled"))
    return here.join(there, [*RUN, "_place"]).select(*RUN, "slot", "scheduled")
