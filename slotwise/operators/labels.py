"""Labels of popular objects in a slot, churn of the labelled, and metrics of scores against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from slotwise.operators import ranks


def label_count(n: Column, share: float, up: bool = False) -> Column:
    k = F.ceil(n * share) if up else F.floor(n * share)
    return F.least(n, F.greatest(F.lit(1), k)).cast("int")


def _order() -> WindowSpec:
    return Window.partitionBy("slot").orderBy(F.desc("freq"), "first_seq")


def _ranked(objects: DataFrame, **sums: Column) -> DataFrame:
    """objects with place in the order, n_objects, and running sums."""
    return ranks.in_order(objects, "freq", {"place": F.lit(1)} | sums, ranged=False).withColumnRenamed("place_all", "n_objects")


def label_top_share(objects: DataFrame, share: float = 0.2, include_ties: bool = False) -> DataFrame:
    """objects with y = 1 for the top share by frequency, first seen first; or all that reach the last one's frequency."""
    ranked = _ranked(objects).withColumn("k", label_count(F.col("n_objects"), share))
    place = F.col("place_above") + 1 if include_ties else F.col("place")
    return ranked.select(*objects.columns, (place <= F.col("k")).cast("int").alias("y"))


def label_capacity(objects: DataFrame, capacity: int, factor: float = 1.0) -> DataFrame:
    """y = 1 for the capacity * factor most frequent objects (half to even)."""
    k = F.least(F.col("n_objects"), F.greatest(F.lit(1), F.bround(F.lit(capacity * factor)).cast("int")))
    return _ranked(objects).select(*objects.columns, (F.col("place") <= k).cast("int").alias("y"))


def label_coverage(objects: DataFrame, target: float = 0.5) -> DataFrame:
    """y = 1 for the shortest front of the order that covers the target share of the slot's requests."""
    ranked = _ranked(objects, run=F.col("freq"))
    return ranked.select(*objects.columns, (F.col("run") - F.col("freq") < target * F.col("run_all")).cast("int").alias("y"))


def label_info(objects: DataFrame, share: float = 0.2) -> DataFrame:
    """Per slot: objects, k, frequency at k, how many share it, their rate, and the share of requests covered."""
    ranked = _ranked(objects).withColumn("k", label_count(F.col("n_objects"), share))
    per_value = ranked.groupBy("slot", "freq").agg(F.count("*").alias("n"), F.first("n_objects").alias("n_objects"), F.first("k").alias("k"), F.max(F.when(F.col("place") == F.col("k"), F.col("freq"))).alias("at_k"), F.sum(F.when(F.col("place") <= F.col("k"), F.col("freq")).otherwise(0)).alias("covered"))
    info = per_value.groupBy("slot").agg(F.first("n_objects").alias("n_objects"), F.first("k").alias("k"), F.max("at_k").alias("freq_at_k"), F.sum(F.when(F.col("at_k").isNotNull(), F.col("n"))).alias("tie_count"), F.round(F.sum("covered") / F.sum(F.col("freq") * F.col("n")), 9).alias("coverage"))
    return info.withColumn("tie_rate", F.round(F.col("tie_count") / F.col("n_objects"), 9))


def label_audit(objects: DataFrame, share: float = 0.2, target: float = 0.5) -> DataFrame:
    """Per slot: sizes of the top-share and coverage labels, their overlap (Jaccard) and the top frequencies' mean and median."""
    a = label_top_share(objects, share)
    b = label_coverage(objects, target).select("slot", "object_id", F.col("y").alias("z"))
    both = a.join(b, ["slot", "object_id"])
    found = both.groupBy("slot").agg(F.sum("y").alias("n_top"), F.sum("z").alias("n_cover"), F.round(F.sum(F.col("y") * F.col("z")) / F.sum(F.greatest("y", "z")), 9).alias("jaccard"), F.round(F.avg(F.when(F.col("y") == 1, F.col("freq"))), 9).alias("top_mean"))
    medians = ranks.quantiles(a.where("y = 1"), "freq", {"top_p50": 0.5}, ["slot"]).withColumn("top_p50", F.round("top_p50", 9))
    return found.join(medians, "slot", "left")


def churn(labelled: DataFrame) -> DataFrame:
    """Per slot against the one before: Jaccard, retention, new and dropped share of the labelled objects."""
    top = labelled.where("y = 1").select("slot", "object_id")
    sizes = top.groupBy("slot").agg(F.count("*").alias("n"))
    kept = top.join(top.select((F.col("slot") + 1).alias("slot"), "object_id"), ["slot", "object_id"]).groupBy("slot").agg(F.count("*").alias("both"))
    pairs = sizes.join(sizes.select((F.col("slot") + 1).alias("slot"), F.col("n").alias("n_before")), "slot").join(kept, "slot", "left")
    both = F.coalesce("both", F.lit(0))
    return pairs.select("slot", both.alias("n_kept"), F.round(both / (F.col("n") + F.col("n_before") - both), 9).alias("jaccard"), F.round(both / F.col("n_before"), 9).alias("retention"), F.round((F.col("n") - both) / F.col("n"), 9).alias("new_share"), F.round((F.col("n_before") - both) / F.col("n_before"), 9).alias("drop_share"))


def streaks(labelled: DataFrame) -> DataFrame:
    """Unbroken runs of slots in which an object is labelled: object_id, first_slot, n_slots, gap since the last run."""
    mine = Window.partitionBy("object_id").orderBy("slot")
    runs = labelled.where("y = 1").withColumn("g", F.col("slot") - F.row_number().over(mine)).groupBy("object_id", "g").agg(F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
    order = Window.partitionBy("object_id").orderBy("first_slot")
    return runs.withColumn("gap", F.col("first_slot") - F.lag(F.col("first_slot") + F.col("n_slots")).over(order)).drop("g")


def budget_size(n: Column, budget: float | int) -> Column:
    """A share of n, rounded up, or a fixed number; 1 at least and n at most, 0 of none."""
    k = F.ceil(F.lit(budget) * n) if isinstance(budget, float) else F.lit(int(budget))
    return F.when(n <= 0, 0).otherwise(F.greatest(F.lit(1), F.least(n, k))).cast("int")


def cold_start(rows: DataFrame, gaps: int = 6) -> DataFrame:
    """Per slot of (slot, hist_len): objects with fewer than `gaps` requests behind them, their share, and the histories' mean, least and most."""
    cold = (F.col("hist_len") < gaps).cast("long")
    return rows.groupBy("slot").agg(F.sum(cold).alias("n_cold"), F.round(F.avg(cold), 9).alias("cold_share"), F.round(F.avg("hist_len"), 9).alias("mean_hist_len"), F.min("hist_len").alias("least_hist_len"), F.max("hist_len").alias("most_hist_len"))


def feature_stats(rows: DataFrame, features: tuple[str, ...], digits: int = 9, deviation_digits: int = 6) -> DataFrame:
    """Per slot and class: mean, population deviation, least and greatest of each feature."""
    found = []
    for f in features:
        found += [F.round(F.avg(f), digits).alias(f"mean_{f}"), F.round(F.stddev_pop(f), deviation_digits).alias(f"std_{f}"), F.min(f).alias(f"min_{f}"), F.max(f).alias(f"max_{f}")]
    return rows.groupBy("slot", "y").agg(*found)


def top_objects(objects: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent objects of each slot, for a log."""
    return objects.withColumn("place", F.row_number().over(_order())).where(F.col("place") <= n).select("slot", "object_id", "freq", "place")


def sample_objects(objects: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """n objects of each slot, drawn without replacement in the order of a seeded hash; the same at every run."""
    drawn = F.md5(F.concat_ws(":", F.lit(seed), "object_id", "slot").cast("binary"))
    return objects.withColumn("place", F.row_number().over(Window.partitionBy("slot").orderBy(drawn))).where(F.col("place") <= n).select("slot", "object_id", "place")


def score_metrics(scored: DataFrame, k_share: float | None = 0.2) -> DataFrame:
    """Per slot of (slot, score, y, first_seq): AUC by average ranks (NaN with one class), AP, precision and recall at k; ties by first request.

    k: that share of the slot's rows, or without one the number of positives."""
    ranked = ranks.in_order(scored, "score", {"place": F.lit(1), "hits": F.col("y")})
    ranked = ranked.withColumn("k", F.col("hits_all") if k_share is None else label_count(F.col("place_all"), k_share))
    ties = ranked.groupBy("slot", "place_above").agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.first("place_all").alias("n_all"), F.sum(F.when(F.col("y") == 1, F.col("hits") / F.col("place"))).alias("precisions"), F.max("k").alias("k"), F.sum(F.when(F.col("place") <= F.col("k"), F.col("y")).otherwise(0)).alias("at_k"))
    rank = F.col("n_all") - F.col("place_above") - (F.col("n") - 1) / 2  # ascending, the mean of equal scores
    sums = ties.groupBy("slot").agg(F.sum(rank * F.col("pos")).alias("ranks"), *[F.sum(c).alias(c) for c in ("n", "pos", "precisions", "at_k")], F.max("k").alias("k"))
    neg = F.col("n") - F.col("pos")
    auc = F.when((F.col("pos") > 0) & (neg > 0), (F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * neg)).otherwise(F.lit(float("nan")))
    return sums.select("slot", "n", "pos", F.round(auc, 9).alias("auc"), F.round(F.when(F.col("pos") > 0, F.col("precisions") / F.col("pos")), 9).alias("ap"), F.round(F.when(F.col("k") > 0, F.col("at_k") / F.col("k")), 9).alias("prec_at_k"), F.round(F.when(F.col("pos") > 0, F.col("at_k") / F.col("pos")), 9).alias("recall_at_k"))


def confusion(predicted: DataFrame) -> DataFrame:
    """Per slot of (slot, predicted, y): counts, accuracy, precision, recall, F1; 0 where undefined."""
    p, y = F.col("predicted"), F.col("y")
    sums = predicted.groupBy("slot").agg(F.sum(p * y).alias("tp"), F.sum(p * (1 - y)).alias("fp"), F.sum((1 - p) * y).alias("fn"), F.sum((1 - p) * (1 - y)).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    prec, rec = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select("slot", "tp", "fp", "fn", "tn", F.round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), 9).alias("accuracy"), F.round(prec, 9).alias("precision"), F.round(rec, 9).alias("recall"), F.round(ratio(2 * prec * rec, prec + rec), 9).alias("f1"))


def class_stats(labelled: DataFrame) -> DataFrame:
    """Per slot and class: count, mean, population deviation, least and largest frequency."""
    return labelled.groupBy("slot", "y").agg(F.count("*").alias("n"), F.round(F.avg("freq"), 9).alias("mean_freq"), F.round(F.stddev_pop("freq"), 6).alias("std_freq"), F.min("freq").alias("min_freq"), F.max("freq").alias("max_freq"))


def pearson(x: str, y: str) -> Column:
    """Correlation as an aggregate; null where a column is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / spread)


def correlations(pairs: DataFrame, x: str, y: str, by: str = "slot") -> DataFrame:
    """Pearson and Spearman (average ranks) of two columns per group."""
    linear = pairs.groupBy(by).agg(F.round(pearson(x, y), 6).alias("pearson"))
    return linear.join(ranks.rank_correlations(pairs, x, y, by).select(by, F.round("spearman", 6).alias("spearman")), by)
