"""A drift-aware ensemble (Learn++.NSE) over slots, and boosted trees over periods, both trained by distributed aggregations.

The driver walks over slots. Its state is small: at most `most` learners, each a few numbers a feature, with their
errors. Every step on a slot's rows is a Spark aggregation: how often the vote was wrong, the weighted moments (or spark.ml's own
training) of the new learner, and each learner's errors. Requests are scored in one pass, batch by batch, wherever they lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.operators.learn import FLOOR, weight_groups
from slotwise.sources.scratch import new_table, written

#: Errors and averaged errors are kept this far from 0 and 1.
LEAST = 1e-6


class Learner(Protocol):
    """A kind of learner. A model's margin of a row is the log-odds of y = 1, or as much: over 0 it says 1, and the sigmoid is P(1)."""

    def fit(self, rows: DataFrame, features: list[str]) -> Any:
        """The model of rows (features, y, weight); weights add up to 1."""
        ...

    def margins(self, rows: DataFrame, models: list, features: list[str]) -> DataFrame:
        """rows with margins: an array of each model's margin."""
        ...


def appended(schema: T.StructType, ddl: str) -> T.StructType:
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


@dataclass(frozen=True)
class Moments:
    """log P(1) - log P(0), and per class and feature mean and variance."""

    prior: float
    mean: np.ndarray
    var: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Class against class, feature by feature: alike terms cancel exactly. A missing value (NaN) says nothing."""
        far = (x[:, None, :] - self.mean) ** 2 / self.var
        return self.prior + np.nansum(0.5 * (np.log(self.var[0] / self.var[1]) + (far[:, 0] - far[:, 1])), axis=1)


class Bayes:
    """Gaussian naive Bayes of weighted moments; missing: NaNs are left out of them, else rows have none."""

    def __init__(self, missing: bool = False):
        self.missing = missing

    def fit(self, rows: DataFrame, features: list[str]) -> Moments:
        """From one aggregation: a row for each class and weight, of which an ensemble's rows have two."""
        groups = weight_groups(rows, ["y"], features, "weight", self.missing).collect()
        total, mean, var = np.zeros(2), np.zeros((2, len(features))), np.ones((2, len(features)))
        for c in (0, 1):
            mine = [g for g in groups if g.y == c]
            total[c] = sum(g["_w"] * g["_n"] for g in mine)
            for i, f in enumerate(features):
                parts = [(g["_w"] * g[f"_n_{f}"], g[f"_m_{f}"], g[f"_v_{f}"]) for g in mine if g[f"_n_{f}"]]
                if w := sum(p[0] for p in parts):
                    mean[c, i] = sum(p[0] * p[1] for p in parts) / w
                    var[c, i] = sum(p[0] * (p[2] + (p[1] - mean[c, i]) ** 2) for p in parts) / w
        prior = math.log(total[1] / total[0]) if total.all() else math.inf if total[1] else -math.inf
        return Moments(prior, mean, np.maximum(var, FLOOR))

    def margins(self, rows: DataFrame, models: list[Moments], features: list[str]) -> DataFrame:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch, features)
                table = np.column_stack([m.margin(x) for m in models]) if models else np.zeros((len(x), 0))
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(models))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(table.ravel()))], names=[*batch.schema.names, "margins"])

        return rows.mapInArrow(add, appended(rows.schema, "margins array<double>"))


def matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features])


class Trained:
    """A spark.ml classifier on assembled features; margin: an expression over what a model's transform adds."""

    def __init__(self, stages: list, margin: Column):
        self.stages, self.margin = stages, margin

    def fit(self, rows: DataFrame, features: list[str]) -> Any:
        """With one class only, its constant margin, which is what a model of a single class says."""
        seen = rows.agg(F.min("y").alias("low"), F.max("y").alias("high")).first()
        if seen.low == seen.high:
            return math.inf if seen.low == 1 else -math.inf
        return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), *self.stages]).fit(rows)

    def margins(self, rows: DataFrame, models: list, features: list[str]) -> DataFrame:
        out = rows.withColumn("margins", F.array().cast("array<double>"))
        kept = [*rows.columns, "margins"]
        for m in models:
            here, margin = (out, F.lit(m)) if isinstance(m, float) else (m.transform(out), self.margin)
            out = here.withColumn("margins", F.concat("margins", F.array(margin))).select(*kept)
        return out


def _columns() -> dict[str, str]:
    return {"labelCol": "y", "rawPredictionCol": "_raw", "predictionCol": "_said"}


def make_learner(kind: str) -> Learner:
    """nb, nb_missing (naive Bayes), svm (linear, standardised features), tree (Gini, to spark.ml's greatest depth)."""
    if kind in ("nb", "nb_missing"):
        return Bayes(kind == "nb_missing")
    if kind == "svm":
        return Trained([StandardScaler(inputCol="_x", outputCol="_z", withMean=True), LinearSVC(featuresCol="_z", weightCol="weight", maxIter=10, tol=1e-3, regParam=1e-2, standardization=False, **_columns())], vector_to_array("_raw")[1])
    if kind == "tree":
        share = vector_to_array("_p")[1]
        return Trained([DecisionTreeClassifier(featuresCol="_x", weightCol="weight", maxDepth=30, seed=7, probabilityCol="_p", **_columns())], F.when(share >= 1, float("inf")).when(share <= 0, float("-inf")).otherwise(F.log(share / (1 - share))))
    raise ValueError(f"no learner named {kind}")


@dataclass
class Member:
    model: Any
    created: int
    betas: list[float] = field(default_factory=list)


def member_weight(betas: list[float], slope: float, offset: float) -> float:
    """log of one over the mean beta, the recent ones counting more by a sigmoid of their age in slots."""
    recent = [1 / (1 + math.exp(slope * (age - offset))) for age in range(len(betas))][::-1]
    mean = sum(r * b for r, b in zip(recent, betas, strict=True)) / sum(recent)
    return math.log(1 / min(max(mean, LEAST), 1 - LEAST))


@dataclass
class Ensembles:
    """What a walk over the slots leaves: for each slot the models and weights before it, in order of their making."""

    learner: Learner
    before: dict[int, list[tuple[Any, float]]]
    weights: list[tuple[int, int, float]]
    errors: list[tuple[int, int, int, int]]

    def weight_table(self, spark) -> DataFrame:
        """slot, created, weight: after each slot's update."""
        return spark.createDataFrame(self.weights, "slot int, created int, weight double")

    def error_table(self, spark) -> DataFrame:
        """slot, n_members, n, n_wrong: the vote on a slot's rows before it learns from them."""
        return spark.createDataFrame(self.errors, "slot int, n_members int, n long, n_wrong long")


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def _vote(weights: list[float]) -> Column:
    """The weighted majority of margins; ties, and an ensemble without members, say 1."""
    ones = _total([F.when(F.col("margins")[i] > 0, w).otherwise(0.0) for i, w in enumerate(weights)])
    return (2 * ones >= sum(weights)).cast("int")


def fit_ensembles(rows: DataFrame, features: list[str], learner: str = "nb", slope: float = 0.5, offset: float = 10.0, most: int = 20) -> Ensembles:
    """rows: slot, features, y.

    Of a slot, rows that the ensemble got wrong weigh 1, others its error; the new member learns on these weights, and all
    members are weighed by their errors on them, recent slots ahead. Errors lie within [LEAST, 1 - LEAST], a member's at 0.5 at most. Counts
    of errors are whole numbers, so a repeated task or another partitioning changes no weight of theirs.
    """
    kind = make_learner(learner)
    table = written(rows.select("slot", "y", *[F.col(f).cast("double").alias(f) for f in features]), "ensemble-rows", by="slot")
    slots = [r.slot for r in table.select("slot").distinct().orderBy("slot").collect()]
    members: list[Member] = []
    weights: list[float] = []
    out = Ensembles(kind, {}, [], [])
    for slot in slots:
        out.before[slot] = [(m.model, w) for m, w in zip(members, weights, strict=True)]
        judged = kind.margins(table.where(F.col("slot") == slot), [m.model for m in members], features)
        judged = judged.withColumn("wrong", _vote(weights) != F.col("y") if members else F.lit(False)).drop("margins").persist()
        n, wrong = judged.agg(F.count("*"), F.sum(F.col("wrong").cast("long"))).first()
        out.errors.append((slot, len(members), n, wrong))
        least = min(max(wrong / n, LEAST), 1 - LEAST) if members else 1.0
        total = wrong + (n - wrong) * least
        weighed = judged.withColumn("weight", F.when(F.col("wrong"), 1.0).otherwise(least) / total)
        members.append(Member(kind.fit(weighed, features), slot))
        asked = kind.margins(judged, [m.model for m in members], features)
        missed = [((F.col("margins")[i] > 0).cast("int") != F.col("y")) for i in range(len(members))]
        counts = [F.sum((m & side).cast("long")).alias(f"{k}{i}") for i, m in enumerate(missed) for k, side in (("w", F.col("wrong")), ("r", ~F.col("wrong")))]
        found = asked.agg(*counts).first()
        judged.unpersist()
        for i, m in enumerate(members):
            e = max(LEAST, min(0.5, (found[f"w{i}"] + found[f"r{i}"] * least) / total))
            m.betas.append(e / (1 - e))
        members = members[-most:]
        weights = [member_weight(m.betas, slope, offset) for m in members]
        out.weights += [(slot, m.created, w) for m, w in zip(members, weights, strict=True)]
    return out


_SCORES = ("score", "vote", "n_members")


def _scored(judged: DataFrame, weights: list[float]) -> DataFrame:
    """score: the weighted mean of the members' P(1), 0.5 without members; vote; n_members."""
    p = _total([w / (1 + F.exp(-F.col("margins")[i])) for i, w in enumerate(weights)]) / sum(weights) if sum(weights) > 0 else F.lit(0.5)
    return judged.withColumns({"score": p, "vote": _vote(weights), "n_members": F.lit(len(weights))}).drop("margins")


def score_requests(requests: DataFrame, fitted: Ensembles, features: list[str]) -> DataFrame:
    """slot, seq, object_id, score, vote, n_members: each request by the ensemble of the slots before its own; of slots that
    none was fitted for, by the last one before.

    Naive Bayes: one pass over the requests, in batches; what travels to the tasks is a few numbers a feature and slot. spark.ml models: slot by
    slot, each slot's requests spread over tasks.
    """
    spark, slots = requests.sparkSession, sorted(fitted.before)
    asked = requests.select("slot", "seq", "object_id", *[F.col(f).cast("double").alias(f) for f in features])
    if not isinstance(fitted.learner, Bayes):
        table, path = written(asked, "score-requests", by="slot"), new_table(spark, "scores")
        columns = ["seq", "object_id", *_SCORES]
        for slot in slots:
            known = fitted.before[slot]
            here = fitted.learner.margins(table.where(F.col("slot") == slot), [m for m, _ in known], features)
            _scored(here, [w for _, w in known]).select(*columns).write.parquet(f"{path}/slot={slot}")
        return spark.read.schema("seq long, object_id string, score double, vote int, n_members int, slot int").parquet(path).select("slot", *columns)
    models: list[Moments] = []
    places = {}
    for known in fitted.before.values():
        for m, _ in known:
            if id(m) not in places:
                places[id(m)] = len(models)
                models.append(m)
    plan = {slot: ([places[id(m)] for m, _ in known], np.array([w for _, w in known])) for slot, known in fitted.before.items()}
    known_slots = np.array(slots)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = matrix(batch, features), batch.column("slot").to_numpy()
            score, vote, n = np.full(len(x), 0.5), np.ones(len(x), dtype=np.int32), np.zeros(len(x), dtype=np.int32)
            for slot in np.unique(at):
                mine = at == slot
                place = np.searchsorted(known_slots, slot, side="right") - 1
                numbers, w = plan[int(known_slots[place])] if place >= 0 else ([], np.zeros(0))
                if numbers:
                    margins = np.column_stack([models[i].margin(x[mine]) for i in numbers])
                    if w.sum() > 0:
                        score[mine] = (w / (1 + np.exp(-np.clip(margins, -700, 700)))).sum(axis=1) / w.sum()
                    vote[mine] = 2 * ((margins > 0) * w).sum(axis=1) >= w.sum()
                    n[mine] = len(numbers)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score), pa.array(vote), pa.array(n)], names=["slot", "seq", "object_id", *_SCORES])

    return asked.mapInArrow(judge, "slot int, seq long, object_id string, score double, vote int, n_members int")


def period_admission(rows: DataFrame, requests: DataFrame, features: list[str], warmup: int, every: int = 10, least: float = 0.5, rounds: int = 30, rate: float = 0.1, depth: int = 3) -> DataFrame:
    """requests (slot, seq, object_id) with admit: 1 if boosted trees of the period before give `least` at least; 1 before there are any.

    Periods are the warm-up slots, then `every` slots each. A period's trees (spark.ml's, on the logistic loss) see that period's rows alone; of
    a period with one class only, its share.
    """
    period = F.when(F.col("slot") <= warmup, 0).otherwise(F.floor((F.col("slot") - warmup - 1) / every) + 1).cast("int")
    spark = rows.sparkSession
    table = written(rows.withColumn("period", period).select("period", "y", *[F.col(f).cast("double").alias(f) for f in features]), "period-rows", by="period")
    asked = written(requests.withColumn("period", period).select("period", "seq", "slot", "object_id", *[F.col(f).cast("double").alias(f) for f in features]), "period-requests", by="period")
    path = new_table(spark, "admitted")
    boosted = Trained([GBTClassifier(featuresCol="_x", labelCol="y", maxIter=rounds, stepSize=rate, maxDepth=depth, maxBins=64, seed=7)], 2 * vector_to_array("rawPrediction")[1])
    learnt = {r.period for r in table.select("period").distinct().collect()}
    for p in sorted(r.period for r in asked.select("period").distinct().collect()):
        here, admit = asked.where(F.col("period") == p), F.lit(1)
        if p - 1 in learnt:
            here = boosted.margins(here, [boosted.fit(table.where(F.col("period") == p - 1), features)], features)
            admit = (1 / (1 + F.exp(-F.col("margins")[0])) >= least).cast("int")
        here.select("slot", "seq", "object_id", admit.alias("admit")).write.parquet(f"{path}/period={p}")
    return spark.read.schema("slot int, seq long, object_id string, admit int, period int").parquet(path).drop("period")
