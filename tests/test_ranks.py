"""Order statistics in ranges against sorting whole groups; a group that holds all rows."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotwise.operators import labels, ranks

SCORES = {
    "close": lambda r: 1 + r.random() * 1e-9 if r.random() < 0.9 else r.random() * 1e9,
    "tied": lambda r: float(r.randrange(3)),
    "mixed": lambda r: r.choice([float("inf"), float("-inf"), float("nan"), -0.0, 0.0, r.random(), float(r.randrange(40))]),
    "constant": lambda r: 7.0,
}


def rows_of(spark, kind, n=700, slots=1):
    r = random.Random(kind)
    rows = [(1 + i % slots, i, SCORES[kind](r), int(r.random() < 0.3)) for i in range(n)]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "slot int, first_seq long, score double, y int").repartition(5)


def falling(score):
    return -np.inf if np.isnan(score) else -score if score != np.inf else -1e300


@pytest.mark.parametrize("kind", SCORES)
@pytest.mark.parametrize("slots", [1, 3])
def test_running_sums_in_order(spark, kind, slots):
    rows, df = rows_of(spark, kind, slots=slots)
    got = {r.first_seq: r for r in ranks.in_order(df, "score", {"place": F.lit(1), "hits": F.col("y")}, stretch=16).collect()}
    assert len(got) == len(rows)
    for slot in range(1, slots + 1):
        mine = sorted((r for r in rows if r[0] == slot), key=lambda r: (falling(r[2]), r[1]))
        hits = 0
        for place, (_, seq, score, y) in enumerate(mine, 1):
            hits += y
            r = got[seq]
            above = [q for q in mine if falling(q[2]) < falling(score)]
            assert (r.place, r.hits, r.place_above, r.hits_above, r.place_all, r.hits_all) == (place, hits, len(above), sum(q[3] for q in above), len(mine), sum(q[3] for q in mine))


@pytest.mark.parametrize("kind", ["close", "tied", "constant"])
def test_quantiles_and_correlations(spark, kind):
    rows, df = rows_of(spark, kind)
    frame = pd.DataFrame(rows, columns=["slot", "first_seq", "score", "y"])
    shares = {"a": 0.0, "b": 0.5, "c": 0.9, "d": 0.99, "e": 1.0}
    found = ranks.quantiles(df.unionByName(df.limit(3).withColumn("score", F.lit(None).cast("double"))), "score", shares, ["slot"], stretch=16)
    assert np.allclose([found.first()[k] for k in shares], frame.score.quantile(list(shares.values())), rtol=1e-12)
    assert "ObjectHashAggregate" not in found._jdf.queryExecution().toString()
    got = ranks.rank_correlations(df, "score", "first_seq", "slot", stretch=16).first().spearman
    want = frame.score.rank().corr(frame.first_seq.rank())
    assert got is None if kind == "constant" else got == pytest.approx(want, abs=1e-9)


def test_nulls_are_lowest_and_no_rows_give_none(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, None), (1, 3, -5.0)], "slot int, first_seq long, score double")
    assert [r.first_seq for r in ranks.in_order(df, "score", {"place": F.lit(1)}).orderBy("place").collect()] == [1, 3, 0, 2]
    assert ranks.in_order(df.where("false"), "score", {"place": F.lit(1)}).count() == 0
    assert ranks.quantiles(df.where("score is null"), "score", {"p": 0.5}, ["slot"]).count() == 0


def test_no_window_holds_a_slot(spark):
    """A slot of all rows, most of one frequency: ranges hold at most a few stretches, and labels are those of a sort."""
    r = random.Random(4)
    freqs = [1 if r.random() < 0.9 else 1 + int(r.paretovariate(0.7)) for _ in range(3000)]
    df = spark.createDataFrame([(1, str(i), f, i) for i, f in enumerate(freqs)], "slot int, object_id string, freq long, first_seq long")
    order = sorted(range(3000), key=lambda i: (-freqs[i], i))
    assert {int(x.object_id) for x in labels.label_top_share(df).where("y = 1").collect()} == set(order[:600])
    values = df.select("slot", (F.col("first_seq") * 1.0).alias("_v")).unionByName(spark.createDataFrame([(1, 1e15)], "slot int, _v double"))
    cut = ranks._cut(ranks._cut(values, ["slot"], "_r1", 64), ["slot", "_r1"], "_r2", 64)
    assert max(x["count"] for x in cut.groupBy("slot", "_r1", "_r2").count().collect()) <= 128


def test_samples_and_top_objects_pass_on_few_rows_a_task(spark):
    df = spark.createDataFrame([(1, str(i), i % 7, i) for i in range(500)], "slot int, object_id string, freq long, first_seq long")
    for found in (labels.sample_objects(df, 5), labels.top_objects(df, 5)):
        assert "WindowGroupLimit" in found._jdf.queryExecution().toString() and found.count() == 5
