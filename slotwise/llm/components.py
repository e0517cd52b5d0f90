"""Connected components of an edge table, in rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import keeping, materialize


def _smallest(edges: DataFrame) -> DataFrame:
    """For each node its smallest neighbour, or itself if that is smaller."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))


def _is_settled(edges: DataFrame) -> bool:
    """Every node has one edge down and none up, or none down: stars around their smallest nodes."""
    ends = edges.select("a", F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("a").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not nodes.agg(F.count(F.when(F.expr("down > 0 and down + up > 1"), 1))).first()[0]


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, root (the smallest node reachable) for each node of edges (a, b: long).

    Large-star and small-star steps in turn: the first hangs every larger neighbour of a node below the
    smallest one, the second the smaller ones; edges never outnumber those given, and rounds grow with
    the logarithm of a component's width. Each step is a pre-aggregated minimum, written out, and a join that
    AQE can split at a hub. Rounds end once the edges are stars, and tables are as few files as their rows need.
    Loops and repeated edges do no harm; no edges give no rows. Of the tables only the result stays.
    """
    with keeping(edges.sparkSession, "cc-roots"):
        now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "cc")
        most = 2 * now.count()
        for _ in range(most_rounds):
            if _is_settled(now):
                break
            lows = materialize(_smallest(now), "cc-low", most)
            both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            large = both.where("b > a").join(lows, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
            large = materialize(large, "cc-large", most)  # now a > b throughout
            lows = materialize(large.groupBy("a").agg(F.min("b").alias("low")), "cc-low", most)
            small = large.join(lows, "a").select(F.col("b").alias("x"), F.col("a").alias("y"), "low")
            hung = small.where("x <> low").select(F.col("x").alias("a"), F.col("low").alias("b")).unionByName(lows.select("a", F.col("low").alias("b")))
            now = materialize(hung.distinct(), "cc", most)
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        return materialize(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct(), "cc-roots", most)
