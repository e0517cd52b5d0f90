"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within a source, documents are range-sorted by key: the key's
first digits give a range of keys, a window sorts inside a range, and the ranges' totals are summed up
from range to range. The sum of words before a document decides whether the last, partial epoch
still takes it; the document at the cut is taken in part, so each source meets its budget exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.llm.common import WORD, materialize

#: Rows that a range of keys holds on average, if all were of one source; ranges are named by so many hex digits of the key.
RANGE_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Adds target to totals (source, source_size): a row for each source.

    Sources in code-point order, null last, weigh `weights`, repeating. Targets share 100% of all sizes by
    weight but stop at `most` times the source's size, the excess reshared by weight. That is
    min(weight * level, most * size) for the one level at which the targets add up; in order of size/weight
    the stopped sources come first, so running sums give the level after each possible number of them.
    The windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    stops = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    level = (F.sum("source_size").over(everywhere) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    tried = weighed.withColumn("level", level).withColumn("stops_here", F.col("weight") * F.col("level") > most * F.col("source_size"))
    # The level that holds is the one of the first source that doesn't stop; if all stop, none is needed.
    held = tried.withColumn("held", F.min(F.when(~F.col("stops_here"), F.struct((F.col("source_size") / F.col("weight")).alias("ratio"), F.col("source").isNull().alias("none"), "source", "level"))).over(everywhere))
    stopped = (F.lit(most) * F.col("source_size")).cast("double")
    return held.select("source", "source_size", F.when(F.col("held").isNull(), stopped).otherwise(F.least(F.col("weight") * F.col("held.level"), stopped)).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each of docs: doc_id, source, size, source_size, target, taken and the columns in carry.

    taken (words the mix takes of a document, repeats counted) is the size for each full epoch of the source and, in
    the last, partial epoch, the words before the cut. A null text or one without words has size 0
    and is taken 0 times; null is a source of its own. The key hashes id and text, so rows
    with equal ids are dealt out apart, and rows equal in both by the columns in carry; wholly equal rows tie, and as they
    are equal, it shows nowhere which of them is taken first. Columns of docs that are not named are ignored, whatever their names. An empty table stays empty.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"), *carry)
    sized = materialize(sized, "mix")
    rows, digits = sized.count(), 3
    while RANGE_ROWS * 16**digits < rows:
        digits += 1
    return _taken(sized, weights, most, carry, digits)


def _taken(sized: DataFrame, weights: tuple[int, ...], most: int, carry: tuple[str, ...], digits: int) -> DataFrame:
    """sized: source, size, key and more columns; adds source_size, target and taken. digits of the key name its range."""
    # A null source gets a key of its own that equals itself, so window and join share one exchange.
    by = ["no_source", "source_key", "range"]
    ranged = sized.withColumns({"no_source": F.col("source").isNull(), "source_key": F.coalesce("source", F.lit("")), "range": F.substring("key", 1, digits)})
    sums = materialize(ranged.groupBy("source", *by).agg(F.sum("size").alias("words")), "mix-sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    ranges = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("range_start", F.coalesce(F.sum("words").over(ranges), F.lit(0))).alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source")).select("s.no_source", "s.source_key", "s.range", "range_start", "source_size", "target")
    inside = Window.partitionBy(*by).orderBy("key", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("in_range", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets.hint("merge"), by)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("range_start") - F.col("in_range")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select(*[c for c in sized.columns if c != "key"], "source_size", "target", taken.cast("long").alias("taken"))
