"""Sharding along a Hilbert curve: rows that are alike in several metadata columns share a shard, so that filters on any of them skip files.

Each dimension is quantised into cells of about equally many rows. The cells' place on the curve orders the rows; Spark
range-partitions by it, counts what each partition holds, and runs of the order are cut into shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.llm.ann import hilbert_keys
from slotwise.llm.common import extended, materialize, shuffle_width, without

#: Bits of a dimension's cell; dimensions * BITS may be 62 at most.
BITS = 5
LAWS = ("rows", "bytes")
#: Result columns, and those that it takes to get there.
RESULTS = ("doc_id", "size", "text_crc32", "shard", "slot", "_row", "_one", "_key", "_part", "_first")


def _running(df: DataFrame, amounts: list[str]) -> DataFrame:
    """A sorted, range-partitioned df, written with _part (its partition), and for each amount what stands before a row in it."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), dict.fromkeys(amounts, 0)
        for batch in batches:
            sums = []
            for a in amounts:
                values = batch.column(a).to_numpy()
                ends = before[a] + np.cumsum(values)
                sums.append(pa.array(ends - values, pa.int64()))
                before[a] = int(ends[-1]) if len(ends) else before[a]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(batch), pa.int32()), *sums], names=[*batch.schema.names, "_part", *[f"{a}_before" for a in amounts]])

    schema = extended(df.schema, ", ".join(["_part int", *[f"{a}_before long" for a in amounts]]))
    return materialize(df.mapInArrow(add, schema), "ordered")


def _with_totals(ordered: DataFrame, amounts: list[str]) -> DataFrame:
    """ordered with each <amount>_before from the start of the whole order, and the amounts' totals as <amount>_all."""
    parts = ordered.groupBy("_part").agg(*[F.sum(a).alias(a) for a in amounts])  # a row for each of the writer's tasks
    earlier, every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = parts.select("_part", *[F.coalesce(F.sum(a).over(earlier), F.lit(0)).alias(f"{a}_shift") for a in amounts], *[F.sum(a).over(every).alias(f"{a}_all") for a in amounts])
    joined = ordered.join(F.broadcast(sums), "_part")
    return joined.withColumns({f"{a}_before": F.col(f"{a}_before") + F.col(f"{a}_shift") for a in amounts}).drop("_part", *[f"{a}_shift" for a in amounts])


def cell_borders(rows: DataFrame, column: str, cells: int) -> list:
    """The values at which a new one of `cells` equally large parts of the non-null rows begins, at most cells - 1; equal values fall into one cell.

    Values are counted, so a value that a third of all rows hold is one row here, and ordered in ranges.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    ordered = counts.repartitionByRange(shuffle_width(rows.sparkSession), column).sortWithinPartitions(column)
    placed = _with_totals(_running(ordered, ["n"]), ["n"])
    cell = F.expr(f"n_before * {cells} div n_all")
    # Of the values that begin in one cell the first is its border, so no more than cells - 1 rows come to the driver.
    firsts = placed.where(cell > 0).groupBy(cell.alias("cell")).agg(F.min(column).alias("v")).orderBy("v").collect()
    return [r.v for r in firsts]


def _cell(column: str, borders: list) -> Column:
    """0 for null, else 1 + the number of borders at or below the value."""
    below = sum(((F.col(column) >= F.lit(b)).cast("int") for b in borders), F.lit(1))
    return F.when(F.col(column).isNull(), 0).otherwise(below)


def order_by_curve(docs: DataFrame, dimensions: tuple[str, ...] = ("source", "lang", "n_chars"), shards: int = 16, law: str = "rows", id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, the dimensions and the columns of carry; slots number a shard's rows along the curve, from 0.

    size: UTF-8 bytes of the text (null: none) plus 1. law "rows": shards hold numbers of rows that differ by one at most;
    "bytes": a border lies at the row end that is nearest to an equal share of all sizes, so a shard's size is off by a document at
    most, and may be empty beside a document larger than a share. Null is a dimension's lowest cell. Rows of a cell are
    ordered by doc_id (nulls first), then by the text's checksum and size; rows equal in all of these, in the order read. A value that very many rows hold
    does not make a hot partition, since ranges go on within a cell. Empty texts are rows like others; an empty table has no shards.
    """
    if law not in LAWS:
        raise ValueError(f"law is one of {LAWS}")
    own = [c for c in dict.fromkeys((*dimensions, *carry)) if c != id_col and c.lower() not in RESULTS]
    text = F.coalesce(F.col(text_col), F.lit(""))
    columns = [F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *own]
    rows = materialize(docs.select(*columns, F.monotonically_increasing_id().alias("_row"), F.lit(1).cast("long").alias("_one")), "shard-rows")
    names = [{id_col: "doc_id"}.get(d, d) for d in dimensions]
    cells = [_cell(d, cell_borders(rows, d, (1 << bits) - 1)).alias(f"_c{i}") for i, d in enumerate(names)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid = np.column_stack([batch.column(f"_c{i}").to_numpy() for i in range(len(names))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(grid, bits), pa.int64())], names=[*batch.schema.names, "_key"])

    celled = rows.select("*", *cells)
    keyed = celled.mapInArrow(place, extended(celled.schema, "_key long")).drop(*[f"_c{i}" for i in range(len(names))])
    order = ["_key", "doc_id", "text_crc32", "size", "_row"]
    curve = _with_totals(_running(keyed.repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order), ["_one", "size"]), ["_one", "size"])
    if law == "rows":
        shard = F.expr(f"_one_before * {shards} div _one_all")
    else:
        shard = F.expr(f"(2 * size_before + size) * {shards} div (2 * size_all)")  # by the row's middle
    cut = curve.withColumn("shard", shard.cast("int"))
    firsts = cut.groupBy("shard").agg(F.min("_one_before").alias("_first"))  # as many rows as there are shards
    return cut.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_one_before") - F.col("_first")).select("doc_id", "size", "text_crc32", "shard", "slot", *own)


def write_shards(docs: DataFrame, path: str, dimensions: tuple[str, ...] = ("source", "lang", "n_chars"), shards: int = 16, law: str = "rows", rows_a_file: int = 1_000_000, **options) -> None:
    """The rows of docs as Parquet, a folder `shard=N` each, along the curve, so that files' column statistics cover few values of each dimension.

    Spark reads the ordered table's files back by size, so rows are dealt out in ranges once more: tasks, and with them the names of a
    shard's files, follow the curve. Files hold rows_a_file rows at most. Columns of docs named like a result are replaced.
    """
    own = without(docs, [c for c in RESULTS if c != "doc_id"])
    ordered = order_by_curve(own, dimensions, shards, law, carry=tuple(own.columns), **options)
    ranged = ordered.repartitionByRange(shuffle_width(docs.sparkSession), "shard", "slot")
    ranged.sortWithinPartitions("shard", "slot").write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(path)


def zone_map(docs: DataFrame, dimensions: tuple[str, ...], by: str = "shard") -> DataFrame:
    """by, n_rows, and the least and greatest value of each dimension: what a reader of the files can skip by."""
    return docs.groupBy(by).agg(F.count("*").alias("n_rows"), *[f(d).alias(f"{k}_{d}") for d in dimensions for k, f in (("min", F.min), ("max", F.max))])
