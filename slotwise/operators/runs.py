"""Sequential runs over one shared table: a task a run, which reads its copy in order, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Requests that a block holds at most; places of its names are two bytes, so 65,536 is the limit.
BLOCK = 16_384
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def consecutive(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Each value of an integer column that the batches are in order of, and the pieces of batches with it, one after the other."""

    def pieces() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            values = batch.column(column).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
            for low, high in zip(edges, edges[1:], strict=False):
                if high > low:
                    yield int(values[low]), batch.slice(low, high - low)

    for value, mine in groupby(pieces(), key=lambda x: x[0]):
        yield value, (piece for _, piece in mine)


def run_by_run(rows: DataFrame, n: int, order: list[str], play: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What play(run, batches) yields for each run 0..n-1: batches of rows in that order, of which it has one at a time. Rows are sorted by Spark, on disk if need be."""
    copies = rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, mine in consecutive(batches, "run"):
            yield from play(run, mine)

    return copies.repartitionById(n, F.col("run")).sortWithinPartitions("run", *order).mapInArrow(each, schema)


def blocks(requests: DataFrame, by: list[str], columns: dict[str, str], size: int = BLOCK) -> DataFrame:
    """by, block, names, codes and columns: up to `size` requests (by, seq, object_id, columns) that follow each other in a row, in order of seq.

    names: the block's objects; codes: each request's place in names; columns: numpy types, by name, of values that go with the requests. Codes
    and values are arrays' bytes. A copy for a run is then some bytes a request, and a sort of few rows.
    """
    cells = [*by, "block"]

    def coded(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        codes, names = pd.factorize(frame.object_id.to_numpy(dtype=object), use_na_sentinel=False)
        row = [*key, list(names), codes.astype(np.uint16).tobytes(), *[frame[c].to_numpy(dtype=kind).tobytes() for c, kind in columns.items()]]
        return pd.DataFrame([row], columns=[*cells, "names", "codes", *columns])

    placed = requests.select(*by, F.floor(F.col("seq") / size).alias("block"), "seq", "object_id", *columns)
    schema = ", ".join([*[f"{c} {placed.schema[c].dataType.simpleString()}" for c in cells], "names array<string>", "codes binary", *[f"{c} binary" for c in columns]])
    return placed.groupBy(*cells).applyInPandas(coded, schema)


def requests_of(batch: pa.RecordBatch, columns: dict[str, str]) -> Iterator[tuple[list, list[list]]]:
    """Block by block the requests' objects, and the columns' values."""
    for i in range(batch.num_rows):
        names = batch.column("names")[i].as_py()
        codes = np.frombuffer(batch.column("codes")[i].as_buffer(), dtype=np.uint16).tolist()
        yield [names[c] for c in codes], [np.frombuffer(batch.column(c)[i].as_buffer(), dtype=kind).tolist() for c, kind in columns.items()]
