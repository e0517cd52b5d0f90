"""Nearest neighbours by shifted space-filling curves, with an exact check.

Each of several curves projects the vectors to a few dimensions in its own random directions, shifts them
and numbers them in Hilbert order; Spark range-partitions by that number. Windows of neighbouring ranks, each
overlapping the next by half, are reranked on the full vectors, and a query's results of all curves merge.

The exact check then adds what the windows missed. A query's worst result is a floor. The first curve is cut into
blocks with a centre and a radius; a block is passed over for a query whose floor nothing in it can reach, before any vector
travels, and of the other blocks only vectors that reach the floor are added. Without the check (complete=False)
the windows' results are final.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.llm.common import materialize, shuffle_width

DIMENSIONS, BITS = 8, 7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with integer coordinates below 2^bits; one row a point.

    Skilling's transform: undo the excess work of Gray code and rotations bit by bit, then interleave.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray, curve: int, radius: float) -> np.ndarray:
    """Hilbert keys of one curve: orthonormal random directions and a random shift, both seeded by its number."""
    rng = np.random.default_rng(1000 + curve)
    d = vectors.shape[1]
    k = min(DIMENSIONS, d)
    axes, _ = np.linalg.qr(rng.standard_normal((d, k)))
    spread = 3 * radius / math.sqrt(d)  # three deviations of a vector without direction
    unit = np.clip((vectors @ axes / spread + 1) / 2, 0, 1) * 0.75 + rng.uniform(0, 0.25, k)
    return hilbert_keys(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    arrays = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d) for a in arrays if len(a)]
    return np.concatenate(parts) if parts else np.zeros((0, d))


def _slack(queries: np.ndarray, radius: float) -> np.ndarray:
    """More than the error of a product of each query with vectors of norms up to radius, in float64."""
    return 1e-15 * (queries.shape[1] + 8) * np.sqrt((queries**2).sum(axis=1)) * radius


def _best(queries: np.ndarray, vectors: np.ndarray, floors: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query row, vector row, score) of each query's k best scores at or over its floor, with ties at the kth; scores exactly rounded."""
    rows, cols, scores = [], [], []
    slack = _slack(queries, np.sqrt((vectors**2).sum(axis=1).max()))
    for i in range(0, len(queries), 512):
        s = queries[i : i + 512] @ vectors.T
        cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -np.inf)
        a, b = np.nonzero(s >= (np.maximum(cut, floors[i : i + 512]) - 2 * slack[i : i + 512])[:, None])
        rows += (a + i).tolist()
        cols += b.tolist()
        scores += [math.fsum(x) for x in (queries[a + i] * vectors[b]).tolist()]
    return rows, cols, scores


_FOUND = "query_id long, class_id long, score double"


def _table(q: list, c: list, s: list) -> pa.Table:
    return pa.table({"query_id": pa.array(q, pa.int64()), "class_id": pa.array(c, pa.int64()), "score": pa.array(s, pa.float64())})


def nearest(vectors: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20, curves: int = 4, window: int = 1024, block: int = 4096, complete: bool = True, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product for each row that meets the condition `queries`.

    Vectors that are null, zero, or hold null or non-finite components take no part, neither do rows of null id, nor
    vectors of another length than most, with which there is no inner product. Equal vectors form a class, stand on
    the curves once and are named by their k + 1 smallest ids, which no result can need more of; so a vector with very
    many copies is one point. Ties go to the smaller id. Fewer candidates than k: all. No vectors: no rows. Other
    columns are ignored, whatever their names. window: ranks of a curve that are reranked together, twice;
    block: rows a task scores at a time; complete: whether the exact check follows.
    """
    valid = f"{id_col} is not null and {vector_col} is not null and forall({vector_col}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({vector_col}, x -> x <> 0)"
    good = vectors.where(valid).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    kind = good.schema["v"].dataType.elementType.simpleString()
    if kind not in ("float", "double"):
        kind = "double"
        good = good.withColumn("v", F.col("v").cast("array<double>"))
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return good.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = sizes[0].d
    good = good.where(F.size("v") == d)
    few = good.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(f"n <= {k + 1}")
    classes = materialize(few.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("class_id"), "ids", "v"), "ann-classes")
    asked = materialize(good.where(queries.replace(id_col, "vec_id")).select(F.col("vec_id").alias("query_id"), "v"), "ann-queries")
    stats = classes.agg(F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))).alias("radius")).first()
    radius = stats.radius

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("v"), d)
            for c in range(curves):
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(m), pa.int32()), pa.array(curve_keys(m, c, radius)), *batch.columns], names=["curve", "key", *batch.schema.names])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, curve = TaskContext.get().partitionId(), {}, None
        for batch in batches:
            ranks = []
            for curve in batch.column("curve").to_pylist():
                ranks.append(at.get(curve, 0))
                at[curve] = ranks[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(ranks), pa.int32()), pa.array(ranks, pa.int64())], names=[*batch.schema.names, "part", "local"])

    # Queries and classes stand on the curves together, so a query has a rank among the classes.
    points = classes.select("class_id", F.lit(None).cast("long").alias("query_id"), "v").unionByName(asked.select(F.lit(None).cast("long").alias("class_id"), "query_id", "v"))
    placed = points.mapInArrow(place, f"curve int, key long, class_id long, query_id long, v array<{kind}>")
    ordered = placed.repartitionByRange(shuffle_width(good.sparkSession), "curve", "key", "class_id", "query_id").sortWithinPartitions("curve", "key", "class_id", "query_id")
    local = materialize(ordered.mapInArrow(number, f"curve int, key long, class_id long, query_id long, v array<{kind}>, part int, local long"), "ann-curves")
    totals = local.groupBy("curve", "part").agg(F.count("*").alias("n"))  # at most curves rows for each of the writer's tasks
    before = totals.select("curve", "part", (F.sum("n").over(Window.partitionBy("curve").orderBy("part")) - F.col("n")).alias("before"))
    ranked = local.join(F.broadcast(before), ["curve", "part"]).withColumn("rank", F.col("local") + F.col("before"))

    # A window is a stretch of 2 * window ranks that starts at a multiple of window; a query goes to where it is in the middle.
    w = (F.col("rank") / window).cast("long")
    for_class = F.array(w - 1, w)
    for_query = F.array(F.when(F.col("rank") % window < window // 2, w - 1).otherwise(w))
    windows = ranked.withColumn("w", F.explode(F.when(F.col("class_id").isNotNull(), for_class).otherwise(for_query)))

    def rerank(table: pa.Table) -> pa.Table:
        is_query = np.array(table.column("query_id").is_valid())
        if not is_query.any() or is_query.all():
            return _table([], [], [])
        m = _matrix(table.column("v"), d)
        ids, names = table.column("query_id").filter(pa.array(is_query)).to_pylist(), table.column("class_id").filter(pa.array(~is_query)).to_pylist()
        a, b, s = _best(m[is_query], m[~is_query], np.full(len(ids), -np.inf), k + 1)
        return _table([ids[i] for i in a], [names[i] for i in b], s)

    found = windows.select("curve", "w", "query_id", "class_id", "v").groupBy("curve", "w").applyInArrow(rerank, _FOUND).distinct()
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "class_id")
    # Own class and k others: k + 1 classes name k candidates at least.
    best = materialize(found.withColumn("n", F.row_number().over(by_score)).where(f"n <= {k + 1}"), "ann-found")
    if complete:
        missed = _check(ranked.where("curve = 0"), best.where(f"n = {k + 1}").select("query_id", F.col("score").alias("floor")), d, k, block, kind)
        both = best.select("query_id", "class_id", "score").unionByName(missed).distinct()
        best = both.withColumn("n", F.row_number().over(by_score)).where(f"n <= {k + 1}")
    named = best.join(classes.select("class_id", "ids"), "class_id").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return named.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


#: Blocks whose centres one task compares with a group of queries.
CHUNK = 1024


def _check(curve: DataFrame, floors: DataFrame, d: int, k: int, block: int, kind: str) -> DataFrame:
    """query_id, class_id, score: the classes that reach their query's floor, all where it has none; but no more than k + 1 of a block.

    curve: class_id or query_id, v, rank. First the queries meet the blocks' centres, a group of neighbouring queries and CHUNK
    blocks at a time. Only the pairs of query and block that are left send vectors.
    """
    grp = F.floor(F.col("rank") / (16 * block)).cast("int").alias("grp")
    held = curve.where("class_id is not null").select(F.floor(F.col("rank") / block).alias("block"), "class_id", "v")
    own = curve.where("query_id is not null").join(floors, "query_id", "left").select("query_id", "floor", "v", grp)
    own = materialize(own, "ann-floors")

    def centre(key, table):
        m = _matrix(table.column("v"), d)
        middle = m.mean(axis=0)
        reach = np.sqrt(((m - middle) ** 2).sum(axis=1).max())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "v": pa.array([middle.tolist()], pa.list_(pa.float64())), "reach": pa.array([float(reach)])})

    centres = materialize(held.groupBy("block").applyInArrow(centre, "block long, v array<double>, reach double"), "ann-centres")
    last = centres.agg(F.max(F.floor(F.col("block") / CHUNK)).alias("n")).first().n
    groups = own.agg(F.max("grp").alias("n")).first().n
    empty = {c: F.lit(None).cast(t).alias(c) for c, t in (("query_id", "long"), ("floor", "double"), ("block", "long"), ("reach", "double"))}
    asked = own.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last or 0).cast("long"))).alias("chunk"), "grp", "query_id", "floor", empty["block"], empty["reach"], F.col("v").cast("array<double>").alias("v"))
    # A row for each chunk's centre and each group of 16 blocks' queries.
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups or 0))).alias("grp")
    there = centres.select(F.floor(F.col("block") / CHUNK).alias("chunk"), every_group, empty["query_id"], empty["floor"], "block", "reach", "v")

    def prune(key, table):
        is_query = np.array(table.column("query_id").is_valid())
        at, of = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        m = _matrix(table.column("v"), d)
        q, c = m[at], m[of]
        reach = table.column("reach").to_numpy()[of]
        floor = np.nan_to_num(table.column("floor").to_numpy().astype(float)[at], nan=-np.inf)
        norms, rows, blocks = np.sqrt((q**2).sum(axis=1)), [], []
        far = np.sqrt((c**2).sum(axis=1).max()) + reach.max() if len(of) else 0.0
        for i in range(0, len(at), 512):
            near = q[i : i + 512] @ c.T + reach[None, :] * norms[i : i + 512, None] >= (floor[i : i + 512] - 4 * _slack(q[i : i + 512], far))[:, None]
            a, b = np.nonzero(near)
            rows.append(at[a + i])
            blocks.append(of[b])
        rows, blocks = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, blocks))
        left = table.take(pa.array(rows))
        return pa.table({"block": table.column("block").take(pa.array(blocks)), "grp": left.column("grp"), "query_id": left.column("query_id"), "floor": left.column("floor"), "v": left.column("v")})

    columns = ("chunk", "grp", "query_id", "floor", "block", "reach", "v")
    left = asked.select(*columns).unionByName(there.select(*columns)).groupBy("chunk", "grp").applyInArrow(prune, "block long, grp int, query_id long, floor double, v array<double>")
    left = materialize(left.select("block", "grp", "query_id", "floor", F.col("v").cast(f"array<{kind}>").alias("v")), "ann-left")
    sent = held.join(left.select("block", "grp").distinct(), "block").select("block", "grp", F.lit(None).cast("long").alias("query_id"), "class_id", F.lit(None).cast("double").alias("floor"), "v")

    def add(table: pa.Table) -> pa.Table:
        is_query = np.array(table.column("query_id").is_valid())
        m = _matrix(table.column("v"), d)
        ids, names = table.column("query_id").filter(pa.array(is_query)).to_pylist(), table.column("class_id").filter(pa.array(~is_query)).to_pylist()
        floor = np.nan_to_num(table.column("floor").to_numpy().astype(float)[is_query], nan=-np.inf)
        a, b, s = _best(m[is_query], m[~is_query], floor, k + 1)
        return _table([ids[i] for i in a], [names[i] for i in b], s)

    return sent.unionByName(left.select("block", "grp", "query_id", F.lit(None).cast("long").alias("class_id"), "floor", "v")).groupBy("block", "grp").applyInArrow(add, _FOUND)
