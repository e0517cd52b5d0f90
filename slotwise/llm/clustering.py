"""Centroid clustering (Lloyd's rounds) on exact integers, filtered by ball trees.

Each task builds metric trees over its own vectors, a bounded number a tree; a node keeps the centre, radius, count and integer sum of
its ball. In a round the centroids, which are few, go to all trees. If by the triangle inequality no
point of a ball can be nearer to another centroid, the ball's count and sum are added to its centroid at once; else its
halves are looked at, and at last the vectors of a leaf, by exact distances. What Spark gathers in a round is a count and a sum for each
tree and centroid, added up before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import materialize

#: Vectors of a tree and of a leaf, at most.
TREE, LEAF = 4096, 32
#: Components' greatest size: with it, squared distances in up to 2^10 dimensions fit a long.
LARGEST = 1 << 25


def levels(n: int, leaf: int = LEAF) -> list[np.ndarray]:
    """Edges of the balls of each level of a tree over n rows, from the whole to leaves of so many rows at most."""
    edges = [np.array([0, n])]
    while np.diff(edges[-1]).max() > leaf:
        e = edges[-1]
        edges.append(np.sort(np.concatenate([e, (e[:-1] + e[1:]) // 2])))
    return edges


def _centres(sums: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return sums / np.maximum(1, np.diff(edges))[:, None]


class BallTree:
    """A balanced tree over the rows of a matrix: level l cuts them into 2^l balls of neighbouring rows, each with its integer sum and radius."""

    def __init__(self, vectors: np.ndarray, sums: np.ndarray, radii: np.ndarray):
        self.vectors, self.levels, self.sums, self.radii, at = vectors, levels(len(vectors)), [], [], 0
        for edges in self.levels:
            self.sums.append(sums[at : at + len(edges) - 1])
            self.radii.append(radii[at : at + len(edges) - 1])
            at += len(edges) - 1
        self.centres = [_centres(s, e) for s, e in zip(self.sums, self.levels, strict=True)]

    @staticmethod
    def grown(vectors: np.ndarray) -> tuple[np.ndarray, BallTree]:
        """(order, tree over vectors[order]): each ball is halved at the median of its widest component."""
        order = np.arange(len(vectors))
        cuts = levels(len(vectors))
        for upper, lower in zip(cuts, cuts[1:]):
            for a, b, middle in zip(upper, upper[1:], lower[1::2]):
                if a < middle < b:
                    part = vectors[order[a:b]]
                    widest = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                    order[a:b] = order[a:b][np.argpartition(part[:, widest], middle - a)]
        own = vectors[order]
        running = np.concatenate([np.zeros((1, vectors.shape[1]), np.int64), np.cumsum(own, axis=0)])
        sums, radii = [], []
        for edges in cuts:
            sums.append(running[edges[1:]] - running[edges[:-1]])
            far = np.sqrt(((own - np.repeat(_centres(sums[-1], edges), np.diff(edges), axis=0)) ** 2).sum(axis=1))
            radii += [far[a:b].max(initial=0.0) for a, b in zip(edges, edges[1:])]
        return order, BallTree(own, np.concatenate(sums), np.array(radii))

    def stored(self) -> tuple[bytes, bytes, bytes]:
        return self.vectors.astype(np.int32).tobytes(), np.concatenate(self.sums).tobytes(), np.concatenate(self.radii).tobytes()

    @staticmethod
    def read(vectors: bytes, sums: bytes, radii: bytes, dimensions: int) -> BallTree:
        return BallTree(np.frombuffer(vectors, np.int32).reshape(-1, dimensions).astype(np.int64), np.frombuffer(sums, np.int64).reshape(-1, dimensions), np.frombuffer(radii))

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(cluster of each row of `vectors`, counts and sums of the clusters, vectors whose distances were computed).

        Ties go to the smaller number; a ball on which a tie is possible is not assigned as a whole.
        """
        k = len(centroids)
        cluster = np.full(len(self.vectors), -1)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, self.vectors.shape[1]), np.int64)
        open_ = np.array([0])
        for level, edges in enumerate(self.levels):
            open_ = open_[edges[open_ + 1] > edges[open_]]
            if not len(open_):
                return cluster, counts, sums, 0
            away = np.sqrt(((self.centres[level][open_, None, :] - centroids[None, :, :]) ** 2).sum(axis=2))
            best = away.argmin(axis=1)
            least = away[np.arange(len(open_)), best]
            away[np.arange(len(open_)), best] = np.inf
            # A thousandth more than the radius takes covers all errors of rounding: components are whole numbers up to LARGEST.
            whole = least + 2 * self.radii[level][open_] * (1 + 1e-9) + 1e-3 < away.min(axis=1)
            for ball, to in zip(open_[whole].tolist(), best[whole].tolist(), strict=True):
                cluster[edges[ball] : edges[ball + 1]] = to
            np.add.at(counts, best[whole], np.diff(edges)[open_[whole]])
            np.add.at(sums, best[whole], self.sums[level][open_[whole]])
            open_ = (2 * open_[~whole][:, None] + np.array([0, 1])).ravel()
        left = np.flatnonzero(cluster < 0)
        for i in range(0, len(left), 1024):
            rows = left[i : i + 1024]
            cluster[rows] = distances(self.vectors[rows], centroids).argmin(axis=1)
        np.add.at(counts, cluster[left], 1)
        np.add.at(sums, cluster[left], self.vectors[left])
        return cluster, counts, sums, len(left)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of integer vectors, exact."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) ** 2 * vectors.shape[1] < 1 << 50:
        x, c = vectors.astype(np.float64), centroids.astype(np.float64)  # sums below 2^53, so float products are exact
        return ((x**2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c**2).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", tree: int = TREE) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 for each kept vector.

    Kept are vectors of so many components, none null or non-finite; a component x becomes the integer floor(scale * x). The
    first centroids are the k kept vectors with the smallest lowercase-hex sha256 of `seed:id` (null id: of `seed:`), of equal
    ids the smallest vectors; fewer than k vectors make fewer centroids. Each round assigns every vector to its nearest centroid, ties to
    the smaller number, and moves each centroid with vectors to the floor of their mean, component by component. Then vectors are assigned
    once more. Equal rows are vectors of their own. No vectors, no rows. Other columns are ignored. An integer beyond LARGEST is an
    error, since no long could hold its distances.
    """
    spark = vectors.sparkSession
    good = f"size({vector_col}) = {dimensions} and forall({vector_col}, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity'))"
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    small = F.forall(whole, lambda x: F.abs(x) <= LARGEST)
    checked = F.when(small, whole).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} / {scale}")))
    points = vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), checked.alias("v"))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []

        def grown() -> Iterator[pa.RecordBatch]:
            while sum(map(len, parts)) >= tree or (ended and parts and sum(map(len, parts))):
                m, names = np.concatenate(parts), [i for p in ids for i in p]
                order, balls = BallTree.grown(m[:tree])
                columns = [pa.array([[names[i] for i in order]], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in balls.stored())]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "vectors", "sums", "radii"])
                ids[:], parts[:] = [names[tree:]], [m[tree:]]

        ended = False
        for batch in batches:
            column = batch.column("v")
            ids.append(batch.column("vec_id").to_pylist())
            parts.append(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimensions))
            yield from grown()
        ended = True
        yield from grown()

    trees = materialize(points.mapInArrow(plant, "ids array<long>, vectors binary, sums binary, radii binary"), "trees")
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    firsts = points.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    if not firsts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.v for r in firsts], dtype=np.int64)

    def read(batch: pa.RecordBatch) -> Iterator[BallTree]:
        for row in zip(*(batch.column(c) for c in ("vectors", "sums", "radii")), strict=True):
            yield BallTree.read(*(x.as_py() for x in row), dimensions)

    def gather(now: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, sums = np.zeros(len(now), np.int64), np.zeros((len(now), dimensions), np.int64)
            for batch in batches:
                for balls in read(batch):
                    _, c, s, _ = balls.assign(now)
                    counts, sums = counts + c, sums + s
            yield pa.RecordBatch.from_arrays([pa.array(range(len(now)), pa.int32()), pa.array(counts), pa.array(sums.tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

        return run

    for _ in range(rounds):
        found = trees.drop("ids").mapInArrow(gather(centroids), "cluster int, n long, s array<long>")
        exact = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dimensions)]
        moved = centroids.copy()
        for r in found.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():  # k rows
            if r.n:
                moved[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dimensions)]
        if (moved == centroids).all():
            break  # every later round would do the same
        centroids = moved

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, balls in zip(batch.column("ids"), read(batch), strict=True):
                cluster, *_ = balls.assign(centroids)
                away = ((balls.vectors - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster.astype(np.int32)), pa.array(away)], names=["vec_id", "cluster", "distance"])

    assigned = materialize(trees.mapInArrow(last, "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r.cluster: r.d for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    told = [(c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
