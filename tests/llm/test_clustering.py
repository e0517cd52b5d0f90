"""Clustering against plain rounds over all vectors and centroids."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from slotwise.llm import clustering, queries, sql
from slotwise.llm.clustering import BallTree
from tests.llm.test_queries import write

VECTORS = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])


def plain(rows, k=8, rounds=10, dims=64, scale=1024):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(float(x) * scale) for x in v]))
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(((digest(i), v) for i, v in kept))[:k]]

    def away(v, c):
        return sum((x - y) ** 2 for x, y in zip(v, c, strict=True))

    def assign():
        return [min(range(len(centroids)), key=lambda c: (away(v, centroids[c]), c)) for _, v in kept]

    for _ in range(rounds):
        where = assign()
        for c in set(where):
            mine = [v for (_, v), w in zip(kept, where, strict=True) if w == c]
            centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    where = assign()
    far = [away(v, centroids[c]) for (_, v), c in zip(kept, where, strict=True)]
    sums = Counter()
    for c, d in zip(where, far, strict=True):
        sums[c] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, sums[c], sum(far), name[c]) for (i, _), c, d in zip(kept, where, far, strict=True))


def grouped(n, dims, groups=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims)) * 3
    return (centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * 0.05).astype(np.float32)


def odd_rows():
    v = [x.tolist() for x in grouped(160, 64)]
    rows = list(enumerate(v)) + [(3, v[3]), (3, v[8]), (None, v[5]), (None, v[5])] + [(1000 + i, v[0]) for i in range(90)]
    odd = [None, [], v[0][:63], v[0] + [1.0], [None, *v[0][1:]], [float("nan"), *v[0][1:]], [float("inf"), *v[0][1:]], [0.0] * 64, [-0.0] * 64, [-1e-9] * 64, [2.5] * 64]
    return rows + [(500 + i, x) for i, x in enumerate(odd)]


def test_op13(spark, tmp_path):
    rows = odd_rows()
    write(tmp_path, "embeddings", [[i for i, _ in rows], [v for _, v in rows], [1] * len(rows)], VECTORS)
    got = Counter(tuple(r) for r in queries.QUERIES["op13_clusters"](spark, str(tmp_path)).collect())
    kept = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == plain(kept)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    named = c.execute(sql.ORACLE["op13_clusters"])
    at = [[d[0] for d in named.description].index(x) for x in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")]
    assert got == Counter(tuple(r[i] for i in at) for r in named.fetchall())


@pytest.mark.parametrize("tree", [1, 7, 4096])
def test_trees_of_any_size(spark, tree):
    rows = [(i, v.tolist()) for i, v in enumerate(grouped(300, 8, seed=4).astype(float))]
    for part in (rows, rows[:5], []):  # fewer vectors than centroids, and none
        df = spark.createDataFrame([(*r, 9) for r in part], "vec_id long, embedding array<double>, cluster int").repartition(3)
        assert Counter(tuple(r) for r in clustering.cluster_vectors(df, dimensions=8, rounds=4, tree=tree).collect()) == plain(part, rounds=4, dims=8)


def test_balls_are_assigned_whole_and_ties_are_not():
    v = np.floor(grouped(4000, 8, seed=1) * 1024).astype(np.int64)
    order, balls = BallTree.grown(v)
    assert sorted(order.tolist()) == list(range(4000)) and (balls.vectors == v[order]).all()
    again = BallTree.read(*balls.stored(), 8)
    computed = 0
    for rng in map(np.random.default_rng, range(8)):
        centroids = v[rng.choice(4000, 8)]
        want = ((v[order][:, None, :] - centroids[None]) ** 2).sum(axis=2)
        for t in (balls, again):
            cluster, counts, sums, exact = t.assign(centroids)
            assert (cluster == want.argmin(axis=1)).all() and (counts == np.bincount(cluster, minlength=8)).all()
            assert all((sums[c] == v[order][cluster == c].sum(axis=0)).all() for c in range(8))
        computed += exact
    assert computed < 8 * 4000 * 0.6  # the other vectors' balls were passed on whole
    middle = BallTree.grown(np.zeros((50, 2), np.int64))[1]  # all points as far from either centroid
    assert middle.assign(np.array([[1, 0], [-1, 0]]))[0].tolist() == [0] * 50
    assert middle.assign(np.array([[-1, 0], [-1, 0]]))[3] == 50


def test_large_integers():
    v = np.array([[clustering.LARGEST] * 64, [-clustering.LARGEST] * 64], dtype=np.int64)
    assert clustering.distances(v, v).tolist() == [[0, 64 * (2 * clustering.LARGEST) ** 2], [64 * (2 * clustering.LARGEST) ** 2, 0]]
