import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codefacts.llm import orchard, queries

VECTORS = "vec_id bigint, embedding array<double>, label int, cluster string, units int, distance double"


def plain(rows, k=8, rounds=10, size=64):
    """Round by round with Python's integers, every centroid measured."""
    kept = [
        (i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    seeds = sorted(kept, key=lambda r: (r[0] is None, name(r[0]) if r[0] is not None else "", r[1]))
    centroids = [v for _, v in seeds[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, c, d in out if c == j) for j in range(k)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in out]


def cases(n=300):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 64))
    rows = [(i * 7, (base[i % 6] + rng.normal(size=64) * rng.choice([0.05, 0.5])).tolist()) for i in range(n)]
    rows += [(rows[3][0], rows[3][1])] * 3 + [(rows[4][0], rows[9][1]), (None, rows[5][1]), (None, rows[6][1]), (-5, [0.0] * 64), (-6, [-0.0] * 64)]
    rows += [(-7, None), (-8, []), (-9, [1.0] * 63), (-10, [1.0] * 65), (-11, [float("nan")] * 64), (-12, [None] + [0.5] * 63), (-13, [float("-inf")] + [0.5] * 63)]
    rows += [(-20 - i, [x / 1024 for x in [i % 3] * 64]) for i in range(9)]
    return [(*r, None, "x", None, 1.5) for r in rows]


def test_query_equals_brute_force(spark, tmp_path):
    rows = cases()
    spark.createDataFrame(rows, VECTORS).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op12_orchard_clusters(spark, str(tmp_path))
    assert found.dtypes == [
        ("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")
    ]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, n):
    rows = cases(20)[:n]
    found = orchard.cluster(spark.createDataFrame(rows, VECTORS))
    assert sorted(map(tuple, found.vectors.collect())) == sorted(r[:3] for r in plain(rows))
    assert found.inertia == 0 and len(found.centroids) == n


def test_search_finds_the_nearest_with_ties_and_equal_centroids():
    rng = np.random.default_rng(2)
    for k in (1, 2, 7, 40):
        centroids = rng.integers(-3, 4, (k, 3))
        centroids[k // 2] = centroids[0]
        units = rng.integers(-5, 6, (400, 3))
        gaps, lists = orchard.neighbour_lists(centroids)
        every = ((units[:, None] - centroids[None]) ** 2).sum(2)
        for start in (np.zeros(400, int), rng.integers(0, k, 400)):
            now, best = orchard.search(units, centroids, gaps, lists, start)
            assert (now == every.argmin(1)).all() and (best == every.min(1)).all()


def test_walks_measure_fewer_than_all(monkeypatch):
    rng = np.random.default_rng(3)
    centroids = rng.integers(-4000, 4000, (64, 8))
    units = centroids[rng.integers(0, 64, 500)] + rng.integers(-40, 40, (500, 8))
    gaps, lists = orchard.neighbour_lists(centroids)
    near = ((units[:, None] - centroids[None]) ** 2).sum(2).argmin(1)
    steps = 0

    class Counted(np.ndarray):
        def __getitem__(self, at):
            nonlocal steps
            if isinstance(at, tuple):
                steps += len(at[0])
            return np.asarray(self)[at]

    now, _ = orchard.search(units, centroids, gaps, lists.view(Counted), near)
    assert (now == near).all() and steps <= 2 * len(units)


def test_bad_parameters_and_too_large_components(spark):
    vectors = spark.createDataFrame([(1, [1e6] * 64, 0, "", 0, 0.0)], VECTORS)
    with pytest.raises(Exception, match="too large for exact distances"):
        orchard.cluster(vectors)
    with pytest.raises(ValueError, match="positive"):
        orchard.cluster(vectors, k=0)
    with pytest.raises(ValueError, match="missing columns"):
        orchard.cluster(vectors.drop("embedding"))
    assert orchard.cluster(vectors.filter(F.lit(False))).vectors.count() == 0
