"""op13 against brute force: all distances in whole numbers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np

from taperline.llm import centroids, queries


def brute(rows, dims=64, k=16, rounds=3, scale=64, seed=1):
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    points = [v for _, v in sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(points))
    for _ in range(rounds):
        home = [near(v)[1] for _, v in kept]
        for j in range(len(points)):
            if mine := [v for (_, v), h in zip(kept, home) if h == j]:
                points[j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [near(v) for _, v in kept]
    by = {j: sum(d for d, h in last if h == j) for _, j in last}
    fit = lambda n: n if n < 1 << 63 else None
    return sorted((-1 if i is None else i, j, fit(d), fit(by[j]), fit(sum(by.values())), hashlib.sha256(",".join(map(str, points[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last))


def rows_of(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_query(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    assert rows_of(queries.op13_centroids(spark, data)) == brute(rows)


def test_odd_rows(spark):
    random.seed(1)
    rows = [(i if i % 9 else None, [random.choice([-1.5, 0.0, 0.25, 1.0, 1e-9, -1e-9]) for _ in range(3)]) for i in range(80)]
    rows += [(7, rows[7][1]), (8, None), (9, [1.0, None, 2.0]), (10, [float("nan")] * 3), (11, [float("inf"), 0.0, 0.0]), (12, [1.0]), (13, [])]
    frame = lambda r: spark.createDataFrame([(*x, 1, "y") for x in r], "vec_id long, embedding array<double>, cluster int, q string")
    for k in (1, 5, 200):
        assert rows_of(centroids.cluster_vectors(frame(rows), 3, k)) == brute(rows, 3, k)
    assert centroids.cluster_vectors(frame(rows).limit(0), 3, 5).collect() == []
    assert centroids.cluster_vectors(frame([(None, [1.0, 2.0, 3.0])]), 3, 5).collect() == []


def test_huge_components_stay_exact(spark):
    rows = [(i, [float(i), 0.5, -float(i)]) for i in range(30)] + [(100, [1e6, -1e6, 3.5]), (101, [1e300, 1.0, -1e200]), (102, [5000.3, 4097.0, 1e5])]
    assert rows_of(centroids.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3, 6)) == brute(rows, 3, 6)


def test_limbs():
    for n in (0, 1, -1, 1 << 31, -(1 << 31), (1 << 31) - 1, 3 << 90, -(5 << 100) - 7):
        parts = centroids.limbs(n)
        assert sum(x << (32 * i) for i, x in enumerate(parts)) == n and all(0 <= x < 1 << 32 for x in parts[:-1])


def test_a_zero_favours_the_smaller_number():
    nearest = centroids.Bisectors([[0, 0], [2, 0], [0, 0], [1, 1]]).nearest(np.array([[1, 0], [0, 0], [1, -5], [2, 0]]))
    assert nearest[0].tolist() == [0, 0, 0, 1] and nearest[1].tolist() == [1, 0, 26, 0]
