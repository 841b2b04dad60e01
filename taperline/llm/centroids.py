"""Lloyd's rounds over whole-number vectors, with the nearest centroid found by a tournament of bisectors.

The plane half-way between two centroids has a whole-number normal and threshold, worked out once a round. A vector meets the centroids in order:
k - 1 sign tests of linear forms each eliminate one of two, a zero favours the smaller number, and only the winner's distance is worked out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

#: Components up to this size keep every product and sum of the tournament within 64 bits (for up to 2 ** 20 components).
SMALL = 1 << 18
#: Vectors in one matrix.
ROWS = 2048


def _quantised(dims: int, scale: int):
    """Batches of (vec_id, v) to (vec_id, q), q the components floor(scale * x) as bytes: 64-bit little-endian, or decimal text where one is not SMALL.

    Vectors of another length, or with a null or non-finite component, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                lists = part.column(1)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                right = np.flatnonzero(sizes == dims)  # a null list has no length
                flat = lists.take(pa.array(right)).flatten()
                x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # nulls: not a number
                fine = np.isfinite(x).all(axis=1)
                x, right = x[fine], right[fine]
                ids.append(part.column(0).take(pa.array(right)))
                small = (np.abs(x) < SMALL / scale).all(axis=1)
                whole = np.floor(x[small] * scale).astype("<i8")
                raws = iter([r.tobytes() for r in whole])
                # beyond that, Python's whole numbers
                large = iter([",".join(str(int(c) * scale if abs(c) >= 2**53 else int(np.floor(c * scale))) for c in r.tolist()).encode() for r in x[~small]])
                out += [b"\0" + next(raws) if s else b"\1" + next(large) for s in small]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids) if ids else batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "q"])

    return run


def read_vector(q: bytes) -> list[int]:
    return np.frombuffer(q, "<i8", offset=1).tolist() if q[0] == 0 else [int(c) for c in q[1:].decode().split(",")]


def limbs(s: int) -> list[int]:
    """The 32-bit digits of a whole number, least first; the last one carries the sign."""
    out = []
    while not -(1 << 31) <= s < 1 << 31:
        s, low = s >> 32, s & 0xFFFFFFFF
        out.append(low)
    return [*out, s]


class Bisectors:
    """The planes between centroids: x lies nearer to i < j, or as near, where x . normal[i][j] <= threshold[i][j]."""

    def __init__(self, centroids: list[list[int]]) -> None:
        self.exact = np.array(centroids, dtype=object).reshape(len(centroids), -1)
        square = (self.exact * self.exact).sum(axis=1)
        self.normal = 2 * (self.exact[None, :] - self.exact[:, None])
        self.threshold = square[None, :] - square[:, None]
        self.small = len(centroids) == 0 or int(np.abs(self.exact).max()) <= SMALL
        if self.small:
            self.planes, self.bounds, self.points = self.normal.astype(np.int64), self.threshold.astype(np.int64), self.exact.astype(np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each row and the squared distance; rows of Python numbers are as exact as 64-bit ones."""
        fast = self.small and x.dtype == np.int64
        planes, bounds, points = (self.planes, self.bounds, self.points) if fast else (self.normal, self.threshold, self.exact)
        best = np.zeros(len(x), np.int64)
        for j in range(1, len(self.exact)):
            best = np.where((x * planes[best, j]).sum(axis=1) > bounds[best, j], j, best)
        return best, ((x - points[best]) ** 2).sum(axis=1)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of a batch: 64-bit ones together, the others as Python numbers."""
    raws = column.to_pylist()
    plain = np.array([i for i, r in enumerate(raws) if r[0] == 0], np.int64)
    for lo in range(0, len(plain), ROWS):
        at = plain[lo : lo + ROWS]
        yield at, np.frombuffer(b"".join(raws[i][1:] for i in at), "<i8").astype(np.int64).reshape(len(at), -1)
    other = np.array([i for i, r in enumerate(raws) if r[0] == 1], np.int64)
    if len(other):
        yield other, np.array([read_vector(raws[i]) for i in other], dtype=object)


def _sums(bisectors: Bisectors):
    """Batches of (q) to each task's sums by centroid: cluster, n, and place, limb and part for each 32 bits of a component's sum, so that these add up as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(bisectors.exact)
        count, total = [0] * k, [0] * k
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                best, _d = bisectors.nearest(x)
                for j in np.unique(best):
                    count[j] += int((best == j).sum())
                    total[j] = total[j] + x[best == j].sum(axis=0).astype(object)
        rows = [(j, count[j], place, limb, part) for j in range(k) if count[j] for place, s in enumerate(total[j]) for limb, part in enumerate(limbs(s))]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, names=["cluster", "n", "place", "limb", "part"])

    return run


def _assigned(bisectors: Bisectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
            for at, x in _matrices(batch.column(1)):
                best, d = bisectors.nearest(x)
                cluster[at] = best
                for i, v in zip(at.tolist(), d.tolist()):
                    distance[i] = v if v < 1 << 63 else None
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def cluster_vectors(vectors: DataFrame, dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1, vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): a row for each kept row of ``vectors``.

    Kept are vectors of exactly ``dims`` components, none null or non-finite; a component x counts as floor(scale * x). The first centroids are the k
    vectors with the least sha256 of ``<seed>:<vec_id>`` in that order (ties, as of repeated rows: the lesser vector; rows without a vec_id are
    none of them; fewer rows: fewer centroids). Each round assigns all vectors to the nearest centroid, ties to the smaller number, and moves every
    centroid that has some to floor(sum / count); then they are assigned once more. All is exact, however large the components; a distance
    or sum that a long can't hold is null. Rows without a vec_id are clustered as any other; only if no row has one, there are no centroids and no rows.
    An empty table gives no rows; other columns are not read. What the driver holds are k centroids and, a round, k sums of each task, added up in Spark.
    """
    kind = dict(vectors.dtypes)["vec_id"]
    q = stored(vectors.select("vec_id", F.col(f"`{vector}`").cast("array<double>").alias("v")).where("v is not null").mapInArrow(_quantised(dims, scale), f"vec_id {kind}, q binary"), "quantised")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = q.where("vec_id is not null").select("q", name.alias("name")).orderBy("name", "q").limit(k).collect()
    centroids = [read_vector(bytes(r["q"])) for r in first]
    for _ in range(rounds if centroids else 0):
        parts = q.select("q").mapInArrow(_sums(Bisectors(centroids)), "cluster long, n long, place long, limb long, part long")
        total, count = {}, {}
        for j, place, limb, n, part in parts.groupBy("cluster", "place", "limb").agg(F.sum("n"), F.sum("part")).collect():  # k * dims rows, a few more for huge numbers
            total[j, place] = total.get((j, place), 0) + (part << (32 * limb))
            count[j] = max(count.get(j, 0), n)  # every task with vectors has the first limb
        for (j, place), s in total.items():
            centroids[j][place] = s // count[j]
    done = stored(q.mapInArrow(_assigned(Bisectors(centroids)), f"vec_id {kind}, cluster int, distance long") if centroids else q.where("false").selectExpr("vec_id", "0 as cluster", "0L as distance"), "assigned")
    by = done.groupBy("cluster").agg(F.expr("try_sum(distance)").alias("cluster_inertia"), F.count_if(F.col("distance").isNull()).alias("none")).collect()  # k rows
    fits = lambda n: n if n is not None and n < 1 << 63 else None
    each_ = {r["cluster"]: None if r["none"] else r["cluster_inertia"] for r in by}
    whole = None if any(v is None for v in each_.values()) else fits(sum(each_.values()))
    rows = [(j, each_.get(j), whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    known = done.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
