"""Centroid clustering with Orchard's search for the nearest centroid.

Every centroid keeps the other centroids sorted by their distance to it.  The
search for a vector stands at a centroid c and walks along its list.  It stops at
the first c' with d(c, c') > 2 d(v, c): by the triangle inequality that centroid
and all behind it are farther from v than c.  A centroid that turns out closer (or
as close with a smaller number) takes the place of c, and the walk begins anew on
its list; centroids once measured are marked and passed over.  All vectors of a
slice take their steps together.

Vectors are whole numbers and all comparisons are of squared distances, so results
are exact.  Each round is one scan of the stored vectors; a task sends one sum and
count per centroid.  Only centroids pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import vectors as V
from tidemark.session import materialize


class Neighbours:
    """Centroids and, for each, the numbers of and squared distances to the others, nearest first."""

    def __init__(self, centroids: np.ndarray):
        k = len(centroids)
        self.centroids = centroids
        wide = centroids if _fits(centroids) else centroids.astype(object)
        gaps = np.array([((wide - c) ** 2).sum(1) for c in wide], wide.dtype).reshape(k, k)
        others = [[j for j in sorted(range(k), key=lambda j: (gaps[i, j], j)) if j != i] for i in range(k)]  # noqa: B023
        self.order = np.array(others, np.int64).reshape(k, max(k - 1, 0))
        self.gaps = np.take_along_axis(gaps, self.order, 1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid; ``start`` is where each walk begins."""
        exact = np.int64 if _fits(x, self.centroids) else object
        x, centroids, gaps = x.astype(exact), self.centroids.astype(exact), self.gaps.astype(exact)
        here = start.astype(np.int64)
        best = ((x - centroids[here]) ** 2).sum(1)
        seen = np.zeros((len(x), len(centroids)), bool)
        seen[np.arange(len(x)), here] = True
        step, walking = np.zeros(len(x), np.int64), np.arange(len(x))
        while walking.size:
            walking = walking[step[walking] < self.order.shape[1]]
            walking = walking[(gaps[here[walking], step[walking]] <= 4 * best[walking]).astype(bool)]
            other = self.order[here[walking], step[walking]]
            step[walking] += 1
            new = ~seen[walking, other]
            at, other = walking[new], other[new]
            seen[at, other] = True
            d = ((x[at] - centroids[other]) ** 2).sum(1)
            closer = ((d < best[at]) | ((d == best[at]) & (other < here[at]))).astype(bool)
            at = at[closer]
            here[at], best[at], step[at] = other[closer], d[closer], 0
        return here, best


def _fits(*values: np.ndarray) -> bool:
    """Do four times the squared distances of such vectors fit 64 bits?"""
    return 4 * (2 * V.greatest(*values)) ** 2 * max((v.shape[1] for v in values), default=1) < 2**63


def _start(rows: DataFrame, key: str, k: int) -> np.ndarray:
    """The k vectors with the smallest hash of their id, in that order: rows without an id last, equal ones by vector."""
    named = rows.select(F.sha2(F.concat(F.lit("1:"), F.col(key).cast("string")).cast("binary"), 256).alias("name"), "x")
    first = named.orderBy(F.col("name").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in first], np.int64)


def _moved(totals: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids moved to the floored mean of their vectors; those without any stay."""
    out = centroids.tolist()
    for r in totals.groupBy("part", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("dim >= 0").collect():  # one row per centroid and component
        out[r["part"]][r["dim"]] = int(r["s"]) // int(r["n"])
    return np.array(out, np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, factor: float = 64.0, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(``key``, cluster, distance) of every vector after ``rounds`` rounds, and the centroids.

    Vectors count as floor(factor * x).  Those that are null, of another size than
    ``size``, or hold a null or non-finite component are left out; ids may be null
    or repeat, every row is assigned.  Equal distances go to the smaller number.
    Fewer vectors than ``k`` give as many centroids, an empty table none and no
    row.  Components beyond 62 bits, and distances beyond 64, are an error."""
    ids = vectors.schema[key]
    rows = vectors.select(F.col(key), F.col(vector)).mapInArrow(_whole(key, vector, size, factor), T.StructType([ids, T.StructField("x", T.ArrayType(T.LongType()))]))
    centroids = _start(rows, key, k)
    if not len(centroids):
        return rows.select(key, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    # every later walk begins where the first one ended
    stored = materialize(rows.mapInArrow(_walk(centroids, None, ["x"], key), T.StructType([ids, T.StructField("cluster", T.IntegerType()), T.StructField("x", T.ArrayType(T.LongType()))])), "vectors")
    for i in range(rounds):
        centroids = _moved(stored.select("cluster", "x").mapInArrow(_sum(centroids if i else None), V.TOTALS), centroids)
    found = T.StructType([ids, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return materialize(stored.mapInArrow(_walk(centroids, "cluster", ["distance"], key), found), "clusters"), centroids


def _whole(key: str, vector: str, size: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = V.whole_rows(batch, vector, factor, size=size)
            yield pa.RecordBatch.from_arrays([kept.column(0), x], [key, "x"])

    return run


def _searched(batch: pa.RecordBatch, to: Neighbours, start: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    begin = np.zeros(batch.num_rows, np.int64) if start is None else batch.column(start).to_numpy()
    for _, at, x in V.matrices(batch.column("x")):
        yield at, x, *to.nearest(x, begin[at])


def _walk(centroids: np.ndarray, start: str | None, more: list[str], key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Neighbours(centroids)
        for batch in batches:
            number, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for at, _, here, best in _searched(batch, to, start):
                if best.size and int(best.max()) >= 2**63:
                    raise OverflowError("a squared distance does not fit 64 bits")
                number[at], distance[at] = here, best.astype(np.int64)
            held = {"x": batch.column("x"), "distance": pa.array(distance)}
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number), *(held[c] for c in more)], [key, "cluster", *more])

    return run


def _sum(centroids: np.ndarray | None):
    """Totals by the stored cluster or, with ``centroids``, by a search that begins there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, to = V.Totals(), None if centroids is None else Neighbours(centroids)
        for batch in batches:
            stored = batch.column("cluster").to_numpy()
            parts = _searched(batch, to, "cluster") if to else ((at, x, stored[at], None) for _, at, x in V.matrices(batch.column("x")))
            for _, x, here, _ in parts:
                for c in np.unique(here).tolist():
                    totals.add(c, x[here == c])
        yield from totals.batches()

    return run


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia (distances summed over the cluster, over
    all) and centroid_sha256.  At most one row per centroid is collected and broadcast."""
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(c, s, sum(sums.values()), names[c]) for c, s in sums.items()]
    per = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(per), "cluster").select(*assigned.columns, "cluster_inertia", "inertia", "centroid_sha256")
