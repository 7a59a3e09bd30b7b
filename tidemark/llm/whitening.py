"""Whitening of embeddings with multiplicities as weights.

Equal whole-number vectors are grouped first; a group counts with its number of
rows, or with one.  Sums of the fit list are exact.  Each task multiplies its
distinct vectors, centred, with themselves under their weights; only these small
matrices are added up, and their eigenvectors are found on the driver (size^2
numbers per vector size).  Every distinct vector is whitened once and joined back
to its rows by a 128-bit digest.  Groups so large that a task would notice are
joined by broadcast: there are at most ``HOT_PER_TASK`` for each shuffle partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import vectors as V
from tidemark.session import materialize, shuffle_partitions

HOT_PER_TASK = 8
#: an eigenvalue below this share of the largest one is no variance but rounding
NO_VARIANCE = 1e-13


@dataclass
class Basis:
    """Fit of the vectors of one size: weight ``n``, exact ``sums`` by component, and by
    falling eigenvalue the unit eigenvectors (columns), eigenvalues and shares of the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    shares: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        fits = self.n * V.greatest(x) + max(map(abs, self.sums), default=0) < 2**63
        exact = np.int64 if fits else object
        return x.astype(exact) * self.n - np.array(self.sums, exact)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        """Projections on the axes in units of their deviation; NaN on an axis without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (deviations.astype(np.float64) / self.n) @ self.axes / np.sqrt(self.values), np.nan)


def squared(deviations: np.ndarray) -> pa.Array:
    """Exact sum of squares of each row as decimal(38,0)."""
    whole = pa.decimal128(38, 0)
    if V.greatest(deviations) ** 2 * max(deviations.shape[1], 1) < 2**63:
        return pa.array((deviations.astype(np.int64) ** 2).sum(1), pa.int64()).cast(whole)
    return pa.array([Decimal(v) for v in (deviations.astype(object) ** 2).sum(1).tolist()], whole)


def coded(vectors: DataFrame, key: str, vector: str, factor: float, shift: int) -> DataFrame:
    """``key``, k (digest of x), x = floor(factor * c) + shift of the vectors without null or non-finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = V.whole_rows(batch, vector, factor, shift)
            data, upto = x.flatten().to_numpy().astype("<i8").tobytes(), (x.offsets.to_numpy() * 8).tolist()
            # the length goes in as well, so that digests of different sizes differ
            digests = [hashlib.blake2b(data[a:b], digest_size=16, salt=(b - a).to_bytes(8, "little")).digest() for a, b in zip(upto[:-1], upto[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(digests, pa.binary()), x], [key, "k", "x"])

    schema = T.StructType([vectors.schema[key], T.StructField("k", T.BinaryType()), T.StructField("x", T.ArrayType(T.LongType()))])
    return vectors.select(key, vector).mapInArrow(run, schema)


def fit(distinct: DataFrame, components: int) -> dict[int, Basis]:
    """Basis per vector size of ``distinct`` (x, weight)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = V.Totals()
        for batch in batches:
            weight = batch.column("weight").to_numpy()
            for d, at, x in V.matrices(batch.column("x")):
                totals.add(d, x, weight[at])
        yield from totals.batches()

    out: dict[int, Basis] = {}
    for r in distinct.select("x", "weight").mapInArrow(sums, V.TOTALS).groupBy("part", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("part", "dim").collect():
        basis = out.setdefault(r["part"], Basis(int(r["n"]), [], np.zeros((0, 0)), np.zeros(0), np.zeros(0)))
        if r["dim"] >= 0:
            basis.sums.append(int(r["s"]))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            weight = batch.column("weight").to_numpy().astype(np.float64)
            for d, at, x in V.matrices(batch.column("x")):
                c = out[d].deviations(x).astype(np.float64) / out[d].n
                held[d] = held.get(d, 0.0) + (c * weight[at, None]).T @ c
        for d, m in held.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(i.size, d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m[i, j])], ["size", "i", "j", "v"])

    found = distinct.select("x", "weight").mapInArrow(products, "size int, i int, j int, v double").groupBy("size", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    size, i, j, v = (found[c].to_numpy() for c in ("size", "i", "j", "v"))
    for d, basis in out.items():
        m, own = np.zeros((d, d)), size == d
        m[i[own], j[own]] = m[j[own], i[own]] = v[own] / basis.n
        values, axes = np.linalg.eigh(m)
        values, axes, trace = values[::-1][:components], axes[:, ::-1][:, :components], float(np.trace(m))
        real = values > NO_VARIANCE * max(float(values[0]), 0.0) if d else np.zeros(0, bool)
        basis.axes, basis.values = axes, np.where(real, values, 0.0)
        basis.shares = np.where(real, values, 0.0) / trace if trace > 0 else np.full(values.size, np.nan)
    return out


def identity_errors(whitened: DataFrame, bases: dict[int, Basis]) -> dict[int, float]:
    """Per vector size the largest absolute entry of the whitened vectors' covariance minus
    the identity, over the axes with variance; centred by their own mean."""
    out = {}
    for d, basis in bases.items():
        axes = np.flatnonzero(basis.values > 0).tolist()
        if not axes:
            out[d] = 0.0
            continue
        own = whitened.where(F.col("size") == d)
        w = [F.get("w", F.lit(i)) for i in axes]
        mean = own.agg(*[F.sum(F.col("weight") * c) / F.lit(float(basis.n)) for c in w]).first()
        centred = [c - F.lit(float(m)) for c, m in zip(w, mean, strict=True)]
        pairs = [(i, j) for i in range(len(w)) for j in range(i, len(w))]
        cov = own.agg(*[F.sum(F.col("weight") * centred[i] * centred[j]) / F.lit(float(basis.n)) for i, j in pairs]).first()
        out[d] = max(abs(float(v) - (i == j)) for v, (i, j) in zip(cov, pairs, strict=True))
    return out


def whiten(
    vectors: DataFrame, components: int = 8, factor: float = 1024.0, shift: int = 100_000, repeats: bool = True, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``key``, component (from 1), n, deviation (decimal(38,0)), whitened, explained,
    identity_error: one row per vector and component up to ``components``.

    The fit list is every remaining vector or, without ``repeats``, every distinct
    one; n is its size.  Null vectors and those with a null or non-finite component
    are left out; ids may be null or repeat, every row gets its own rows.  Vectors of
    different sizes are fitted apart (an empty vector has no component and no row).
    A component without variance has a null ``whitened``.  An empty table gives no
    row.  Components beyond 62 bits are an error."""
    rows = coded(vectors, key, vector, factor, shift)
    weight = F.count("*") if repeats else F.lit(1).cast("long")
    distinct = materialize(rows.groupBy("k", "x").agg(weight.alias("weight"), F.count("*").alias("copies")), "distinct")
    bases = fit(distinct, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in V.matrices(batch.column("x")):
                c = bases[d].deviations(x)
                w = bases[d].whitened(c)
                w = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel(), from_pandas=True))
                pick = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column("k").take(pick), pa.array(np.full(len(at), d), pa.int32()), batch.column("weight").take(pick), batch.column("copies").take(pick), squared(c), w], ["k", "size", "weight", "copies", "deviation", "w"])

    whitened = materialize(distinct.mapInArrow(run, "k binary, size int, weight long, copies long, deviation decimal(38,0), w array<double>"), "whitened")
    errors = identity_errors(whitened, bases)
    joined = _join_back(materialize(rows.select(key, "k"), "keys"), whitened, key)
    if not bases:
        fits = F.lit(None).cast("struct<n:bigint,shares:array<double>,error:double>")
    else:
        one = lambda d, b: F.struct(F.lit(b.n).cast("long").alias("n"), F.array(*[F.lit(float(s)) for s in b.shares]).cast("array<double>").alias("shares"), F.lit(errors[d]).alias("error"))
        fits = F.create_map(*[c for d, b in bases.items() for c in (F.lit(d), one(d, b))])[F.col("size")]
    out = joined.select(key, fits.alias("fit"), "deviation", F.posexplode("w").alias("at", "whitened"))
    share = F.get("fit.shares", F.col("at"))
    return out.select(
        key, (F.col("at") + 1).alias("component"), F.col("fit.n").alias("n"), "deviation", "whitened", F.when(~F.isnan(share), share).alias("explained"), F.col("fit.error").alias("identity_error"),
    )


def _join_back(rows: DataFrame, whitened: DataFrame, key: str) -> DataFrame:
    """``rows`` (``key``, k) with the whitened vector of their digest."""
    parts = whitened.select("k", "size", "deviation", "w")
    total = whitened.agg(F.sum("copies")).first()[0] or 0
    share = total / (HOT_PER_TASK * shuffle_partitions(rows.sparkSession))
    large = F.col("copies") > max(share, 1.0)
    hot = parts.where(large)  # at most HOT_PER_TASK rows per shuffle partition
    cold = rows.join(F.broadcast(hot.select("k")), "k", "left_anti").join(parts.where(~large), "k")
    return rows.join(F.broadcast(hot), "k").unionByName(cold).select(key, "size", "deviation", "w")
