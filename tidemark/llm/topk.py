"""Exact top-k inner products by pivot-table elimination.

Vectors are rows of whole numbers.  Distances of every vector to some pivots are
computed once and stored beside it.  For a query q and a candidate v the
triangle inequality gives |d(q, p) - d(v, p)| <= d(q, v) for every pivot p; the
maximum over the pivots is a lower bound of the distance, and with

    <q, v> = (|q|^2 + |v|^2 - d(q, v)^2) / 2

an upper bound of the inner product.  Candidates are evaluated in the order of
that bound, in growing steps, until the next bound is below the k-th score
found.  Bounds are widened by the rounding of the stored distances, so the
result is exact; equal scores go to the smaller id.

Every query meets every candidate once: candidates are dealt into chunks and
queries into blocks by a hash of the row number, and one group holds one chunk
and one block.  Each group returns k rows per query, and a window keeps the best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import arrays
from tidemark.llm import vectors as vectors_
from tidemark.session import materialize

PIVOTS = 32
CHUNK, BLOCK = 65_536, 16_384
_SMALL_CHUNK, _FEW = 2_048, 32
#: bound of the relative error of a stored distance, as a share of it and of the vectors' lengths
_ERROR = 4e-6


def quantised(vectors: DataFrame, key: str, vector: str, factor: float) -> DataFrame:
    """rid, key, size, q: components floor(factor * x) as 64-bit numbers.

    Rows with a null id, and vectors that are null, empty or hold a null or
    non-finite component, are left out.  Components beyond 62 bits are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            size, good, x = vectors_.finite(batch.column(vector))
            q = vectors_.floored(np.where(np.repeat(good, size), x, 0), factor).astype("<i8")
            keep = pa.array(good & (size > 0) & batch.column(key).is_valid().to_numpy(zero_copy_only=False))
            upto = np.r_[0, np.cumsum(size)].astype(np.int32) * 8
            packed = pa.Array.from_buffers(pa.binary(), size.size, [None, pa.py_buffer(upto.tobytes()), pa.py_buffer(q.tobytes())])
            out = pa.RecordBatch.from_arrays([pa.array(arrays.row_ids(at, size.size)), batch.column(key), pa.array(size, pa.int32()), packed], ["rid", key, "size", "q"])
            yield out.filter(keep)
            at += size.size

    return vectors.select(key, vector).mapInArrow(run, f"rid long, `{key}` {vectors.schema[key].dataType.simpleString()}, size int, q binary")


def _matrix(column: pa.ChunkedArray | pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def pivot_table(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with d: distances to the pivots of the vector's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            out: list[bytes] = [b""] * sizes.size
            for n in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == n)
                if n in pivots:
                    v = _matrix(batch.column("q").take(pa.array(at)), n, "<i8").astype(np.float64)
                    p = pivots[n].astype(np.float64)
                    d = np.sqrt(np.maximum((v**2).sum(1)[:, None] + (p**2).sum(1)[None, :] - 2 * v @ p.T, 0)).astype("<f4")
                    for i, row in zip(at.tolist(), d, strict=True):
                        out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "d"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", d binary")


def best_of(query: np.ndarray, near: np.ndarray, own: int, vectors: np.ndarray, norms: np.ndarray, table: np.ndarray, slack: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of the k best candidates of one query, and how they were found.

    ``own`` is the position of the query's own row, or -1; ``slack`` is 2 * _ERROR
    of each distance in ``table``."""
    n2 = float((query.astype(np.float64) ** 2).sum())
    bound = np.full(norms.size, np.inf)
    if table.shape[1]:
        # a pivot may be much longer than both vectors, so its distances carry larger errors
        gap = (np.abs(table - near) - slack).max(1).astype(np.float64) * (1 - _ERROR)
        gap = np.maximum(gap - _ERROR * (np.sqrt(n2) + np.sqrt(norms) + 1), 0)
        bound = (n2 + norms - gap**2) / 2 + 0.5 + 1e-12 * (n2 + norms)
    if own >= 0:
        bound[own] = -np.inf
    left = np.flatnonzero(bound > -np.inf)
    at, scores, step = np.zeros(0, np.int64), np.zeros(0, vectors.dtype), 64
    floor = -np.inf
    while left.size:
        if left.size > step:
            cut = np.argpartition(-bound[left], step)
            now, left = left[cut[:step]], left[cut[step:]]
        else:
            now, left = left, left[:0]
        at, scores = np.r_[at, now], np.r_[scores, vectors[now] @ query]
        if at.size > k:
            best = _best_first(ids[at], scores)[:k]
            at, scores = at[best], scores[best]
        if at.size == k:
            floor = scores.min()
            left = left[bound[left] >= floor]
        step *= 4
    order = _best_first(ids[at], scores)
    return at[order], scores[order]


def _best_first(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Order by falling score, then id."""
    if scores.dtype != object:
        return np.lexsort((ids, -scores))
    return np.array(sorted(range(scores.size), key=lambda i: (-scores[i], ids[i])), np.int64)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, factor: float = 256.0, pivots: int = PIVOTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), ``key``, score: the k best other rows of every row
    whose id is divisible by ``every``.

    Vectors of different sizes are not compared; a query with fewer than k
    candidates gets all; rows that repeat an id count each; equal scores go to the
    smaller id, then to the earlier row; an empty table gives no row.  Scores are
    exact; one that does not fit 64 bits is an error."""
    kind = vectors.schema[key].dataType.simpleString()
    rows = materialize(quantised(vectors, key, vector, factor), "vectors")
    sample = rows.orderBy(F.xxhash64("rid"), "rid").limit(pivots).select("size", "q").toArrow()  # a fixed number of rows
    chosen = {n: _matrix(sample.filter(pc.equal(sample["size"], n))["q"], n, "<i8") for n in set(sample["size"].to_pylist())}
    table = materialize(pivot_table(rows, chosen), "pivots")
    n, n_queries = table.agg(F.count("*"), F.count(F.when(F.col(key) % every == 0, 1))).first()
    chunks = max(1, math.ceil(n / CHUNK), min(_FEW, math.ceil(n / _SMALL_CHUNK)))
    blocks = max(1, math.ceil(n_queries / BLOCK))
    spot = F.xxhash64("rid")
    candidates = table.withColumn("chunk", F.pmod(spot, F.lit(chunks))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = table.where(F.col(key) % every == 0).withColumn("block", F.pmod(F.xxhash64(spot), F.lit(blocks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    schema = pa.schema([("query_rid", pa.int64()), ("query_id", pa.int64()), (key, pa.int64()), ("rid", pa.int64()), ("score", pa.int64())])

    def search(own: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        for size in set(queries["size"].to_pylist()):
            v, q = (t.filter(pc.equal(t["size"], size)) for t in (own, queries))
            if not v.num_rows:
                continue
            pivot_count = len(chosen.get(size, ()))
            vec, ask = _matrix(v["q"], size, "<i8"), _matrix(q["q"], size, "<i8")
            table_v, table_q = _matrix(v["d"], pivot_count, "<f4"), _matrix(q["d"], pivot_count, "<f4")
            # sums of products below 2**53 are exact as doubles, which multiply faster
            most = vectors_.greatest(vec) * vectors_.greatest(ask) * size
            exact = np.float64 if most < 2**53 else np.int64 if most < 2**63 else object
            vec, ask = vec.astype(exact), ask.astype(exact)
            norms, slack = (vec.astype(np.float64) ** 2).sum(1), np.float32(2 * _ERROR) * table_v
            ids, rids = v[key].to_numpy(), v["rid"].to_numpy()
            place = {r: i for i, r in enumerate(rids.tolist())}
            for i, (rid, name) in enumerate(zip(q["rid"].to_pylist(), q[key].to_pylist(), strict=True)):
                at, scores = best_of(ask[i], table_q[i], place.get(rid, -1), vec, norms, table_v, slack, ids, k)
                if scores.size and vectors_.greatest(scores) >= 2**63:
                    raise OverflowError("a score does not fit 64 bits")
                found.append((np.full(at.size, rid), np.full(at.size, name), ids[at], rids[at], scores.astype(np.int64)))
        if not found:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], schema=schema)

    met = candidates.groupBy("chunk", "block").cogroup(asked.groupBy("chunk", "block"))
    best = met.applyInArrow(search, f"query_rid long, query_id {kind}, `{key}` {kind}, rid long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_rid").orderBy(F.desc("score"), key, "rid")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", key, "score")
