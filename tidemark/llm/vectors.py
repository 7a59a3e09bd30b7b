"""Array columns of Arrow batches as exact whole-number matrices."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: components a task handles at once
SLICE_COMPONENTS = 1 << 19
TOTALS = "part int, dim int, n decimal(38,0), s decimal(38,0)"


def finite(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, good, flat) of a column of vectors, flat as doubles.

    Good vectors are not null and hold no null, NaN or infinite component.  A null
    vector has size 0 and no component in ``flat``."""
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    bad = np.bincount(np.repeat(np.arange(size.size), size), ~np.isfinite(flat), size.size) > 0
    return size, ~bad & column.is_valid().to_numpy(zero_copy_only=False), flat


def floored(flat: np.ndarray, factor: float, shift: int = 0) -> np.ndarray:
    """floor(factor * x) + shift as 64-bit numbers; an error where they do not fit."""
    with np.errstate(over="ignore"):
        x = np.floor(factor * flat)
    if x.size and not np.abs(x).max() < 2.0**62:
        raise OverflowError("a component times the factor does not fit 64 bits")
    return x.astype(np.int64) + shift


def lists(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    """Column of arrays from their components in a row."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(flat))


def whole_rows(batch: pa.RecordBatch, vector: str, factor: float, shift: int = 0, size: int | None = None) -> tuple[pa.RecordBatch, pa.Array]:
    """(rows, vectors) of the good vectors of a batch, floored; ``size`` None: of any size, 0 included."""
    n, good, flat = finite(batch.column(vector))
    if size is not None:
        good &= n == size
    x = floored(flat[np.repeat(good, n)], factor, shift)
    return batch.filter(pa.array(good)), lists(x, n[good])


def matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, positions, matrix) of the vectors of each size, in slices of bounded size."""
    size = pc.list_value_length(column).to_numpy()
    flat, start = column.flatten().to_numpy(), np.cumsum(size) - size
    for d in np.unique(size).tolist():
        at, step = np.flatnonzero(size == d), max(1, SLICE_COMPONENTS // max(d, 1))
        for lo in range(0, at.size, step):
            part = at[lo : lo + step]
            yield d, part, flat[start[part, None] + np.arange(d)]


def greatest(*values: np.ndarray) -> int:
    """Largest absolute value."""
    return max((abs(int(f(v))) for v in values if v.size for f in (np.min, np.max)), default=0)


class Totals:
    """Exact sums of weighted whole-number vectors by part, held for one task."""

    def __init__(self):
        self.sums: dict[int, list] = {}

    def add(self, part: int, x: np.ndarray, weights: np.ndarray | None = None) -> None:
        if not len(x):
            return
        n = len(x) if weights is None else sum(weights.tolist())
        exact = np.int64 if greatest(x) * n < 2**62 else object
        x = x.astype(exact)
        s = (x if weights is None else x * weights.astype(exact)[:, None]).sum(0).tolist()
        held = self.sums.setdefault(part, [0, [0] * x.shape[1]])
        held[0] += n
        held[1] = [a + b for a, b in zip(held[1], s, strict=True)]

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Rows of ``TOTALS``; dimension -1 stands for all, so that vectors of size 0 count as well."""
        for part, (n, s) in self.sums.items():
            m = len(s) + 1
            whole = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * m, pa.int32()), pa.array(range(-1, m - 1), pa.int32()), pa.array([Decimal(n)] * m, whole), pa.array([Decimal(0), *map(Decimal, s)], whole)],
                ["part", "dim", "n", "s"],
            )
