"""Order-preserving packing of documents into windows by dynamic programming.

The documents of a partition form one stream of ids, each document followed by
the end id.  Windows of at most ``size`` ids cut the stream; a cut may stand at
the end of a document (free), at the end of a sentence (``sentence_cost``) or,
inside a sentence of more than ``size / 32`` ids, at every ``size / 64`` ids
(``hard_cost``).  The cuts minimise padding plus these truncation penalties:

    f(j) = cost(j) + min over i of f(i) + padding(c_j - c_i)

Padding is ``size`` minus the length, so f(i) + c_i is all that depends on i, and
a monotone queue over the last ``size`` ids gives the minimum in constant time.
Windows whose length is a power of two of at least ``size / 4`` need no padding;
they are extra transitions found by position.

The stream is handled in runs of some hundred thousand ids.  The last two windows
of a run, whose end the run and not the optimum has set, are cut anew with the
next run, so memory is bounded and only the last window of a partition is short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm import arrays
from tidemark.llm.bpe import Encoder, encoded_slices, encoder


def sentence_ends(enc: Encoder) -> np.ndarray:
    """Whether a sentence or line ends with each token id."""
    return np.array([b.endswith((b".", b"!", b"?")) or b"\n" in b for b in enc.token_bytes])


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, size: int, sentence_cost: int, hard_cost: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (0 first, the total last) where a window may end, and their costs."""
    cost = np.full(ids.size + 1, -1, np.int64)
    cost[np.flatnonzero(ends[ids]) + 1] = sentence_cost
    cost[doc_ends] = 0
    cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    step = max(1, size // 64)
    gap = np.diff(at)
    inside = np.where(gap > 2 * step, (gap - 1) // step, 0)
    extra = np.repeat(at[:-1], inside) + step * (np.arange(int(inside.sum())) - np.repeat(np.cumsum(inside) - inside, inside) + 1)
    cost[extra] = hard_cost
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_cuts(points: np.ndarray, costs: np.ndarray, size: int) -> list[int]:
    """Indices of the points at which windows end, the first point excluded."""
    c, cost = points.tolist(), costs.tolist()
    n = len(c)
    powers = [p for p in (size // 4, size // 2) if p & (p - 1) == 0]
    place = {p: i for i, p in enumerate(c)}
    f, g, came = [0] * n, [0] * n, [0] * n
    g[0] = c[0]
    queue, head = [0] * n, 0
    tail = 0  # queue[head:tail] holds points with rising f(i) + c_i
    for j in range(1, n):
        i, here = j - 1, c[j]
        value = g[i]
        while tail > head and g[queue[tail - 1]] >= value:
            tail -= 1
        queue[tail] = i
        tail += 1
        floor = here - size
        while c[queue[head]] < floor:
            head += 1
        best = queue[head]
        least = size - here + g[best]
        for p in powers:
            k = place.get(here - p)
            if k is not None and f[k] < least:
                least, best = f[k], k
        f[j] = least + cost[j]
        g[j] = f[j] + here
        came[j] = best
    out, j = [], n - 1
    while j > 0:
        out.append(j)
        j = came[j]
    return out[::-1]


class _Stream:
    """Documents of one partition on their way into windows."""

    def __init__(self, enc: Encoder, size: int, end_id: int, sentence_cost: int, hard_cost: int):
        self.ends, self.size, self.end_id = sentence_ends(enc), size, end_id
        self.costs = (sentence_cost, hard_cost)
        self.sequence = TaskContext.get().partitionId() << 40
        self.ids = np.zeros(0, np.int32)
        self.keys: list = []
        self.base = self.total = self.left = np.zeros(0, np.int64)  # per document: ids given out, all ids, ids here

    def add(self, keys: list, ids: np.ndarray, ptr: np.ndarray) -> None:
        n = np.diff(ptr)
        with_end = np.full(ids.size + n.size, self.end_id, np.int32)
        with_end[np.arange(ids.size) + np.repeat(np.arange(n.size), n)] = ids
        self.ids = np.concatenate([self.ids, with_end])
        self.keys += keys
        self.base, self.total, self.left = (np.concatenate(x) for x in ((self.base, np.zeros_like(n)), (self.total, n + 1), (self.left, n + 1)))

    def windows(self, last: bool) -> tuple | None:
        """Columns of the pieces of all windows that are settled."""
        if not self.ids.size:
            return None
        doc_end = np.cumsum(self.left)
        doc_start = doc_end - self.left
        points, costs = cut_points(self.ids, doc_end, self.ends, self.size, *self.costs)
        cuts = points[best_cuts(points, costs, self.size)]
        if not last:
            cuts = cuts[:-2]
        if not cuts.size:
            return None
        upto = int(cuts[-1])
        window = np.r_[0, cuts[:-1]]
        start = np.unique(np.concatenate([window, doc_start[doc_start < upto]]))
        stop = np.r_[start[1:], upto]
        doc = np.searchsorted(doc_start, start, "right") - 1
        seq = np.searchsorted(window, start, "right") - 1
        raw = memoryview(self.ids[:upto].astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        out = ([self.keys[d] for d in doc.tolist()], start - doc_start[doc] + self.base[doc], stop - start, crc, self.total[doc], self.sequence + seq, start - window[seq])
        self.sequence += window.size
        keep = int(np.searchsorted(doc_end, upto, "right"))
        self.ids, self.keys = self.ids[upto:], self.keys[keep:]
        base, start = self.base[keep:].copy(), doc_start[keep:]
        if base.size and start[0] < upto:
            base[0] += upto - start[0]
        self.base, self.total, self.left = base, self.total[keep:], doc_end[keep:] - np.maximum(start, upto)
        return out


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 0, sentence_cost: int = 2, hard_cost: int = 16, text: str = "text", key: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """One row per piece of a document: key, start (its ids before the piece),
    length, ids_crc32, doc_tokens, sequence_id, offset (ids before it in the
    window), then the ``carry`` columns of its document.  Order within a partition
    is kept; no shuffle.

    A null or empty text is a document of the end id alone; rows that repeat are
    packed each; an empty table gives no row; other columns are left behind.
    Window numbers hold the partition and a counter: equal scans of a stored
    table, retried tasks among them, give equal rows."""
    own = [key, *carry]
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        stream = _Stream(enc, size, end_id, sentence_cost, hard_cost)
        types = None

        def batch_of(columns: tuple | None) -> Iterator[pa.RecordBatch]:
            if columns:
                first, *rest = (pa.array(c, t) for c, t in zip(zip(*columns[0], strict=True), types, strict=True))
                yield pa.RecordBatch.from_arrays([first, *(pa.array(np.asarray(c, np.int64)) for c in columns[1:]), *rest], [*names, *carry])

        for batch in batches:
            types = [batch.schema.field(c).type for c in own]
            for rows, ids, ptr in encoded_slices(enc, batch, text):
                stream.add(list(zip(*(rows.column(c).to_pylist() for c in own), strict=True)), ids, ptr)
                if stream.ids.size >= arrays.SLICE_BYTES // 4:
                    yield from batch_of(stream.windows(last=False))
        yield from batch_of(stream.windows(last=True))

    kinds = {c: f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own}
    return docs.select(*own, text).mapInArrow(run, ", ".join([kinds[key], *(f"{n} long" for n in names[1:]), *(kinds[c] for c in carry)]))
