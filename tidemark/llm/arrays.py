"""Text columns of Arrow batches as flat numpy arrays.

Operators of this package run inside ``mapInArrow``: Spark partitions and
shuffles the rows, numpy does the per-character work.  A batch is cut into
slices of about half a mebibyte of text, so memory follows the longest single text
and not the partition.  No Python object is made per word.

Words are known by a 64-bit polynomial hash.  Two given words collide with a
probability near 2**-64; for ten million distinct words the chance of any
collision is about 3e-6.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize

SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.RandomState(20_240_601).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)


class Alphabet:
    """Which bytes belong to words, and the hash value of each byte."""

    def __init__(self, is_word: Callable[[int], bool], lower: bool):
        codes = [b + 32 if lower and 65 <= b <= 90 else b for b in range(256)]
        self.word = np.array([is_word(b) for b in range(256)])
        self.value = _VALUES[codes]
        self.lower = lower

    def hash(self, word: str) -> np.uint64:
        """The hash that ``Words`` gives to this one word."""
        data = np.frombuffer(word.encode(), np.uint8)
        return Words(data, np.array([0, data.size]), self, check=False).hash[0]


SPACES = frozenset(b"\x20\x09\x0a\x0b\x0c\x0d")
#: words [^\x20\x09-\x0D]+, as they are or with A-Z lowered
SPACED = Alphabet(lambda b: b not in SPACES, lower=False)
SPACED_LOWER = Alphabet(lambda b: b not in SPACES, lower=True)
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lowered
ALNUM_LOWER = Alphabet(lambda b: b >= 128 or chr(b).isalnum(), lower=True)

_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the base and of its inverse modulo 2**64."""
    global _power, _inverse
    if _power.size < n:
        size = max(n, 2 * SLICE_BYTES)

        def grow(base: int) -> np.ndarray:
            out = np.full(size, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        _power, _inverse = grow(_BASE), grow(pow(_BASE, -1, 2**64))
    return _power[:n], _inverse[:n]


class Words:
    """Words of consecutive texts: ``start``/``end`` are byte positions, text
    ``d`` owns words ``ptr[d]`` to ``ptr[d + 1]``, ``hash`` is one value each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet, check: bool = True):
        word = alphabet.word[data] if check else np.ones(data.size, bool)
        first, last = word.copy(), word.copy()
        if data.size:
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            inner = offsets[1:-1]
            inner = inner[(inner > 0) & (inner < data.size)]
            first[inner] = word[inner]
            last[inner - 1] = word[inner - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.start, offsets)
        power, self._inverse = _powers(data.size + 1)
        self._sums = np.zeros(data.size + 1, np.uint64)
        np.cumsum(alphabet.value[data] * power[: data.size], out=self._sums[1:])
        self.hash = self.prefix_hash(None)

    def prefix_hash(self, length: int | None) -> np.ndarray:
        """Hash of each word's first ``length`` bytes (None: of the word)."""
        end = self.end if length is None else np.minimum(self.end, self.start + length)
        return mix((self._sums[end] - self._sums[self.start]) * self._inverse[self.start])

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.ptr.size - 1), np.diff(self.ptr))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(28))


def windows(words: Words, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every run of ``size`` words within one text.

    ``short``: a text with fewer words, but one at least, gives one run of all
    its words."""
    n = words.counts()
    per = np.maximum(n - size + 1, 0)
    if short:
        per = np.where((n > 0) & (n < size), 1, per)
    text = np.repeat(np.arange(n.size), per)
    at = np.arange(text.size) - np.repeat(np.cumsum(per) - per, per) + words.ptr[:-1][text]
    left = words.ptr[1:][text]
    h = np.full(text.size, size, np.uint64)
    for k in range(size):
        h = h * np.uint64(0xD6E8FEB86659FD93)
        if short:
            inside = at + k < left
            h[inside] += words.hash[(at + k)[inside]]
        else:
            h += words.hash[at + k]
    return text, mix(h)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def text_slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of rows with about ``limit`` bytes of text."""
    data, offsets = text_buffers(batch.column(name))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def row_ids(start: int, n: int) -> np.ndarray:
    """Ids of rows ``start`` to ``start + n`` of this partition, for use within one
    job: another job may split the same table elsewhere (see ``stored_ids``)."""
    return (TaskContext.get().partitionId() << 33) + start + np.arange(n, dtype=np.int64)


def stored(docs: DataFrame) -> DataFrame:
    """``docs`` if its rows have a place in stored files, else a stored copy of it."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return materialize(docs, "rows")
    return docs


def placed(docs: DataFrame, *columns) -> DataFrame:
    """``columns`` of a stored table with _file and _row, a row's place in it: the same
    in every job, however a scan is split."""
    return docs.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def file_numbers(docs: DataFrame) -> dict[str, int]:
    """Number of each file of a stored table; the driver lists them for a scan anyway."""
    return {r[0]: i for i, r in enumerate(docs.select(F.col("_metadata.file_path").alias("f")).distinct().orderBy("f").collect())}


def stored_ids(rows: pa.RecordBatch, files: dict[str, int]) -> np.ndarray:
    """Ids of ``placed`` rows, by file and place."""
    file = rows.column("_file").dictionary_encode()
    number = np.array([files[f] for f in file.dictionary.to_pylist()], np.int64)
    return (number[file.indices.to_numpy(zero_copy_only=False)] << 33) + rows.column("_row").to_numpy(zero_copy_only=False)


def output_schema(docs: DataFrame, kept: list[str], more: str = "") -> T.StructType:
    """Schema of ``kept`` columns of ``docs``, whatever their names, and the DDL fields ``more``."""
    fields = [T.StructField(c, docs.schema[c].dataType) for c in kept]
    return T.StructType(fields + (T.StructType.fromDDL(more).fields if more else []))


def split_column(name: str, buckets: int) -> Column:
    """crc32 of an id's text modulo ``buckets``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % buckets


class Counter64:
    """Sums by 64-bit key over many slices, handed out whenever ``limit``
    distinct keys are held, so memory is bounded and nothing is dropped."""

    def __init__(self, limit: int = 600_000):
        self.limit, self.parts, self.held = limit, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if keys.size:
            self.parts.append(_sum_by(keys, counts))
            self.held += self.parts[-1][0].size
        if self.held > self.limit:
            merged = self._merged()
            self.parts, self.held = [merged], merged[0].size
            if self.held > self.limit // 2:
                self.parts, self.held = [], 0
                yield merged

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.parts:
            yield self._merged()
        self.parts, self.held = [], 0

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) == 1:
            return self.parts[0]
        return _sum_by(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))


def _sum_by(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)
