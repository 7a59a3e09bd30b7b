"""Byte-pair encoding and decoding with contiguous rank arrays.

Every distinct word of a slice is encoded once.  The words are held as rows of
a matrix of part ids, beside a matrix of the ranks of adjacent parts: the
boundaries and ranks of one word lie side by side.  Each round scans the ranks
of a row for the minimum, deletes that boundary by closing the gap, and looks up
the two ranks next to it, until no row has a mergeable pair.  Words longer than
``SHORT_BYTES`` would make the scan quadratic; they keep their boundaries in a
linked list with a heap of ranks.

The vocabulary file is a parameter; its pre-tokenizer must be the byte-level
one with its own pattern, without a normalizer, as in public byte-level files.
Results equal the reference library's ``encode(text, add_special_tokens=False)``
and ``decode(ids, skip_special_tokens=False)``; added tokens that stand in a
text are found first, as there.  Nulls count as empty texts.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import arrays

SHORT_BYTES = 40
CACHE_WORDS = 200_000
_WIDTHS = (1, 4, 6, 8, 10, 13, 18, 26, SHORT_BYTES)  # bytes of a row of short words
PIECE_CHARS = 1 << 19

# classes of code points in the byte-level pattern
OTHER, LETTER, NUMBER, BLANK, SPACE, ADDED, END = range(7)
ADDED_MARK, END_MARK = 0x110000, 0x110001
_NONE = np.int64(1 << 40)
_CUT = re.compile(r"(?<=\S) (?=\S)")


@functools.cache
def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    table = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)] + [ADDED, END], np.uint8)
    # the White_Space property
    table[[*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    table[0x20] = BLANK
    return table


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def word_starts(codes: np.ndarray) -> np.ndarray:
    """Positions at which the byte-level pattern starts a word.

    ``codes`` holds code points, ADDED marks (0x110000) and an END mark
    (0x110001) behind every text; each mark is a word of its own."""
    kind = _classes()[codes]
    space = (kind == BLANK) | (kind == SPACE)
    run = np.where(space, SPACE, kind)
    start = np.ones(codes.size, bool)
    start[1:] = (run[1:] != run[:-1]) | (run[1:] >= ADDED)
    # the last white space of a run that text follows is not part of the run
    last = np.flatnonzero(space[:-1] & (run[1:] < SPACE))
    start[last] = True
    start[last[kind[last] == BLANK] + 1] = False
    # 's 't 'm 'd 're 've 'll where a word can start
    quote = np.flatnonzero(codes == 39)
    if quote.size:
        before = np.where(quote > 0, quote - 1, 0)
        quote = quote[((kind[before] != OTHER) & (kind[before] != BLANK)) | (quote == 0)]
        ahead = np.r_[codes, codes[-1], codes[-1]]
        a, b = ahead[quote + 1], ahead[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for at, size in ((quote[one], 2), (quote[two & ~one], 3)):
            start[at + 1] = False
            follows = at + size
            # the letters after it start anew; white space and marks already do
            start[follows[run[follows] == LETTER]] = True
    return np.flatnonzero(start)


class Encoder:
    """Encoder of one process; keeps the words it has seen."""

    def __init__(self, path: str, added: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        listed = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = listed if added else {}
        size = max([*vocab.values(), *listed.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in listed.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        joined = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._size = size
        # open table of pairs: slot by a multiplied key, next slots until free
        keys = left * size + right
        self._bits = 20
        self._slot_key = np.full((1 << self._bits) + 64, -1, np.int64)
        self._slot_rank = np.zeros(self._slot_key.size, np.int32)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            while self._slot_key[at] not in (-1, key):
                at += 1
            if self._slot_key[at] == -1:
                self._slot_key[at], self._slot_rank[at] = key, rank
        self._joined = joined
        self._single = {}
        self._forget()

    def _forget(self) -> None:
        self._known: dict[int, int] = {}
        self._flat: list[np.ndarray] = []
        self.ids = np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of part ids, a huge one where they do not merge."""
        keys = left * self._size + right
        at = self._slots(keys)
        found = self._slot_key[at]
        rank = np.where(found == keys, self._slot_rank[at], _NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while open_.size:
            at[open_] += 1
            found = self._slot_key[at[open_]]
            hit = found == keys[open_]
            rank[open_[hit]] = self._slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return rank

    def merge_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each word's ids) of short words: words of
        similar length share padded rows, all of which go in step."""
        lengths = np.array([len(w) for w in words], np.int64)
        sizes, merged = lengths.copy(), []
        for low, n in zip((0, *_WIDTHS), _WIDTHS):
            index = np.flatnonzero((lengths > low) & (lengths <= n))
            if not index.size:
                continue
            raw = np.frombuffer(b"".join([words[i].ljust(n, b"\0") for i in index.tolist()]), np.uint8).reshape(-1, n)
            parts, sizes[index] = self._merge_rows(self.byte_id[raw], lengths[index])
            merged.append((index, parts))
        first = np.cumsum(sizes) - sizes
        ids = np.zeros(int(sizes.sum()), np.int64)
        for index, parts in merged:
            row, column = np.nonzero(np.arange(parts.shape[1]) < sizes[index][:, None])
            ids[first[index][row] + column] = parts[row, column]
        return ids, sizes

    def _merge_rows(self, parts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of each row after all merges, and how many of them count."""
        parts, size = parts.copy(), size.copy()
        n = parts.shape[1]
        if n == 1:
            return parts, size
        inner, column = np.arange(n - 1) < size[:, None] - 1, np.arange(n - 1)
        ranks = np.full((size.size, n - 1), _NONE)
        ranks[inner] = self._ranks(parts[:, :-1][inner], parts[:, 1:][inner])
        live = np.arange(size.size)
        while live.size:
            own = ranks[live]
            at = own.argmin(1)
            best = own[np.arange(live.size), at]
            go = best < _NONE
            live, at, best, own = live[go], at[go], best[go], own[go]
            if not live.size:
                break
            row = parts[live]
            row[np.arange(live.size), at] = self._joined[best]
            # delete the boundary: close the gap behind it
            behind = column >= at[:, None]
            np.copyto(row[:, 1:-1], row[:, 2:].copy(), where=behind[:, :-1])
            np.copyto(own[:, :-1], own[:, 1:].copy(), where=behind[:, :-1])
            own[:, -1] = _NONE
            parts[live] = row
            size[live] -= 1
            # refresh the neighbouring ranks
            has = np.flatnonzero(at > 0)
            own[has, at[has] - 1] = self._ranks(row[has, at[has] - 1], row[has, at[has]])
            has = np.flatnonzero(at + 1 < size[live])
            own[has, at[has]] = self._ranks(row[has, at[has]], row[has, at[has] + 1])
            ranks[live] = own
        return parts, size

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: linked boundaries and a heap of ranks."""
        part = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(part)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank = self._ranks(np.array(part[:-1]), np.array(part[1:])).tolist()
        heap = [(r, i, part[i], part[i + 1]) for i, r in enumerate(rank) if r < _NONE]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            pair = (part[i], part[j])
            if pair not in self._single:
                if len(self._single) > CACHE_WORDS // 8:
                    self._single.clear()
                self._single[pair] = int(self._ranks(np.array([pair[0]]), np.array([pair[1]]))[0])
            if self._single[pair] < _NONE:
                heapq.heappush(heap, (self._single[pair], i, *pair))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or part[i] != a or part[j] != b:
                continue
            part[i], alive[j], after[i] = int(self._joined[r]), False, after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([p for p, live in zip(part, alive, strict=True) if live], np.int64)

    def _learn(self, words: list[str | int]) -> None:
        """Append the ids of new words (an int is the id of an added token)."""
        raw = [w.encode() if isinstance(w, str) else b"" for w in words]
        ids, sizes = self.merge_short([w if len(w) <= SHORT_BYTES else b"" for w in raw])
        other = {i: np.array([w], np.int64) for i, w in enumerate(words) if isinstance(w, int)}
        other |= {i: self.merge_long(w) for i, w in enumerate(raw) if len(w) > SHORT_BYTES}
        if other:
            upto = np.cumsum(sizes)
            order = sorted(other)
            ids = np.insert(ids, np.repeat(upto[order], [other[i].size for i in order]), np.concatenate([other[i] for i in order]))
            sizes[order] = [other[i].size for i in order]
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])

    def word_numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word in ``first``, words up to the end of each text)."""
        if len(self._known) > CACHE_WORDS:
            self._forget()
        pieces: list[str] = []
        marks: list[tuple[int, int, int]] = []  # (piece, code, id of the added token)
        for text in texts:
            for part in self._split_added(text):
                if isinstance(part, int):
                    marks.append((len(pieces), ADDED_MARK, part))
                pieces.append(part if isinstance(part, str) else "\x00")
            marks.append((len(pieces), END_MARK, -1))
            pieces.append("\x00")
        joined = "".join(pieces)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        length = np.array([len(p) for p in pieces], np.int64)
        at = np.cumsum(length) - length
        codes[at[[m[0] for m in marks]]] = [m[1] for m in marks]
        added_at = {int(at[k]): i for k, code, i in marks if code == ADDED_MARK}
        start = word_starts(codes)
        stop = np.r_[start[1:], codes.size]
        power, inverse = arrays._powers(codes.size + 1)
        sums = np.zeros(codes.size + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(0x51ED270B)) * np.uint64(0xA24BAED4963EE407) * power[: codes.size], out=sums[1:])
        h = arrays.mix((sums[stop] - sums[start]) * inverse[start])
        is_end = codes[start] == END_MARK
        if added_at:
            own = np.flatnonzero(codes[start] == ADDED_MARK)
            h[own] = np.array([added_at[int(start[k])] for k in own], np.uint64) ^ np.uint64(0xF000000000000000)
        text_ptr = np.cumsum(~is_end)[is_end]
        h, start, stop = h[~is_end], start[~is_end], stop[~is_end]
        code, distinct = pd.factorize(h)
        known, keys = self._known, distinct.tolist()
        number = np.array([known.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(number < 0)
        if new.size:
            where = np.full(distinct.size, -1, np.int64)
            where[code[::-1]] = np.arange(code.size)[::-1]
            where = where[new]
            self._learn([added_at[a] if a in added_at else joined[a:b] for a, b in zip(start[where].tolist(), stop[where].tolist(), strict=True)])
            base = len(known)
            number[new] = base + np.arange(new.size)
            known.update(zip([keys[i] for i in new.tolist()], range(base, base + new.size), strict=True))
        return number[code] if code.size else np.zeros(0, np.int64), text_ptr

    def _split_added(self, text: str) -> list[str | int]:
        parts: list[str | int] = [text]
        for token, i in self.added.items():
            if token in text:
                parts = [x for p in parts for x in (_between(p.split(token), i) if isinstance(p, str) else [p])]
        return parts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ``ptr``): text d has ids[ptr[d]:ptr[d + 1]]."""
        number, text_ptr = self.word_numbers(texts)
        ids, per_word = self.expand(number)
        upto = np.r_[0, np.cumsum(per_word)]
        return ids, upto[np.r_[0, text_ptr]]

    def expand(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.first[number + 1] - self.first[number]
        shift = self.first[number] - (np.cumsum(size) - size)
        return self.ids[np.arange(int(size.sum())) + np.repeat(shift, size)], size

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def _between(parts: list[str], mark: int) -> list[str | int]:
    return [x for k, p in enumerate(parts) for x in ([mark, p] if k else [p])]


def _safe_parts(text: str) -> Iterator[str]:
    """Cut a very long text before single blanks between words, where the
    pattern starts a word whatever stands around."""
    lo = 0
    while len(text) - lo > 2 * PIECE_CHARS:
        cut = _CUT.search(text, lo + PIECE_CHARS)
        if not cut:
            break
        yield text[lo : cut.start()]
        lo = cut.start()
    yield text[lo:] if lo else text


def encoded_slices(enc: Encoder, batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, ptr) for runs of rows; row d has ids[ptr[d]:ptr[d + 1]]."""
    for rows, data, _ in arrays.text_slices(batch, name):
        texts = [t or "" for t in rows.column(name).to_pylist()]
        if data.size <= 2 * PIECE_CHARS:
            yield rows, *enc.encode(texts)
        else:  # one long text
            parts = [enc.encode([p])[0] for t in texts for p in _safe_parts(t)]
            ids = np.concatenate(parts)
            yield rows, ids, np.array([0, ids.size])


@functools.cache
def encoder(path: str, added: bool = True) -> Encoder:
    """One encoder per process; without ``added``, added tokens are ordinary text."""
    return Encoder(path, added)


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode every whole text, decode the ids again.

    Per row: key, n_tokens, ids (list of int), decoded (string).  A null or empty
    text gives no ids and an empty decoded text; rows that repeat are encoded
    each; other columns are left behind.  One scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for rows, ids, ptr in encoded_slices(enc, batch, text):
                decoded = [enc.decode(ids[a:b].tolist()) for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(key), pa.array(np.diff(ptr)), pa.ListArray.from_arrays(ptr.astype(np.int32), ids), pa.array(decoded, pa.string())],
                    [key, "n_tokens", "ids", "decoded"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``encode_decode`` with ids and decoded text given as SHA-256 digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        decimal = [str(i) for i in range(len(enc.token_bytes))]
        for batch in batches:
            for rows, ids, ptr in encoded_slices(enc, batch, text):
                listed, of_ids, of_text = ids.tolist(), [], []
                for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
                    own = listed[a:b]
                    of_ids.append(hashlib.sha256(",".join(map(decimal.__getitem__, own)).encode()).hexdigest())
                    of_text.append(hashlib.sha256(enc.decode(own).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([rows.column(key), pa.array(np.diff(ptr)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
