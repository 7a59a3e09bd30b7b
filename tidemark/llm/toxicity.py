"""Toxicity with a counterfactual-regularised classifier.

A linear classifier over words and word beginnings learns which words mark toxic
texts.  Trained plainly, it also learns that texts which name a group are often
toxic, and then rejects neutral mentions.  So identity terms in labelled texts
are swapped for every other term of their kind; the text keeps its label, and
the squared change of the score is added to the loss:

    mean log loss + l2 |w|^2 + fairness * mean over swaps of (w x - w x')^2

Features are the presence of words (A-Z in lower case, split at ASCII
punctuation) and of their first four and six bytes.  The classifier is fitted on
about ``SAMPLE_ROWS`` labelled rows of each class at most, chosen by a hash of
the id: Spark counts all their features, and at most ``FEATURES`` that pass a
likelihood-ratio test are used, so the fit's size is bounded.  Classes count alike
in the fit: a score is the probability of the toxic class at equal shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import arrays
from tidemark.session import materialize

SAMPLE_ROWS = 10_000
FEATURES = 4_096
LEAST_ROWS, LEAST_GAIN = 3, 8.0
PREFIXES = (4, 6)

#: terms of one kind may stand for each other
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("feminist", "activist"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"), ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "citizens"), ("mexican", "american", "chinese", "french", "german", "indian", "russian", "turkish"), ("blind", "deaf", "disabled", "old", "young"),
)


def features(words: arrays.Words) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of every feature of every word."""
    size = words.end - words.start
    at, h = [np.arange(size.size)], [words.hash]
    for n in PREFIXES:
        longer = np.flatnonzero(size > n)
        at.append(longer)
        h.append(arrays.mix(words.prefix_hash(n)[longer] + np.uint64(n)))
    return np.concatenate(at), np.concatenate(h)


def word_features(word: str) -> np.ndarray:
    data = np.frombuffer(word.encode(), np.uint8)
    return features(arrays.Words(data, np.array([0, data.size]), arrays.ALNUM_LOWER))[1]


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    intercept: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = offsets.size - 1
        z = np.full(n, self.intercept)
        text, at = present(data, offsets, self.hashes)
        z += np.bincount(text, self.weights[at], n)
        return np.round(1 / (1 + np.exp(-np.clip(z, -500, 500))), 6)


def present(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in ``hashes``) of the distinct chosen features of each text."""
    if not hashes.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = arrays.Words(data, offsets, arrays.ALNUM_LOWER)
    word, h = features(words)
    at = np.minimum(np.searchsorted(hashes, h), hashes.size - 1)
    hit = hashes[at] == h
    pair = np.unique(words.text_of()[word[hit]] * hashes.size + at[hit])
    return pair // hashes.size, pair % hashes.size


def feature_counts(rows: DataFrame, text: str, label: str) -> DataFrame:
    """f, pos, neg: labelled texts of each class with each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (arrays.Counter64(), arrays.Counter64())
        for batch in batches:
            for part, data, offsets in arrays.text_slices(batch, text):
                words = arrays.Words(data, offsets, arrays.ALNUM_LOWER)
                word, h = features(words)
                owner = words.text_of()[word]
                order = np.lexsort((h, owner))
                owner, h = owner[order], h[order]
                first = np.r_[True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])][: h.size]
                owner, h = owner[first], h[first]
                toxic = part.column(label).to_numpy(zero_copy_only=False) == 1
                for k in (0, 1):
                    for got in held[k].add(h[toxic[owner] == bool(k)]):
                        yield counted(k, *got)
        for k in (0, 1):
            for got in held[k].rest():
                yield counted(k, *got)

    def counted(k: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        none = np.zeros(counts.size, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts if k else none, pa.int64()), pa.array(none if k else counts, pa.int64())], ["f", "pos", "neg"])

    return rows.select(text, label).mapInArrow(run, "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def choose_features(counts: DataFrame, n_pos: int, n_neg: int, most: int) -> np.ndarray:
    """The features whose class shares differ most surely, and the identity terms'."""
    both = F.col("pos") + F.col("neg")
    share = n_pos / max(1, n_pos + n_neg)
    part = lambda n, e: F.when(n > 0, n * F.log(n / e)).otherwise(0.0)
    gain = part(F.col("pos"), both * share) + part(F.col("neg"), both * (1 - share))
    best = counts.where(both >= LEAST_ROWS).withColumn("gain", F.round(gain, 9)).where(F.col("gain") >= LEAST_GAIN).orderBy(F.desc("gain"), "f").limit(most)
    chosen = best.select("f").toArrow()["f"].to_numpy().view(np.uint64)
    terms = [word_features(t) for kind in IDENTITY_TERMS for t in kind]
    return np.unique(np.concatenate([chosen, *terms]))


def sample_rows(labelled: DataFrame, key: str, label: str, most: int, n_pos: int, n_neg: int) -> DataFrame:
    """About ``most`` rows of each class, by a hash of the key."""
    spot = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(F.when(F.col(label) == 1, spot < most / max(1, n_pos)).otherwise(spot < most / max(1, n_neg)))


def training_rows(sample: DataFrame, text: str, label: str, hashes: np.ndarray) -> pa.Table:
    """toxic, at (chosen features) per sampled text, and for each identity term
    in it kind, term and rest (the features without that term)."""
    terms = {int(arrays.ALNUM_LOWER.hash(t)): (k, i) for k, kind in enumerate(IDENTITY_TERMS) for i, t in enumerate(kind)}
    term_hashes = np.array(sorted(terms), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, data, offsets in arrays.text_slices(batch, text):
                labels = part.column(label).to_pylist()
                words = arrays.Words(data, offsets, arrays.ALNUM_LOWER)
                word, h = features(words)
                at = np.minimum(np.searchsorted(hashes, h), hashes.size - 1)
                hit = hashes[at] == h
                word, at = word[hit], at[hit]
                owner = words.text_of()
                text_at = owner[word]
                order = np.argsort(text_at, kind="stable")
                word, at, text_at = word[order], at[order], text_at[order]
                edge = np.searchsorted(text_at, np.arange(len(labels) + 1))
                named = np.flatnonzero(np.isin(words.hash, term_hashes))
                for d in range(len(labels)):
                    w, a = word[edge[d] : edge[d + 1]], at[edge[d] : edge[d + 1]]
                    swaps = []
                    for hash_ in np.unique(words.hash[named[owner[named] == d]]).tolist():
                        k, i = terms[hash_]
                        swaps.append({"kind": k, "term": i, "rest": np.unique(a[words.hash[w] != np.uint64(hash_)])})
                    out.append({"toxic": labels[d], "at": np.unique(a), "swaps": swaps})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("toxic", pa.int32()), ("at", pa.list_(pa.int32())), ("swaps", pa.list_(pa.struct([("kind", pa.int32()), ("term", pa.int32()), ("rest", pa.list_(pa.int32()))])))])
    return sample.select(text, F.col(label).cast("int").alias(label)).mapInArrow(run, "toxic int, at array<int>, swaps array<struct<kind:int,term:int,rest:array<int>>>").toArrow()


def _csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)


def swapped_pairs(table: list[dict], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(swap, feature, change) of every counterfactual of the sampled texts."""
    own = [[np.searchsorted(hashes, word_features(t)) for t in kind] for kind in IDENTITY_TERMS]
    row, column, sign, n = [], [], [], 0
    for r in table:
        for s in r["swaps"]:
            for i, other in enumerate(own[s["kind"]]):
                if i == s["term"]:
                    continue
                new = np.union1d(s["rest"], other).astype(np.int64)
                for c, v in ((np.setdiff1d(new, r["at"]), 1.0), (np.setdiff1d(r["at"], new), -1.0)):
                    row.append(np.full(c.size, n))
                    column.append(c)
                    sign.append(np.full(c.size, v))
                n += 1
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *row]).astype(np.int64), np.concatenate([empty, *column]).astype(np.int64), np.concatenate([np.zeros(0), *sign]), n


def fit(table: list[dict], hashes: np.ndarray, fairness: float = 5.0, l2: float = 1e-4, rounds: int = 400) -> Model:
    """Weights by accelerated gradient descent on the sampled rows."""
    y = np.array([r["toxic"] for r in table], np.float64)
    n, m = y.size, hashes.size
    if n == 0 or y.min() == y.max():
        return Model(hashes[:0], np.zeros(0), float(np.clip(y.mean() * 2 - 1, -1, 1)) * 5 if n else 0.0)
    row, col = _csr([np.array(r["at"], np.int64) for r in table])
    s_row, s_col, s_sign, swaps = swapped_pairs(table, hashes)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both classes count alike

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        z = np.bincount(row, w[col], n) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        out = np.bincount(col, g[row], m) + 2 * l2 * w
        if swaps:
            change = np.bincount(s_row, w[s_col] * s_sign, swaps)
            out += 2 * fairness / swaps * np.bincount(s_col, change[s_row] * s_sign, m)
        return out, g.sum()

    # curvature bound by power iteration, the intercept as one more feature
    v, c = np.ones(m), 1.0
    for _ in range(20):
        u = np.bincount(row, v[col], n) + c
        v, c = np.bincount(col, (weight * u / n)[row], m) * 0.25, float((weight * u / n).sum() * 0.25)
        top = np.sqrt((v**2).sum() + c**2)
        v, c = v / top, c / top
    swap_top = 0.0
    if swaps:
        x = np.ones(m)
        for _ in range(20):
            x = np.bincount(s_col, np.bincount(s_row, x[s_col] * s_sign, swaps)[s_row] * s_sign, m) + 1e-9
            size = np.sqrt((x**2).sum())
            x, swap_top = x / size, 2 * fairness / swaps * size
    step = 1 / (1.1 * top + 2 * l2 + 1.1 * swap_top)
    w, b, w_old, b_old = np.zeros(m), 0.0, np.zeros(m), 0.0
    for k in range(rounds):
        move = k / (k + 3)
        w_at, b_at = w + move * (w - w_old), b + move * (b - b_old)
        g, g_b = gradient(w_at, b_at)
        w_old, b_old = w, b
        w, b = w_at - step * g, b_at - step * g_b
    return Model(hashes, w, float(b))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE_ROWS, most: int = FEATURES, fairness: float = 5.0) -> Model:
    """Fit from the rows of ``docs`` that ``labels`` marks 0 or 1; with one class
    only, every text gets the same score.

    A key labelled twice counts as toxic if any of its labels is; null labels are
    left out.  Only the sampled keys, a bounded number, go to every task."""
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label"))
    sizes = {r["_label"]: r["count"] for r in marked.groupBy("_label").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    chosen = materialize(sample_rows(marked, "_key", "_label", sample, n_pos, n_neg), "labelled")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")
    rows = materialize(rows.select("_text", "_label"), "sample")
    got = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    hashes = choose_features(feature_counts(rows, "_text", "_label"), got.get(1, 0), got.get(0, 0), most)
    table = training_rows(rows, "_text", "_label", hashes).to_pylist()
    return fit(table, hashes, fairness)


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and score (0 to 1) of every whole text, in one scan.

    A null or empty text gets the score of a text without known features; repeated
    rows get a row each; an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in arrays.text_slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays([rows.column("_row"), pa.array(model.scores(data, offsets))], ["_row", "score"])

    source = docs.select(F.struct(*carry).alias("_row"), F.col(text).alias("_text"))
    return source.mapInArrow(run, arrays.output_schema(source, ["_row"], "score double")).select("_row.*", "score")
