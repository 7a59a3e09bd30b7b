"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point.  An
n-gram binds its letters: the vector of the letter k places before the last is
rotated by k places, and the rotated vectors are multiplied.  A document bundles
its n-grams, that is, adds their vectors; a language prototype adds the bundles
of its documents.  Bundles add up in any order, so training is one scan that
gives every task's partial prototypes and one small sum.  A document gets the
language whose prototype has the largest cosine.

Runs of other characters count as one blank, texts are framed by blanks, and
letters are taken in lower case.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import arrays

UNKNOWN = "und"
DIMENSIONS = 1024
N = 3
#: rows of the count matrix times n-grams held at once
CELLS = 500_000


@functools.cache
def _folded() -> np.ndarray:
    """Lower-case letter of each code point, a blank for all else."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letter_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """Rows of +1 and -1, a function of the code point alone."""
    place = np.arange((dimensions + 63) // 64, dtype=np.uint64)
    seed = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (place + np.uint64(1))[None, :] * np.uint64(0xD1B54A32D192ED03)
    bits = arrays.mix(arrays.mix(arrays.mix(seed)))
    return np.unpackbits(bits.view(np.uint8), axis=1)[:, :dimensions].astype(np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """Bound vectors of n-grams given as rows of code points."""
    letters, at = np.unique(grams, return_inverse=True)
    at = at.reshape(grams.shape)
    base = letter_vectors(letters, dimensions)
    out = base[at[:, -1]]
    for k in range(1, grams.shape[1]):
        out = out * np.roll(base, k, axis=1)[at[:, -1 - k]]
    return out


def gram_counts(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams as rows of code points, text index and n-gram index of every
    n-gram that occurs, whether each text has a letter)."""
    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if codes.size != chars[-1]:  # broken UTF-8: decode text by text
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        chars = np.r_[0, np.cumsum([len(t) for t in texts])]
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    # a blank before and behind every text
    size = np.diff(chars)
    text = np.repeat(np.arange(size.size), size + 2)
    framed = np.full(text.size, 32, np.uint32)
    framed[np.arange(codes.size) + np.repeat(2 * np.arange(size.size) + 1, size)] = _folded()[codes]
    keep = np.ones(framed.size, bool)
    keep[1:] = (framed[1:] != 32) | (framed[:-1] != 32) | (text[1:] != text[:-1])
    framed, text = framed[keep], text[keep]
    has_letter = np.bincount(text, framed != 32, size.size) > 0
    if framed.size < n:
        return np.zeros((0, n), np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), has_letter
    key = np.zeros(framed.size - n + 1, np.uint64)
    for k in range(n):
        key = (key << np.uint64(21)) | framed[k : framed.size - n + 1 + k].astype(np.uint64)
    inside = (text[: key.size] == text[n - 1 :]) & has_letter[text[: key.size]]
    code, distinct = pd.factorize(key[inside])
    shifts = np.uint64(21) * np.arange(n - 1, -1, -1, dtype=np.uint64)
    grams = ((distinct[:, None] >> shifts[None, :]) & np.uint64(0x1FFFFF)).astype(np.uint32)
    return grams, text[: key.size][inside], code, has_letter


def bundles(data: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(sum of n-gram vectors of each text, whether it has a letter)."""
    grams, text, code, has_letter = gram_counts(data, offsets)
    out = np.zeros((offsets.size - 1, dimensions), np.float32)
    if len(grams):
        vectors = gram_vectors(grams, dimensions).astype(np.float32)
        step = max(1, CELLS // len(grams))
        for lo in range(0, offsets.size - 1, step):
            hi = min(lo + step, offsets.size - 1)
            a, b = np.searchsorted(text, [lo, hi])
            counts = np.bincount((text[a:b] - lo) * len(grams) + code[a:b], minlength=(hi - lo) * len(grams))
            out[lo:hi] = counts.reshape(hi - lo, -1).astype(np.float32) @ vectors
    return out, has_letter


def prototypes(docs: DataFrame, text: str = "text", language: str = "lang", dimensions: int = DIMENSIONS) -> DataFrame:
    """One row per non-null language and dimension: lang, i, v, whole numbers in v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows, data, offsets in arrays.text_slices(batch, text):
                grams, of, code, _ = gram_counts(data, offsets)
                if not len(grams):
                    continue
                vectors = gram_vectors(grams, dimensions).astype(np.float64)
                kind, names = pd.factorize(np.array(rows.column(language).to_pylist(), object))
                for k, name in enumerate(names):
                    counts = np.bincount(code[kind[of] == k], minlength=len(grams)).astype(np.float64)
                    sums[name] = sums.get(name, 0) + counts @ vectors
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * v.size), pa.array(np.arange(v.size), pa.int32()), pa.array(v)], ["lang", "i", "v"])

    known = docs.where(F.col(language).isNotNull()).select(F.col(language).cast("string").alias(language), text)
    return known.mapInArrow(run, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))


def learn(docs: DataFrame, text: str = "text", language: str = "lang", dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Language names and unit prototypes, sorted by name: a few numbers per language."""
    table = prototypes(docs, text, language, dimensions).toPandas()
    names = sorted(table["lang"].unique())
    matrix = np.zeros((len(names), dimensions))
    matrix[np.searchsorted(names, table["lang"]), table["i"]] = table["v"]
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return names, (matrix / np.where(norm > 0, norm, 1)).astype(np.float32)


def closest(data: np.ndarray, offsets: np.ndarray, model: tuple[list[str], np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Predicted language and cosine of each text."""
    names, unit = model
    own, has_letter = bundles(data, offsets, unit.shape[1])
    if not names:
        return [UNKNOWN] * (offsets.size - 1), np.zeros(offsets.size - 1)
    norm = np.linalg.norm(own, axis=1)
    cosine = (own @ unit.T) / np.where(norm > 0, norm, 1)[:, None]
    best = cosine.argmax(1)
    predicted = [names[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), has_letter.tolist(), strict=True)]
    score = np.clip(cosine[np.arange(best.size), best], 0, 1)
    return predicted, np.where(has_letter, np.round(score.astype(np.float64), 6), 0.0)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", carry: list[str] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, lang_pred and score (cosine, 0 to 1) per row.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned; of equal cosines the first name wins; repeated rows get a row each;
    an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in arrays.text_slices(batch, "_text"):
                predicted, score = closest(data, offsets, model)
                yield pa.RecordBatch.from_arrays([rows.column("_row"), pa.array(predicted, pa.string()), pa.array(score)], ["_row", "lang_pred", "score"])

    source = docs.select(F.struct(*carry).alias("_row"), F.col(text).alias("_text"))
    return source.mapInArrow(run, arrays.output_schema(source, ["_row"], "lang_pred string, score double")).select("_row.*", "lang_pred", "score")


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], least_score: float, text: str = "text", language: str = "lang") -> DataFrame:
    """The rows of ``docs`` with a known language and at least this cosine.

    ``language`` holds the language found in the text, whatever stood there, null
    included; the other columns are unchanged.  Null texts, texts without letters
    and, if nothing was learned, all rows go; repeated rows are judged each; of equal
    cosines the first name wins; an empty table gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in arrays.text_slices(batch, "_text"):
                predicted, score = closest(data, offsets, model)
                good = pa.array((np.array(predicted, object) != UNKNOWN) & (score >= least_score))
                row = rows.column("_row").filter(good)
                parts, at = row.flatten(), row.type.get_field_index(language)
                parts[at] = pa.array(predicted, pa.string()).filter(good).cast(row.type.field(at).type)
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(parts, fields=list(row.type))], ["_row"])

    source = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    return source.mapInArrow(run, arrays.output_schema(source, ["_row"])).select("_row.*")
