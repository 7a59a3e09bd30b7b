"""Quality rules with thresholds that follow the data.

Fixed cut-offs reject what is usual for a language or a source.  Here the rates
of every document (characters per word, symbols, repeated lines and words per
thousand) go into quantile sketches per language and source: counts of log-linear
buckets, 32 per power of two, so a quantile is off by a thirty-second at most.
Sketches merge by adding counts, in any order, on any number of machines, and
the sketches of a language or of everything are sums of the finer ones.  A rate
beyond ``reach`` interquartile ranges from the quartiles is an outlier of its
own group; groups with fewer than ``least`` documents use their language's
sketch, then the one of all.  The fences are joined back to filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import arrays
from tidemark.session import materialize

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: rate -> (smallest interquartile range assumed, whether small values count too)
RATES = {"chars_per_word_x100": (60, True), "symbols_x1000": (25, False), "dup_lines_x1000": (100, False), "repeats_x1000": (60, False)}
SYMBOLS = "#*$%&|<>"
GROUPS_TO_BROADCAST = 100_000

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags)][offsets])


def _keyed(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One value for a hash within its text."""
    return arrays.mix(h + text.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def measures(data: np.ndarray, offsets: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """Counts per text, see ``BASE``, and n_lines: lines with a word."""
    words = arrays.Words(data, offsets, arrays.SPACED)
    in_word = arrays.SPACED.word[data]
    n = offsets.size - 1
    # lines, as the stretches between line feeds and text ends
    feed = np.flatnonzero(data == 10)
    start = np.unique(np.r_[offsets[:-1], feed + 1])
    start = start[start < data.size]
    stop = np.minimum(np.r_[start[1:], data.size], np.r_[feed, data.size][np.searchsorted(feed, start)])
    upto = np.r_[0, np.cumsum(in_word)]
    worded = upto[stop] > upto[start]
    start, stop = start[worded], stop[worded]
    line_of = np.searchsorted(offsets, start, "right") - 1
    line = (words._sums[stop] - words._sums[start]) * words._inverse[start] + (stop - start).astype(np.uint64)
    first = np.unique(_keyed(line_of, arrays.mix(line)), return_index=True)[1]
    n_lines = np.bincount(line_of, minlength=n)
    # words covered by windows that occur twice or more in their text
    text, h = arrays.windows(words, window)
    _, inverse, times = np.unique(_keyed(text, h), return_inverse=True, return_counts=True)
    per = np.maximum(words.counts() - window + 1, 0)
    at = np.arange(text.size) - np.repeat(np.cumsum(per) - per, per) + words.ptr[:-1][text]
    at = at[times[inverse] > 1]
    edge = np.zeros(words.start.size + window + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    covered = np.cumsum(edge)[: words.start.size] > 0
    return {
        "n_words": words.counts(), "word_chars": _per_text(in_word & ((data & 0xC0) != 0x80), offsets), "n_symbols": _per_text(_IS_SYMBOL[data], offsets),
        "n_dup_lines": n_lines - np.bincount(line_of[first], minlength=n), "n_repeat_words": np.diff(np.r_[0, np.cumsum(covered)][words.ptr]), "n_lines": n_lines,
    }


def measured(docs: DataFrame, text: str, kept: list[str]) -> DataFrame:
    """``kept`` columns and the counts of each row, one scan."""
    names = [*BASE, "n_lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in arrays.text_slices(batch, text):
                counts = measures(data, offsets)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *(pa.array(counts[n], pa.int64()) for n in names)], [*kept, *names])

    schema = arrays.output_schema(docs, kept, ", ".join(f"{n} long" for n in names))
    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def rates() -> dict[str, Column]:
    """Whole-numbered rates, so that buckets are the same everywhere."""
    per = lambda a, b, k: F.when(F.col(b) > 0, F.floor(F.col(a) * k / F.col(b))).otherwise(0)
    return {
        "chars_per_word_x100": per("word_chars", "n_words", 100), "symbols_x1000": per("n_symbols", "n_words", 1000),
        "dup_lines_x1000": per("n_dup_lines", "n_lines", 1000), "repeats_x1000": per("n_repeat_words", "n_words", 1000),
    }


def bucket(x: str) -> str:
    """SQL of the log-linear bucket of a whole number of 0 or more."""
    return f"case when {x} < 64 then {x} else (length(bin({x})) - 6) * 32 + shiftright({x}, length(bin({x})) - 6) end"


def bucket_floor(b: str) -> str:
    """SQL of the smallest number in a bucket."""
    return f"case when {b} < 64 then {b} else shiftleft({b} - 32 * ({b} div 32 - 1), cast({b} div 32 - 1 as int)) end"


def sketches(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Mergeable sketches: groups, rate, bucket, n."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), c.cast("long").alias("x")) for k, c in rates().items())))
    long = rows.select(*groups, pairs.alias("p")).select(*groups, "p.rate", "p.x")
    return long.groupBy(*groups, "rate", F.expr(bucket("x")).alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, language: str, source: str, reach: float, least: int) -> DataFrame:
    """One row per language and source: ``limits``, a map of rate to low and high."""
    # sketches of a language and of everything: sums of the finer ones
    levels = None
    for level, keys in enumerate(([language, source], [language], [])):
        part = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
        part = part.select(F.lit(level).alias("level"), *(F.col(c) if c in keys else F.lit(None).cast(sketch.schema[c].dataType).alias(c) for c in (language, source)), "rate", "bucket", "n")
        levels = part if levels is None else levels.unionByName(part)
    group = ["level", language, source, "rate"]
    running = Window.partitionBy(*group).orderBy("bucket")
    counted = levels.select("*", F.sum("n").over(running).alias("upto"), F.sum("n").over(Window.partitionBy(*group)).alias("total"))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), F.col("bucket")))
    quartiles = counted.groupBy(*group).agg(at(0.25).alias("b1"), at(0.75).alias("b3"), F.max("total").alias("total"))
    floor = F.create_map(*(x for k, (v, _) in RATES.items() for x in (F.lit(k), F.lit(v))))
    both = F.create_map(*(x for k, (_, v) in RATES.items() for x in (F.lit(k), F.lit(v))))
    q = quartiles.select("*", F.expr(bucket_floor("b1")).alias("q1"), F.expr(bucket_floor("b3")).alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), floor[F.col("rate")]) * F.lit(reach)
    limit = F.struct(F.when(both[F.col("rate")], F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))
    limits = q.groupBy("level", language, source).agg(F.map_from_entries(F.collect_list(F.struct("rate", limit))).alias("limits"), F.max("total").alias("total"))
    own = limits.where("level = 0")
    by_language = limits.where("level = 1").select(F.col(language).alias("_l"), F.col("limits").alias("_ll"), F.col("total").alias("_lt"))
    by_all = limits.where("level = 2").select(F.lit(0).alias("_one"), F.col("limits").alias("_al"))
    chosen = own.withColumn("_one", F.lit(0)).join(by_language, F.col(language).eqNullSafe(F.col("_l"))).join(F.broadcast(by_all), "_one")  # one row
    pick = F.when(F.col("total") >= least, F.col("limits")).when(F.col("_lt") >= least, F.col("_ll")).otherwise(F.col("_al"))
    return chosen.select(language, source, pick.alias("limits"))


def outlier() -> Column:
    """Whether a rate lies beyond its fences; a row without fences has none."""
    beyond = F.lit(False)
    for k, c in rates().items():
        limit = F.col("limits")[k]
        beyond = beyond | F.coalesce(c < limit["low"], F.lit(False)) | F.coalesce(c > limit["high"], F.lit(False))
    return beyond


def judge(docs: DataFrame, text: str = "text", language: str = "lang", source: str = "source", carry: list[str] = ("doc_id",), reach: float = 6.0, least: int = 200) -> DataFrame:
    """``carry`` columns, the counts in ``BASE``, base_failed and kept per row.

    Base rules: fewer than 20 words, or over 30 % of words in repeated windows of
    eight.  The others are kept unless a rate lies beyond the fences of its
    language and source.  Null and empty texts have no words and fail; null
    languages and sources are groups of their own; repeated rows count each; an
    empty table gives no row.  The counts are stored once in the scratch folder;
    texts are read once and not shuffled."""
    keys = docs.select(F.struct(*carry).alias("_row"), F.col(language).alias("_lang"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    rows = materialize(measured(keys, "_text", ["_row", "_lang", "_source"]), "quality")
    return _verdict(rows, rows, reach, least).select("_row.*", *BASE, "base_failed", "kept")


def keep_good(docs: DataFrame, text: str = "text", language: str = "lang", source: str = "source", reach: float = 6.0, least: int = 200) -> DataFrame:
    """The rows of ``docs``, unchanged, that ``judge`` would keep.

    Texts are read twice, once for the sketches and once for the filter, and
    never shuffled or stored between."""
    keys = docs.select(F.struct("*").alias("_row"), F.col(language).alias("_lang"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    narrow = measured(keys.drop("_row"), "_text", ["_lang", "_source"])
    rows = measured(keys, "_text", ["_row", "_lang", "_source"])
    return _verdict(rows, narrow, reach, least).where("kept").select("_row.*")


def _verdict(rows: DataFrame, basis: DataFrame, reach: float, least: int) -> DataFrame:
    sketch = sketches(basis.where(~base_failed()), ["_lang", "_source"])
    limits = materialize(fences(materialize(sketch, "sketches"), "_lang", "_source", reach, least), "fences")
    groups = limits.select(F.col("_lang").alias("_l"), F.col("_source").alias("_s"), "limits")
    # few groups go to every task; with many, Spark joins and splits hot ones
    if limits.count() <= GROUPS_TO_BROADCAST:
        groups = F.broadcast(groups)
    joined = rows.join(groups, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~outlier())
