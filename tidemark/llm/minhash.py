"""Near-duplicates by consistent weighted sampling over TF-IDF shingles.

* Shingles are runs of five words; shorter texts are one shingle.  A shingle's
  weight is its count in the text times its idf.  Document frequencies are exact
  over all documents: a table of 2**18 bucket counts, summed over all tasks,
  bounds every frequency from above, so only shingles in full buckets need an
  exact count.  A shingle is common from ``total / COMMON`` documents on, so at
  most ``COMMON`` shingles can be; that small table goes to every task, all other
  shingles share the idf of that limit.  idf runs from 1 (in every document) to
  1 + ``SPAN``: with a wider span a small edit of a text with thousands of copies
  would outweigh all that the copies share.
* Equal word sequences form one class without sampling, whatever their number.
* One text of each class gets ``bands * rows`` improved consistent weighted
  samples: for shingle k of weight w, with r, c drawn from Gamma(2, 1) and b from
  U(0, 1) by the hash of k, t = floor(ln w / r + b), y = exp(r (t - b)),
  a = c / (y exp(r)); the sample is (k, t) of the smallest a.  Two texts agree
  in a sample with their weighted Jaccard similarity as probability.
* Texts that agree in all samples of a band are candidates, verified by their
  exact weighted Jaccard similarity.  In a band bucket each text is first
  compared only with the bucket's head, the text with most bucket neighbours (the
  original of a family of edited copies has most); texts so joined need no further
  comparison among each other, since classes are connected components.
* What is left are pairs of one bucket in different components.  The weight that
  a text shares with no other text left bounds its overlap with all of them:
  similarity s needs an overlap of s / (1 + s) of both weights together.  Texts
  and pairs that cannot reach it are dropped, the rest is compared in full.  So a
  family of n edited copies costs about n comparisons, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import arrays
from tidemark.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 8, 3
COMMON = 200_000
SPAN = 0.5
_BUCKET_BITS = 18


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of the distinct shingles of each text, by text."""
    text, h = arrays.windows(arrays.Words(data, offsets, arrays.SPACED), SHINGLE, short=True)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])][: text.size])
    return text[first], h[first], np.diff(np.r_[first, text.size])


class Weights:
    """Shingle weights: count times idf; ``common`` holds the frequent shingles."""

    def __init__(self, documents: int, limit: float, common: np.ndarray, df: np.ndarray):
        self.scale = SPAN / max(np.log(max(documents, 2)), 1e-9)
        self.documents = max(documents, 2)
        order = np.argsort(common)
        self.common, self.idf = common[order], self._idf(df[order].astype(np.float64))
        self.rare = float(self._idf(np.array([max(limit, 1.0)]))[0])

    def _idf(self, df: np.ndarray) -> np.ndarray:
        return 1 + self.scale * np.log(np.maximum(self.documents / df, 1))

    def of(self, h: np.ndarray, count: np.ndarray) -> np.ndarray:
        idf = np.full(h.size, self.rare)
        if self.common.size:
            at = np.minimum(np.searchsorted(self.common, h), self.common.size - 1)
            hit = self.common[at] == h
            idf[hit] = self.idf[at[hit]]
        return count * idf


def weigh(docs: DataFrame, text: str) -> Weights:
    """Exact document frequencies of all shingles that can be common."""

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n, total = np.zeros(1 << _BUCKET_BITS, np.int64), 0, 0
        for batch in batches:
            for rows, data, offsets in arrays.text_slices(batch, text):
                _, h, _ = shingles(data, offsets)
                table += np.bincount((h >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64), minlength=table.size)
                n, total = n + rows.num_rows, total + h.size
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1, -2], pa.int32()), pa.array(np.r_[table[used], n, total])], ["bucket", "n"])

    source = docs.select(text)
    counts = source.mapInArrow(bucketed, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    sums = dict(zip(counts["bucket"].tolist(), counts["n"].tolist(), strict=True))
    documents, total = sums.pop(-1, 0), sums.pop(-2, 0)
    limit = max(2.0, total / COMMON)
    full = np.zeros(1 << _BUCKET_BITS, bool)
    full[[b for b, n in sums.items() if n >= limit]] = True

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = arrays.Counter64()
        for batch in batches:
            for _, data, offsets in arrays.text_slices(batch, text):
                _, h, _ = shingles(data, offsets)
                for part in held.add(h[full[(h >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)]]):
                    yield _pairs(*part)
        for part in held.rest():
            yield _pairs(*part)

    common = source.mapInArrow(candidates, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= limit).toPandas()
    return Weights(documents, limit, common["h"].to_numpy(np.int64).view(np.uint64), common["n"].to_numpy(np.int64))


def _pairs(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["h", "n"])


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 65,536 equal steps."""
    p = (np.arange(65_536) + 0.5) / 65_536
    x = np.sqrt(2 * p) + p  # Newton from a rough start; F(x) = 1 - (1 + x) exp(-x)
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300) * 0.8, 1e-9)
    return x


_GAMMA = _gamma_quantiles().astype(np.float32)
_LOG_GAMMA = np.log(_GAMMA)
_LOW16 = np.uint64(0xFFFF)


def samples(h: np.ndarray, weight: np.ndarray, ptr: np.ndarray, count: int) -> np.ndarray:
    """Consistent weighted samples: row d, column i is sample i of the elements
    ptr[d] to ptr[d + 1], of which there is at least one."""
    out = np.zeros((ptr.size - 1, count), np.uint64)
    log_w = np.log(weight).astype(np.float32)
    segment = np.repeat(np.arange(ptr.size - 1), np.diff(ptr))
    for i in range(count):
        u = arrays.mix(arrays.mix(h + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)))
        r = _GAMMA[(u & _LOW16).astype(np.int64)]
        log_c = _LOG_GAMMA[((u >> np.uint64(16)) & _LOW16).astype(np.int64)]
        b = ((u >> np.uint64(32)) & _LOW16).astype(np.float32) / np.float32(65_536)
        t = np.floor(log_w / r + b)
        log_a = log_c - r * (t - b) - r
        least = np.minimum.reduceat(log_a, ptr[:-1])
        # ties go to the smaller hash
        at = np.flatnonzero(log_a == least[segment])
        at = at[np.lexsort((h[at], segment[at]))]
        at = at[np.r_[True, segment[at][1:] != segment[at][:-1]]]
        out[:, i] = arrays.mix(h[at] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return out


def signed(docs: DataFrame, files: dict[str, int], text: str, carry: str, weights: Weights) -> DataFrame:
    """rid, carry, hash pair of the word sequence, weight and band keys of each
    row; all null but the first two without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in arrays.text_slices(batch, text):
                n = rows.num_rows
                words = arrays.Words(data, offsets, arrays.SPACED)
                none = words.counts() == 0
                place = np.arange(words.hash.size) - np.repeat(words.ptr[:-1], words.counts())
                power, _ = arrays._powers(place.size + 1)
                sums = [np.r_[np.uint64(0), np.cumsum(arrays.mix(words.hash + np.uint64(k)) * power[place])][words.ptr] for k in (0, 1)]
                same = [pa.array(arrays.mix(s[1:] - s[:-1]).view(np.int64), mask=none) for s in sums]
                of, h, count = shingles(data, offsets)
                weight = weights.of(h, count)
                keys = np.zeros((n, BANDS), np.uint64)
                if h.size:
                    drawn = samples(h, weight, np.r_[np.searchsorted(of, np.flatnonzero(~none)), of.size], BANDS * ROWS)
                    key = np.zeros((len(drawn), BANDS), np.uint64)
                    for k in range(ROWS):
                        key = arrays.mix(key * np.uint64(0xE7037ED1A0B428DB) + drawn[:, k::ROWS])
                    keys[~none] = key
                lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(arrays.stored_ids(rows, files)), rows.column(carry), *same, pa.array(np.bincount(of, weight, n)), lists], ["rid", carry, "h1", "h2", "weight", "keys"])

    return docs.select(carry, text, "_file", "_row").mapInArrow(run, f"rid long, `{carry}` {docs.schema[carry].dataType.simpleString()}, h1 long, h2 long, weight double, keys array<long>")


_FILTER_BITS = 24


def _spot(rid: np.ndarray) -> np.ndarray:
    return (arrays.mix(rid.view(np.uint64) + np.uint64(1)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def _bitmap(rids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size in which the bit of every rid is set."""

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << _FILTER_BITS, bool)
        for batch in batches:
            bits[_spot(batch.column("rid").to_numpy())] = True
        packed = np.packbits(bits, bitorder="little").view(np.int64)
        used = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed[used])], ["word", "bits"])

    words = rids.select("rid").mapInArrow(spots, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (_FILTER_BITS - 6), np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table


def _marked(docs: DataFrame, files: dict[str, int], table: np.ndarray, marked: bool) -> DataFrame:
    """rid and the columns of the ``placed`` rows whose bit is set, or of those where it is not."""
    kept = [c for c in docs.columns if c not in ("_file", "_row")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(table.view(np.uint8), bitorder="little").view(bool)
        for batch in batches:
            rid = arrays.stored_ids(batch, files)
            yield pa.RecordBatch.from_arrays([pa.array(rid), *(batch.column(c) for c in kept)], ["rid", *kept]).filter(pa.array(bits[_spot(rid)] == marked))

    schema = arrays.output_schema(docs, kept)
    return docs.mapInArrow(run, T.StructType([T.StructField("rid", T.LongType()), *schema.fields]))


def texts_of(docs: DataFrame, files: dict[str, int], text: str, wanted: DataFrame) -> DataFrame:
    """rid and text of the rows whose rid is in ``wanted`` (one column, distinct).

    The bitmap keeps most other texts out of the shuffle; with more rids than it
    can tell apart it only saves less."""
    return _marked(docs.select(F.col(text).alias("text"), "_file", "_row"), files, _bitmap(wanted), True).join(wanted.hint("merge"), "rid", "left_semi")


def lone_weights(texts: DataFrame, weights: Weights) -> DataFrame:
    """rid, lone: weight of the shingles that no other of these texts has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in arrays.text_slices(batch, "text"):
                of, h, count = shingles(data, offsets)
                w, rid = weights.of(h, count), rows.column("rid").to_numpy()[of]
                order = np.argsort(h, kind="stable")
                h, w, rid = h[order], w[order], rid[order]
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: h.size])
                n = np.diff(np.r_[first, h.size])
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(rid[first]), pa.array(w[first]), pa.array(n, pa.int64())], ["h", "rid", "w", "n"])

    found = texts.select("rid", "text").mapInArrow(run, "h long, rid long, w double, n long")
    alone = found.groupBy("h").agg(F.sum("n").alias("n"), F.min("rid").alias("rid"), F.sum("w").alias("w")).where("n = 1")
    return alone.groupBy("rid").agg(F.sum("w").alias("lone"))


def similarities(pairs: DataFrame, weights: Weights) -> DataFrame:
    """a, b, similarity of pairs given with both texts (text_a, text_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in arrays.text_slices(batch, "text_a"):
                other, other_offsets = arrays.text_buffers(rows.column("text_b"))
                ta, ha, ca = shingles(data, offsets)
                tb, hb, cb = shingles(other, other_offsets)
                n = rows.num_rows
                wa, wb = weights.of(ha, ca), weights.of(hb, cb)
                total = np.bincount(ta, wa, n) + np.bincount(tb, wb, n)
                text, h, w = np.r_[ta, tb], np.r_[ha, hb], np.r_[wa, wb]
                order = np.lexsort((h, text))
                text, h, w = text[order], h[order], w[order]
                twice = np.flatnonzero((text[1:] == text[:-1]) & (h[1:] == h[:-1]))
                shared = np.bincount(text[twice], np.minimum(w[twice], w[twice + 1]), n)
                yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(shared / np.maximum(total - shared, 1e-300))], ["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """v, root: the smallest vertex of each vertex's component (edges a, b).

    Alternates large-star and small-star; each round's edges are a stored table,
    and rounds grow with the logarithm of the longest chain."""
    current = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        current = materialize(small, "edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return current.select(F.col("u").alias("v"), F.col("v").alias("root")).groupBy("v").agg(F.min("root").alias("root"))
        before = state


def _verified(pairs: DataFrame, texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough, stored."""
    left = pairs.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    both = left.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return materialize(similarities(both, weights).where(F.col("similarity") >= similarity), "links").select("a", "b")


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """rid, key, class_rid, kept per row of a stored table.

    ``class_rid`` is the smallest rid of the row's class, ``kept`` says whether
    the row is that one.  Rows with equal word sequences are one class; null texts
    and texts without words are classes of their own; an empty table gives no
    row.  rid numbers rows by file and place, which are the same in every job of a
    run, however its scans are split; what is no stored table is stored first."""
    docs = arrays.stored(docs)
    files = arrays.file_numbers(docs)
    narrow = arrays.placed(docs, F.col(key).alias("_key"), F.col(text).alias("text"))
    weights = weigh(narrow, "text")
    rows = materialize(signed(narrow, files, "text", "_key", weights), "rows")
    first = materialize(rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("rid").alias("rid")), "distinct")
    single = first.select("rid").join(rows.select("rid", "weight", "keys"), "rid")
    bands = materialize(single.select("rid", "weight", "keys", F.posexplode("keys").alias("band", "key")), "bands")
    full = bands.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(bands.join(full, ["band", "key"]), "members")
    degree = members.groupBy("rid").agg(F.sum("n").alias("degree"))
    ranked = materialize(members.join(degree, "rid"), "ranked")
    heads = ranked.groupBy("band", "key").agg(F.max_by("rid", F.struct("degree", -F.col("rid"))).alias("head"))
    headed = ranked.join(materialize(heads, "heads"), ["band", "key"]).where("rid <> head")
    pairs = materialize(headed.select(F.least("head", "rid").alias("a"), F.greatest("head", "rid").alias("b")).distinct(), "pairs")
    texts = materialize(texts_of(narrow, files, "text", materialize(members.select("rid").distinct(), "wanted")), "texts")
    links = _verified(pairs, texts, weights, similarity)
    label = materialize(components(links), "roots")
    more = _left_open(members, label, texts, weights, similarity).join(pairs, ["a", "b"], "left_anti")
    more = materialize(more, "pairs")
    if not more.isEmpty():
        links = materialize(links.unionByName(_verified(more, texts, weights, similarity)), "links")
        label = materialize(components(links), "roots")
    # a class is named by its first row
    of_first = first.join(label, first["rid"] == label["v"], "left").select("h1", "h2", F.coalesce("root", "rid").alias("class"))
    out = rows.select("rid", "_key", "h1", "h2").join(materialize(of_first, "named"), ["h1", "h2"], "left").withColumn("class", F.coalesce("class", "rid"))
    return out.select("rid", F.col("_key").alias(key), F.col("class").alias("class_rid"), (F.col("rid") == F.col("class")).alias("kept"))


def _left_open(members: DataFrame, label: DataFrame, texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """Pairs (a, b) of one bucket in different components that may be similar."""
    rooted = members.join(label, members["rid"] == label["v"], "left").select("band", "key", "rid", "weight", "keys", F.coalesce("root", "rid").alias("root"))
    rooted = materialize(rooted, "rooted")
    mixed = materialize(rooted.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("weight").alias("least")).where("lo < hi"), "mixed")
    open_ = materialize(rooted.join(mixed.select("band", "key", "least"), ["band", "key"]), "open")
    wanted = materialize(open_.select("rid").distinct(), "wanted")
    lone = materialize(lone_weights(texts.join(wanted.hint("merge"), "rid", "left_semi"), weights), "lone")
    # shared weight, and the share of both weights that an overlap must reach
    share = F.lit(similarity / (1 + similarity) - 1e-9)
    shared = open_.join(lone, "rid", "left").withColumn("shared", F.col("weight") - F.coalesce("lone", F.lit(0.0)) + 1e-6)
    able = shared.where(F.col("shared") >= share * (F.col("weight") + F.col("least")))
    able = materialize(able.select("band", "key", "rid", "root", "weight", "shared", "keys"), "able")
    left, right = (able.select("band", "key", *(F.col(c).alias(f"{c}_{x}") for c in ("rid", "root", "weight", "shared", "keys"))) for x in ("a", "b"))
    both = left.join(right, ["band", "key"]).where("rid_a < rid_b and root_a <> root_b")
    reach = F.least("shared_a", "shared_b") >= share * (F.col("weight_a") + F.col("weight_b"))
    # a pair that agrees in several bands is made in the first of them
    sooner = F.exists(F.zip_with(F.slice("keys_a", F.lit(1), F.col("band")), F.slice("keys_b", F.lit(1), F.col("band")), lambda x, y: x == y), lambda x: x)
    return both.where(reach & ~sooner).select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """key, class_id (key of the class's first row), class_size, kept per row."""
    found = materialize(classes(docs, text, key, similarity), "classes")
    sizes = found.groupBy("class_rid").agg(F.count("*").alias("class_size"), F.min(F.when(F.col("kept"), F.col(key))).alias("class_id"))
    return found.join(materialize(sizes, "sizes"), "class_rid").select(key, "class_id", "class_size", "kept")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, unchanged, without all but one of each class."""
    docs = arrays.stored(docs)
    gone = materialize(classes(docs, text, key, similarity).where("not kept").select("rid"), "gone")
    source, files, table = arrays.placed(docs, F.struct("*").alias("_all")), arrays.file_numbers(docs), _bitmap(gone)
    # rows whose bit is not set stay for sure and need no shuffle
    unsure = _marked(source, files, table, True).join(gone.hint("merge"), "rid", "left_anti")
    return _marked(source, files, table, False).unionByName(unsure).select("_all.*")
