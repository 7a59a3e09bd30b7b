"""Token counts of flat, unindexed token files by a separator scan.

A flat file is nothing but ids of fixed width, each document closed by an
end-of-document id.  Every file is read as blocks; one vectorised comparison
finds the separators of a block.  A block knows all its documents but the first,
which may have begun in an earlier block: a prefix scan over the blocks of a
file (the last separator so far, the documents so far) stitches them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import encoded_slices, encoder
from tidemark.session import materialize

BLOCK_TOKENS = 1 << 20


def write_flat(docs: DataFrame, vocabulary: str, path: str, separator: int, text: str = "text", width: int = 2) -> None:
    """Write the ids of every whole text, little-endian, each text closed by the
    separator, one file per partition, in row order.

    Added tokens that stand in a text are ordinary text here, so no document
    holds the separator.  Spark's text writer puts the separator as line end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, added=False)
        for batch in batches:
            for _, ids, ptr in encoded_slices(enc, batch, text):
                data = ids.astype(f"<u{width}").tobytes()
                upto = (ptr * width).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.large_binary(), len(ptr) - 1, [None, pa.py_buffer(upto.tobytes()), pa.py_buffer(data)]).cast(pa.binary())], ["ids"])

    mark = separator.to_bytes(width, "little").decode("latin-1")
    ids = docs.select(text).mapInArrow(run, "ids binary")
    ids.select(F.col("ids").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", mark).text(path)


def scan_flat(spark: SparkSession, path: str, separator: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document of the files below ``path``: file, ordinal (from 0 in
    the file), start (tokens before it in the file, separators included),
    n_tokens (without its separator), closed.

    Two separators in a row hold a document of no token.  Tokens behind the last
    separator are a document that is not closed; an empty file has none.  A file
    of more than Spark's 2 GB limit for binary files is an error, never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_buffer()
                if raw.size % width:
                    raise ValueError(f"{name}: {raw.size} bytes are no whole number of tokens")
                tokens = np.frombuffer(raw, f"<u{width}")
                rows = []
                for base in range(0, tokens.size, block_tokens):
                    found = np.flatnonzero(tokens[base : base + block_tokens] == separator) + base
                    rows.append({
                        "file": name, "block": base // block_tokens, "stop": min(base + block_tokens, tokens.size), "separators": found.size,
                        "first": int(found[0]) if found.size else None, "last": int(found[-1]) if found.size else None,
                        "starts": found[:-1] + 1, "sizes": np.diff(found) - 1,
                    })
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    fields = [("file", pa.string()), ("block", pa.int64()), ("stop", pa.int64()), ("separators", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("starts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
    schema = pa.schema(fields)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!._]*").load(path).select("path", "content")
    blocks = files.mapInArrow(run, "file string, block long, stop long, separators long, first long, last long, starts array<long>, sizes array<long>")
    # a file has 1,000 blocks at most, so each window is small whatever the input
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    stitched = blocks.select(
        "*",
        F.coalesce(F.last("last", ignorenulls=True).over(before) + 1, F.lit(0)).alias("begun"),
        F.coalesce(F.sum("separators").over(before), F.lit(0)).alias("earlier"),
        (F.max("block").over(whole) == F.col("block")).alias("is_last"),
    )
    one = lambda start, n, closed: F.struct(start.alias("start"), n.alias("n_tokens"), F.lit(closed).alias("closed"))
    none = F.lit([]).cast("array<struct<start:bigint,n_tokens:bigint,closed:boolean>>")
    head = F.when(F.col("separators") > 0, F.array(one(F.col("begun"), F.col("first") - F.col("begun"), True))).otherwise(none)
    inner = F.zip_with("starts", "sizes", lambda s, n: one(s, n, True))
    tail_start = F.coalesce(F.col("last") + 1, F.col("begun"))
    tail = F.when(F.col("is_last") & (tail_start < F.col("stop")), F.array(one(tail_start, F.col("stop") - tail_start, False))).otherwise(none)
    docs = stitched.select("file", "earlier", F.posexplode(F.concat(head, inner, tail)).alias("i", "doc"))
    return docs.select("file", (F.col("earlier") + F.col("i")).alias("ordinal"), "doc.start", "doc.n_tokens", "doc.closed")


def count_documents(docs: DataFrame, vocabulary: str, path: str, separator: int, text: str = "text", key: str = "doc_id", width: int = 2) -> DataFrame:
    """Write ``docs`` as flat files below ``path``, scan them, and give each
    count the key of its row: key, part, ordinal, start, n_tokens.

    Files hold no keys.  Row r of partition p of a stored table is document r of
    file p, which a second, narrow scan of the key column numbers and stores.  Both
    scans are split alike, whatever executors come or go between them.  A document
    without its row, or a row without its document, stops the job.  Null and
    empty texts count 0 tokens; rows that repeat count each; an empty table gives
    no row."""
    kind = docs.schema[key].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part), pa.int64()), pa.array(np.arange(at, at + n), pa.int64())], [key, "part", "ordinal"])
            at += n

    with _same_splits(docs.sparkSession):
        write_flat(docs, vocabulary, path, separator, text, width)
        keys = materialize(docs.select(key, text).select(key).mapInArrow(number, f"`{key}` {kind}, part long, ordinal long"), "keys").withColumn("_row", F.lit(True))
    counts = scan_flat(docs.sparkSession, path, separator, width).withColumn("part", F.regexp_extract("file", r"part-(\d+)", 1).cast("long")).drop("file")
    both = counts.join(keys, ["part", "ordinal"], "full_outer")
    whole = F.col("_row").isNotNull() & F.coalesce("closed", F.lit(False))
    # a condition of the rows, which no selection of columns takes away
    return both.where(F.when(whole, True).otherwise(F.raise_error(F.lit("flat files and rows differ")).cast("boolean"))).select(key, "part", "ordinal", "start", "n_tokens")


@contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """Scans within are split for one number of cores, also if executors are lost or join."""
    name = "spark.sql.files.minPartitionNum"
    own = spark.conf.get(name, None)
    if own is None:
        spark.conf.set(name, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(name)
