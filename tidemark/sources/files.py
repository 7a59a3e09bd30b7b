"""Table catalog, file sinks, load jobs, inventories and the sample-and-export job."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.sampling import sample
from tidemark.session import path_exists

CODECS = ("snappy", "gzip", "zstd", "lz4", "none")


def list_tables(spark: SparkSession, root: str) -> list[str]:
    """Directory entries that hold Parquet data; names starting with ``_`` are hidden."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    entries = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = (s.getPath().getName() for s in entries)
    return sorted(n.removesuffix(".parquet") for n in names if not n.startswith(("_", ".")))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    path = f"{root.rstrip('/')}/{name}"
    return spark.read.parquet(f"{path}.parquet" if path_exists(spark, f"{path}.parquet") else path)


def read_delta(spark: SparkSession, path: str) -> DataFrame:
    """Delta scan; needs the Delta package on the class path."""
    return spark.read.format("delta").load(path)


def register_tables(spark: SparkSession, root: str, names: Sequence[str] | None = None) -> list[str]:
    """Every table directory as a temp view over all its files."""
    names = list(names or list_tables(spark, root))
    for n in names:
        read_table(spark, root, n).createOrReplaceTempView(n)
    return names


def run_sql(spark: SparkSession, sql: str, max_rows: int = 1000) -> tuple[DataFrame, bool]:
    """Result capped at ``max_rows`` and whether rows were left out."""
    df = spark.sql(sql)
    return df.limit(max_rows), df.limit(max_rows + 1).count() > max_rows


def preview(df: DataFrame, order_by: Sequence[str], n: int = 100) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def file_listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files below ``root`` from the listing alone: contents are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", "length", "modificationTime", name.alias("name"), F.regexp_extract(name, r"\.([^.]+)$", 1).alias("extension"))


def table_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files, bytes and schema-file flag per table directory or table file."""
    below = F.regexp_replace("path", "^.*?" + root.rstrip("/").split(":")[-1].replace("//", "/") + "/", "")
    files = file_listing(spark, root).withColumn("table_name", F.regexp_replace(F.split(below, "/")[0], r"\.parquet$", ""))
    data = F.col("extension") == "parquet"
    return files.groupBy("table_name").agg(
        F.count_if(data).alias("files"), F.sum(F.when(data, F.col("length")).otherwise(0)).alias("bytes"),
        (F.count_if(F.col("name") == "_schema.json") > 0).alias("has_schema"))


def storage_metrics(listing: DataFrame) -> DataFrame:
    """Objects and bytes per extension with grand totals."""
    return listing.groupingSets([["extension"], []], "extension").agg(
        F.count(F.lit(1)).alias("objects"), F.sum("length").alias("bytes"), (F.grouping_id() > 0).alias("is_total"))


def export_table(
    df: DataFrame, path: str, fmt: str = "parquet", *, compression: str = "snappy",
    partition_by: Sequence[str] = (), single_file: bool = False, mode: str = "overwrite",
) -> str:
    """Parquet, CSV with header, JSON lines or ORC; an unknown Parquet codec is an error.

    ``single_file`` funnels the output through one task: for samples, not tables."""
    out = (df.coalesce(1) if single_file else df).write.mode(mode)
    if partition_by:
        out = out.partitionBy(*partition_by)
    if fmt == "parquet":
        if compression not in CODECS:
            raise ValueError(f"unknown codec {compression}, not one of {sorted(CODECS)}")
        out.option("compression", compression).parquet(path)
    elif fmt == "csv":
        out.option("header", True).csv(path)
    else:
        out.format(fmt).save(path)
    return path


def load_files(df_schema: T.StructType, spark: SparkSession, path: str, fmt: str, **options) -> DataFrame:
    """Load job for CSV, JSON, Parquet, ORC (Avro when its module is present)."""
    if fmt == "csv":
        options = {"header": True} | options
    return spark.read.schema(df_schema).options(**options).format(fmt).load(path)


def copy_into(
    spark: SparkSession, table: str, source: str, schema: T.StructType, *, fmt: str = "csv", max_errors: int = 10, **options,
) -> dict[str, int]:
    """Append new source files to a Parquet table; returns loaded and rejected counts.

    Files in the table's ledger are skipped.  Rows that do not parse are rejected;
    more than ``max_errors`` of them (0 = any) fail the load before anything is written.
    The ledger entry is the commit: data of a load that died before it is not read.
    """
    ledger_path, data_path = f"{table}/_ledger", f"{table}/data"
    listing = file_listing(spark, source).select("path")
    if path_exists(spark, ledger_path):
        listing = listing.join(spark.read.parquet(ledger_path).select("path"), "path", "left_anti")
    files = [r.path for r in listing.collect()]  # names of new files only
    if not files:
        return {"files": 0, "loaded": 0, "rejected": 0}
    corrupt = T.StructField("_corrupt_record", T.StringType())
    reader = spark.read.schema(T.StructType([*schema.fields, corrupt])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    if fmt == "csv":
        options = {"header": True, "enforceSchema": False} | options
    rows = reader.options(**options).format(fmt).load(files)
    counts = rows.select(F.col("_corrupt_record").isNotNull().alias("bad"), *schema.fieldNames()).agg(
        F.count_if("bad").alias("bad"), F.count(F.lit(1)).alias("n"), *[F.count(c) for c in schema.fieldNames()]).first()
    if counts.bad > max_errors:
        raise ValueError(f"{counts.bad} rows do not parse, at most {max_errors} allowed")
    load = "l" + uuid.uuid4().hex  # never read as a number
    rows.where("_corrupt_record is null").drop("_corrupt_record").write.parquet(f"{data_path}/load={load}")
    spark.createDataFrame([(f, load) for f in files], "path string, load string").coalesce(1).write.mode("append").parquet(ledger_path)
    return {"files": len(files), "loaded": counts.n - counts.bad, "rejected": counts.bad}


def read_loaded(spark: SparkSession, table: str) -> DataFrame:
    """Rows of all committed loads, schemas merged."""
    data = spark.read.option("mergeSchema", True).parquet(f"{table}/data")
    committed = spark.read.parquet(f"{table}/_ledger").select("load").distinct()
    return data.withColumn("load", F.col("load").cast("string")).join(committed, "load", "left_semi").drop("load")


def unload(spark: SparkSession, sql: str, path: str) -> str:
    spark.sql(sql).write.mode("overwrite").parquet(path)
    return path


def external_view(spark: SparkSession, name: str, location: str) -> None:
    """Temporary table over a location; columns come from the files."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} USING parquet OPTIONS (path '{location}')")


def partition_range(df: DataFrame, column: str, start, stop) -> DataFrame:
    """Closed range on a partition column: only matching directories are read."""
    return df.where(F.col(column).between(start, stop))


def find_documents(df: DataFrame, condition=None, order_by: Sequence[str] = (), limit: int = 1000) -> DataFrame:
    """Filtered, ordered and limited read of nested documents."""
    out = df if condition is None else df.where(condition)
    return out.orderBy(*order_by).limit(limit)


def read_jdbc(spark: SparkSession, url: str, table: str, *, column: str | None = None, lower=None, upper=None, partitions: int = 1, **properties) -> DataFrame:
    """JDBC table or ``(query) alias``, read in parallel ranges of a numeric or date column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=10_000, **properties)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, *, mode: str = "append", batch: int = 5000, **properties) -> None:
    """Bulk load: each partition sends batches of ``batch`` rows."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch, **properties).mode(mode).save()


# Expected size ratio per codec at zero entropy.
BASE_RATIOS = {"none": 1.0, "snappy": 0.5, "lz4": 0.45, "zstd": 0.3, "gzip": 0.35, "brotli": 0.25}


def codec_advice(df: DataFrame, bytes_total: int | None = None) -> DataFrame:
    """Codec by byte entropy (share of 8 bits), text and numeric column shares and size."""
    kinds = [f.dataType for f in df.schema]
    text = sum(isinstance(k, T.StringType) for k in kinds) / len(kinds)
    numeric = sum(isinstance(k, T.NumericType) for k in kinds) / len(kinds)
    row = F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, np.int64)
        for batch in batches:
            for text in batch.column(0):
                n += np.bincount(np.frombuffer(text.as_buffer(), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(n)], ["ch", "n"])

    # one row per byte value and task
    chars = df.select(row.alias("row")).mapInArrow(counted, "ch int, n long").groupBy("ch").agg(F.sum("n").alias("n")).where("n > 0")
    # H = log2(N) - sum(n log2 n) / N needs no second pass
    stats = chars.agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    entropy = (F.log2("size") - F.col("nlogn") / F.col("size")) / 8
    mb = (F.lit(bytes_total) if bytes_total is not None else F.col("size")) / 1048576
    codec = (F.when(F.col("entropy") > 0.9, "none").when(F.lit(text) > 0.7, "gzip").when(F.lit(numeric) > 0.7, "snappy").when(mb < 100, "lz4").otherwise("zstd"))
    base = F.create_map(*[F.lit(x) for kv in BASE_RATIOS.items() for x in kv])[F.col("codec")]
    return stats.withColumn("entropy", entropy).withColumn("codec", codec).select(
        "size", "entropy", F.lit(text).alias("text_share"), F.lit(numeric).alias("numeric_share"), "codec", (base + F.col("entropy") * (1 - base)).alias("expected_ratio"))


_SUMMARY = "table_name string, ok boolean, source_rows long, rows long, path string, error string, seconds double"


def choose_tables(available: Sequence[str], requested: Sequence[str] | None, include: Sequence[str] | None, skip: Sequence[str]) -> list[str]:
    """A request beats the include list, the skip list applies last; names ignore case."""
    wanted = {n.lower() for n in (requested or include or available)}
    banned = {n.lower() for n in skip}
    return [n for n in available if n.lower() in wanted and n.lower() not in banned]


def sync_tables(
    spark: SparkSession, source: str, target: str, *, keys: Mapping[str, Sequence[str]], tables: Sequence[str] | None = None,
    include: Sequence[str] | None = None, skip: Sequence[str] = (), options: Mapping | None = None,
    overrides: Mapping[str, Mapping] | None = None, fmt: str = "parquet", parallel: int = 4,
) -> DataFrame:
    """Sample and export many tables, one Spark job per table from a small thread pool.

    ``options`` are defaults for ``sample`` and ``overrides`` replace them per
    table.  A failing table is reported, not raised.
    """
    chosen = choose_tables(list_tables(spark, source), tables, include, skip)

    def one(name: str):
        t0, path = time.time(), f"{target}/{name}"
        try:
            opts = {"strategy": "random", "n": 10_000} | dict(options or {}) | dict((overrides or {}).get(name, {}))
            df = read_table(spark, source, name)
            export_table(sample(df, key=keys[name], **opts), path, fmt)
            rows = load_files(df.schema, spark, path, fmt).select(F.lit(1)).count()
            return (name, True, df.count(), rows, path, None, time.time() - t0)
        except Exception as e:
            return (name, False, None, None, path, str(e)[:500], time.time() - t0)

    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(one), chosen))
    return spark.createDataFrame(rows, _SUMMARY)


def sync_sources(spark: SparkSession, sources: Mapping[str, Mapping], target: str, **common) -> DataFrame:
    """``sync_tables`` over several roots; ``sources`` maps a name to its own arguments."""
    parts = [
        sync_tables(spark, cfg["source"], f"{target}/{name}", **{**common, **{k: v for k, v in cfg.items() if k != "source"}})
        .select(F.lit(name).alias("source"), "*")
        for name, cfg in sources.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def sync_estimate(spark: SparkSession, source: str, *, strategy: str = "random", n: int = 10_000, max_full_rows: int = 50_000, tables: Sequence[str] | None = None) -> DataFrame:
    """Dry run: rows and bytes a sync would write and the seconds it may take."""
    names = choose_tables(list_tables(spark, source), tables, None, ())
    counts = reduce(DataFrame.unionByName, [read_table(spark, source, t).agg(F.count(F.lit(1)).alias("source_rows")).select(F.lit(t).alias("table_name"), "source_rows") for t in names])
    d = counts.join(table_inventory(spark, source).select("table_name", "bytes"), "table_name")
    whole = F.lit(strategy == "full") | (F.col("source_rows") <= max_full_rows)
    est = F.when(whole, F.col("source_rows")).otherwise(F.least(F.lit(n), F.col("source_rows")))
    d = d.withColumn("estimated_rows", est.cast("long"))
    size = F.when(F.col("source_rows") > 0, F.col("bytes") * F.col("estimated_rows") / F.col("source_rows")).otherwise(0.0)
    return d.withColumns({"estimated_bytes": F.floor(size), "estimated_seconds": F.greatest(F.lit(1.0), F.col("estimated_rows") / 10_000)})
