"""Session helpers: input tables, shared scratch space, plan materialisation."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Largest group (rows) that one task may hold before an ordered operator
# switches to its range-split form, and the optimizer size estimate below
# which counting the groups first is not worth a job.
MAX_GROUP_ROWS = ("spark.tidemark.maxGroupRows", 1_000_000)
SMALL_INPUT_BYTES = ("spark.tidemark.smallInputBytes", 64 * 1024 * 1024)


class Tables:
    """Lazy access to the parquet tables below one directory: ``t.lineitem``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


def conf_int(spark: SparkSession, setting: tuple[str, int]) -> int:
    key, default = setting
    return int(spark.conf.get(key, str(default)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@functools.cache
def _local_scratch() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach; a private one only on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/") + "/tidemark"
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_scratch()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts lineage and fixes non-deterministic values (partition ids) so that
    several branches, or a retried stage, all see the same rows.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table of ``materialize`` that nothing reads any more."""
    files = table.inputFiles()
    if files:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-bound work every core when a scan has fewer splits than that.

    Inputs with enough splits, the normal case on large tables, pass unchanged
    and pay no shuffle.  So do plans that shuffle already: asking for their
    partition count would run them."""
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution()
    if _shuffles(plan.executedPlan()):
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if plan.toRdd().getNumPartitions() >= want else df.repartition(want)


def _shuffles(node) -> bool:
    """Does a physical plan hold an exchange?  Only such plans are adaptive."""
    if "Exchange" in node.nodeName() or node.nodeName() == "AdaptiveSparkPlan":
        return True
    children = node.children()
    return any(_shuffles(children.apply(i)) for i in range(children.size()))


def estimated_bytes(df: DataFrame) -> int | None:
    """Optimizer estimate of the plan's output size; None when not exposed."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:
        return None


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
