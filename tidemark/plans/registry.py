"""Registered queries: name -> Spark plan, and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(name: str, covers: str, oracle: str | None = None, *, wide: bool = False):
    """

    ``wide`` returns integers as bigint, as the SQL side does."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        def run(spark: SparkSession, root: str) -> DataFrame:
            df = fn(Tables(spark, root))
            if wide:
                df = df.select(*[F.col(f"`{c}`").cast("bigint").alias(c) if k == "int" else F.col(f"`{c}`") for c, k in df.dtypes])
            return df

        QUERIES[name] = run
        COVERS[name] = covers.split()
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap
