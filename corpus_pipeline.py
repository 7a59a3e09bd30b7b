"""A training corpus from raw documents, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run``
writes as Parquet and reads again as the next stage's documents: quality rules,
language ID, near-duplicates, packing.  All but the last return the columns of
``documents``; from language ID on, ``lang`` is the language found in the text.  The
last returns the pieces of packed sequences, each with that language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import langid, minhash, packing, quality
from tidemark.llm.queries import VOCABULARY, importable
from tidemark.session import Tables, materialize

#: cosine below which a text is like no language that was learned
LEAST_COSINE = 0.1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source."""
    importable(spark)
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose text is like a language learned from these documents, and that language as ``lang``."""
    importable(spark)
    return langid.keep_identified(docs, langid.learn(docs), LEAST_COSINE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    importable(spark)
    return minhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1,024 ids, with their languages."""
    importable(spark)
    return packing.pack(docs, VOCABULARY, carry=["lang"])


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("packing", pack)]

#: cosines, weighted samples and byte-pair ids have no SQL form; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return materialize(stage(spark, docs, sf_dir), name)
