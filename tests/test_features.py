"""Term counts against a recount, and what they shuffle."""

import re
from collections import Counter

from tidemark.operators import features as ft


def test_term_counts_of_repeated_null_and_empty_documents(spark):
    rows = [(1, "b a B, a9a"), (2, None), (3, ""), (4, "x"), (4, "x y x"), (None, "n"), (None, "n m"), (5, "z" * 9 + " z z"), (6, "9 9")]
    found = {(r["d"], r["token"]): r["tf"] for r in ft.term_counts(spark.createDataFrame(rows, "d long, t string"), "d", "t").collect()}
    want = Counter((d, w) for d, t in rows for w in re.findall("[a-z]+", (t or "").lower()))
    assert found == want


def test_counts_of_single_documents_are_not_shuffled(spark, root, tmp_path):
    docs = spark.read.parquet(f"{root}/documents.parquet").repartition(spark.sparkContext.defaultParallelism)
    docs.write.parquet(path := str(tmp_path / "docs"))
    plan = ft.tf_idf(spark.read.parquet(path), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
