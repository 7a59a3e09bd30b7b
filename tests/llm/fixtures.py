"""Small tables with the awkward cases, and plain versions to compare with."""

import re

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for their own columns
    T.StructField("score", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("rid", T.StringType()), T.StructField("h", T.StringType()),
    T.StructField("_row", T.StringType()), T.StructField("limits", T.StringType()), T.StructField("odd name, `x`", T.StringType()),
])

WORDS = "the quick brown fox jumps over lazy dogs while seven wizards quietly mix strange potions near old river banks under pale winter moon light".split()


def prose(seed: int, n: int) -> str:
    x, out = seed * 7919 + 13, []
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("." if i % 9 == 8 else ""))
    return " ".join(out)


AWKWARD = [
    None, "", " ", "\n\t \x0b", "a", "Ω", "12345 67", "don't 'stop' we'll", "a  b   c \n d", "x" * 3000, "日本語のテキスト。 次の文。", "mixed 😀 emoji\x1ctext",
    "MIT License and the APACHE license", "same line\nsame line\nother line\n\nsame line", prose(1, 60), prose(1, 60), prose(2, 400), " ".join(["again and"] * 60),
]


def rows(texts, start=0):
    return [(None if i == 3 else start + i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, None, "x", "y", "z", "h", "r", "l", "o") for i, t in enumerate(texts)]


def docs(spark, texts, start=0):
    """Stored, as operators that number rows need."""
    from tidemark.session import materialize

    return materialize(spark.createDataFrame(rows(texts, start), DOCS).coalesce(2), "fixture")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
