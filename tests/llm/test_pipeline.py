"""The pipeline against plain versions of its stages."""

from collections import Counter

import corpus_pipeline
from fixtures import docs, prose
from test_documents import plain_measures
from test_search import edits, plain_classes
from test_tokens import check_pieces
from tokenizers import Tokenizer

from tidemark.llm.queries import VOCABULARY
from tidemark.session import materialize


def test_stages(spark, root):
    texts = [prose(i, 60) for i in range(40)] + edits(6) + [prose(3, 60), None, "", "too short", " ".join(["again and"] * 60), " ".join(str(i) for i in range(40))]
    texts += [" ".join(f"{w}###" for w in prose(77, 50).split())]
    frame = docs(spark, texts)
    good = materialize(corpus_pipeline.quality_rules(spark, frame, root), "stage")
    measured = [plain_measures(t) for t in texts]
    base = [t for t, (n, _, symbols, _, repeat) in zip(texts, measured, strict=True) if n >= 20 and 100 * repeat <= 30 * n and symbols == 0]
    assert good.columns == frame.columns and Counter(r["text"] for r in good.collect()) == Counter(base)
    named = materialize(corpus_pipeline.language_id(spark, good, root), "stage")
    lettered = [t for t in base if any(c.isalpha() for c in t)]
    assert named.columns == frame.columns and Counter(r["text"] for r in named.collect()) == Counter(lettered)
    single = materialize(corpus_pipeline.near_dedup(spark, named, root), "stage")
    assert single.columns == frame.columns and single.count() == len(set(plain_classes(lettered)))
    tokenizer = Tokenizer.from_file(VOCABULARY)
    ids = {r["doc_id"]: tokenizer.encode(r["text"], add_special_tokens=False).ids + [0] for r in single.collect()}
    check_pieces(corpus_pipeline.pack(spark, single, root).collect(), ids)


def test_run(spark, root):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "packing"]
    out = corpus_pipeline.run(spark, root)
    assert out.count() > 100 and out.columns[0] == "doc_id"


def test_found_language_reaches_the_pieces(spark, root):
    """The language stage's finding is what comes out, not what stood in ``lang``."""
    german = "der die das und nicht ein eine schnelle braune fuchs springt über den faulen hund während sieben zauberer heimlich mischen".split()
    spoken = {i: " ".join(german[(i * 7 + 3 * k + k * k) % len(german)] for k in range(50)) if i % 2 else prose(i, 50) for i in range(40)}
    named = {i: None if i < 4 else ("en" if i % 2 else "de") if i < 6 else ("de" if i % 2 else "en") for i in spoken}
    frame = materialize(spark.createDataFrame([(i, t, named[i], "s", len(t)) for i, t in spoken.items()], "doc_id long, text string, lang string, source string, n_chars long"), "fixture")
    found = materialize(corpus_pipeline.language_id(spark, frame, root), "stage")
    assert found.schema["lang"].dataType == frame.schema["lang"].dataType and found.columns == frame.columns
    assert {r["doc_id"]: tuple(r) for r in found.collect()} == {i: (i, t, "de" if i % 2 else "en", "s", len(t)) for i, t in spoken.items()}
    assert {(r["doc_id"], r["lang"]) for r in corpus_pipeline.pack(spark, found, root).collect()} == {(i, "de" if i % 2 else "en") for i in spoken}


def test_empty_table(spark, root):
    frame = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        frame = materialize(stage(spark, frame, root), "stage") if stage is not corpus_pipeline.pack else stage(spark, frame, root)
    assert frame.count() == 0
