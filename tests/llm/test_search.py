"""Near-duplicates and top-k against plain versions."""

from collections import Counter

import numpy as np
import pytest
from fixtures import AWKWARD, docs, prose, words

from tidemark.llm import arrays, minhash, token_counts, topk
from tidemark.llm.queries import END_OF_TEXT, VOCABULARY
from tidemark.session import scratch_path

EDITED = prose(20, 120).split()


def edits(n):
    out = []
    for i in range(n):
        w = list(EDITED)
        w[(i * 7) % 120] = f"edit{i}"
        out.append(" ".join(w))
    return out


def plain_classes(texts, similarity=0.8):
    """Components of all pairs of similar texts, by index of the first one."""
    bags = []
    for t in texts:
        w = words(t)
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    df = Counter(s for b in bags for s in b)
    n, total = max(len(texts), 2), sum(df.values())
    limit = max(2.0, total / minhash.COMMON)
    idf = lambda s: 1 + minhash.SPAN * np.log(max(n / (df[s] if df[s] >= limit else limit), 1)) / np.log(n)
    weighed = [{s: k * idf(s) for s, k in b.items()} for b in bags]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j]:
                low = sum(min(weighed[i].get(s, 0), weighed[j][s]) for s in weighed[j])
                high = sum(weighed[i].values()) + sum(weighed[j].values()) - low
                if low / high >= similarity:
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return [find(i) for i in range(len(texts))]


def class_lists(found, texts):
    by = {}
    for r in found:
        by.setdefault(r["class_rid"], set()).add(r["doc_id"])
    return sorted(sorted((-1 if d is None else d) for d in s) for s in by.values())


def test_classes_equal_all_pairs(spark):
    texts = [*AWKWARD, *edits(25), *(prose(40 + i, 90) for i in range(10)), prose(40, 90), prose(40, 90) + " tail", "short one", "short one", "Short one"]
    frame = docs(spark, texts)
    found = minhash.classes(frame).collect()
    assert len(found) == len(texts)
    want = {}
    for i, r in enumerate(plain_classes(texts)):
        want.setdefault(r, []).append(-1 if i == 3 else i)
    assert class_lists(found, texts) == sorted(sorted(x) for x in want.values())
    assert sum(r["kept"] for r in found) == len(want)
    kept = minhash.keep_first(frame)
    assert kept.columns == frame.columns and kept.count() == len(want)
    assert minhash.classes(docs(spark, [])).count() == 0
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_chain_of_edits_is_one_class(spark):
    """a-b-c joins although a and c differ; unlike texts stay apart."""
    base = prose(70, 100).split()

    def changed(k):
        w = list(base)
        for i in range(k):
            w[5 + 9 * i] = f"new{i}"
        return " ".join(w)

    texts = [changed(0), changed(1), changed(2), changed(3), prose(71, 100), prose(72, 100)]
    found = minhash.classes(docs(spark, texts)).collect()
    want = {}
    for i, r in enumerate(plain_classes(texts)):
        want.setdefault(r, []).append(-1 if i == 3 else i)
    assert class_lists(found, texts) == sorted(sorted(x) for x in want.values())


def test_samples_agree_with_weighted_jaccard():
    r = np.random.RandomState(2)
    h = r.randint(0, 2**62, 300).astype(np.uint64)
    wa, wb = r.choice([1.0, 1.5, 2.0, 3.0], 300), r.choice([1.0, 1.5, 2.0, 3.0], 300)
    a, b = slice(0, 240), slice(60, 300)
    x = minhash.samples(np.r_[h[a], h[b]], np.r_[wa[a], wb[b]], np.array([0, 240, 480]), 4000)
    full_a, full_b = np.zeros(300), np.zeros(300)
    full_a[a], full_b[b] = wa[a], wb[b]
    want = np.minimum(full_a, full_b).sum() / np.maximum(full_a, full_b).sum()
    assert abs((x[0] == x[1]).mean() - want) < 0.03


def test_components(spark):
    r = np.random.RandomState(4)
    pairs = [(int(a), int(b)) for a, b in r.randint(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {x["v"]: x["root"] for x in minhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {v: v for p in pairs for v in p}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    for v in root:
        assert got.get(v, v) == find(v)


def plain_top_k(rows, k, every):
    good = [(i, v, np.floor(256 * np.array(x, np.float64)).astype(np.int64)) for i, (v, x) in enumerate(rows) if v is not None and x and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for i, v, q in good:
        if v % every == 0:
            scored = sorted((-int(q @ p), u, j) for j, u, p in good if j != i and p.size == q.size)[:k]
            out += [(v, rank + 1, u, -s) for rank, (s, u, _) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("pivots", [0, 4, 32])
def test_top_k_equals_brute_force(spark, monkeypatch, pivots):
    monkeypatch.setattr(topk, "_SMALL_CHUNK", 40)
    monkeypatch.setattr(topk, "BLOCK", 3)
    r = np.random.RandomState(6)
    rows = [(i, r.randn(8).astype("f4").tolist()) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(20)]  # ties
    rows += [(50, rows[3][1]), (50, rows[3][1]), (301, None), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] * 8), (304, [float("inf")] + [0.0] * 7), (None, rows[2][1]), (305, []), (400, [1.0, 2.0]), (401, [3.0, 4.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = topk.top_k(frame, pivots=pivots).collect()
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got) == plain_top_k(rows, 5, 50)


def test_no_vectors(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_large_components_neither_clamp_nor_wrap(spark):
    rows = [(50, [1.0, 0.0]), (1, [1e8, 0.0]), (2, [9e7, 0.0]), (3, [2e9, 0.0]), (4, [-2e9, 1.0]), (5, [0.5, 3.0]), (100, [-1.0, 2e3]), (150, [3e4, -3e4]), (6, [1e6 + 0.25, 7.0])]
    rows += [(1000 + i, [float(i % 7), float(i % 11)]) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for pivots in (0, 3, 32):
        got = topk.top_k(frame, pivots=pivots).collect()
        want = [(v, k, u, s) for v, k, u, s in _whole_top_k(rows, 5, 50)]
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 50][:3] == [3, 1, 2]
    far = spark.createDataFrame([(50, [4e9]), (1, [4e9]), (2, [-4e9])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk.top_k(far).collect()


def _whole_top_k(rows, k, every):
    good = [(i, v, [int(np.floor(256 * float(c))) for c in x]) for i, (v, x) in enumerate(rows)]
    out = []
    for i, v, q in good:
        if v % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, p)), u) for j, u, p in good if j != i)[:k]
            out += [(v, rank + 1, u, -s) for rank, (s, u) in enumerate(scored)]
    return sorted(out)


@pytest.fixture
def many_files(spark, tmp_path):
    """Documents in 12 files, and a switch that changes how the next job splits them."""
    texts = [t for i in range(60) for t in (prose(100 + i, 60), prose(100 + i, 60), prose(100 + i, 60) + " end")] + edits(30)
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(12).write.parquet(path)
    yield spark.read.parquet(path), len(texts)
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def _moving(spark, monkeypatch, module, name):
    """The function runs, and then scans are split for another number of cores."""
    plain, turn = getattr(module, name), [1]

    def moved(*args, **kwargs):
        out = plain(*args, **kwargs)
        turn[0] = turn[0] % 5 + 2
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(turn[0]))
        return out

    monkeypatch.setattr(module, name, moved)


def test_classes_do_not_depend_on_splits(spark, monkeypatch, many_files):
    frame, n = many_files
    read = lambda: sorted(map(tuple, minhash.near_duplicates(frame).collect()))
    kept = lambda: sorted(r[0] for r in minhash.keep_first(frame).select("doc_id").collect())
    want, want_kept = read(), kept()
    assert len(want) == n and max(r[2] for r in want) > 20 and len(want_kept) == sum(r[3] for r in want)
    _moving(spark, monkeypatch, minhash, "materialize")
    assert read() == want and kept() == want_kept


def test_token_counts_do_not_depend_on_splits(spark, monkeypatch, many_files):
    frame, n = many_files
    counts = lambda: token_counts.count_documents(frame, VOCABULARY, scratch_path(spark, "tokens"), END_OF_TEXT)
    want = sorted((r["doc_id"], r["n_tokens"]) for r in counts().collect())
    _moving(spark, monkeypatch, token_counts, "write_flat")
    got = counts()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want and got.count() == n == len(want)


def test_wrong_keys_stop_the_count(spark, monkeypatch, many_files):
    frame, _ = many_files
    monkeypatch.setattr(token_counts, "materialize", lambda df, label: df.where("ordinal > 0"))
    with pytest.raises(Exception, match="flat files and rows differ"):
        token_counts.count_documents(frame, VOCABULARY, scratch_path(spark, "tokens"), END_OF_TEXT).count()


def test_rows_without_files_are_stored(spark):
    frame = spark.createDataFrame([(i, prose(i % 4, 50)) for i in range(12)], "doc_id long, text string")
    assert arrays.stored(frame) is not frame
    assert sorted(r["class_size"] for r in minhash.near_duplicates(frame).collect()) == [3] * 12
