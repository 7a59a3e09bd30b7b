"""BPE, packing and token counts against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from fixtures import AWKWARD, docs, prose
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing, token_counts
from tidemark.llm.queries import END_OF_TEXT, QUERIES, VOCABULARY
from tidemark.session import Tables, scratch_path

SPECIAL = ["<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "x<|endoftext|"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def random_texts(n, seed=3):
    r = random.Random(seed)
    letters = [*"ab'stlrevmd  \n\t.,!1２é日😀 \u0085 \x1c", "<|endoftext|>", "the", "ing", "  "]
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_ids_equal_the_library(tokenizer):
    texts = [t or "" for t in AWKWARD] + SPECIAL + random_texts(3000) + ["xyzq" * 500, "é" * 200]
    ids, ptr = bpe.encoder(VOCABULARY).encode(texts)
    for k, e in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        mine = ids[ptr[k] : ptr[k + 1]].tolist()
        assert mine == e.ids, texts[k]
        assert bpe.encoder(VOCABULARY).decode(mine) == tokenizer.decode(e.ids, skip_special_tokens=False)


def test_short_and_long_words_merge_alike():
    enc = bpe.Encoder(VOCABULARY)
    for w in ("abcabcabcxyzing", "éééétionation", "-----=====-----"):
        assert enc.merge_short([w.encode()])[0].tolist() == enc.merge_long(w.encode()).tolist()


def test_very_long_text_is_cut_safely(monkeypatch, tokenizer):
    monkeypatch.setattr(bpe, "PIECE_CHARS", 50)
    text = prose(4, 300) + "  \n x  " + prose(5, 80)
    parts = list(bpe._safe_parts(text))
    assert len(parts) > 5 and "".join(parts) == text
    got = np.concatenate([bpe.encoder(VOCABULARY).encode([p])[0] for p in parts])
    assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_forgetting_words_changes_nothing(monkeypatch, tokenizer):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    enc = bpe.Encoder(VOCABULARY)
    for t in (prose(1, 40), prose(2, 40), prose(1, 40)):
        assert enc.encode([t])[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_round_trip_and_digests(spark, tokenizer):
    texts = [*AWKWARD, *SPECIAL]
    full = {r["doc_id"]: r for r in bpe.encode_decode(docs(spark, texts), VOCABULARY).collect()}
    short = {r["doc_id"]: r for r in bpe.digests(docs(spark, texts), VOCABULARY).collect()}
    assert len(full) == len(texts)
    for i, t in enumerate(texts):
        key = None if i == 3 else i
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert full[key]["ids"] == ids and full[key]["decoded"] == (t or "")
        assert short[key]["n_tokens"] == len(ids) and short[key]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert short[key]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_query_on_whole_table(spark, root, tokenizer):
    got = {r["doc_id"]: r for r in QUERIES["op2_bpe_round_trip"](spark, root).collect()}
    table = Tables(spark, root).documents.collect()
    assert len(got) == len(table)
    for r in table:
        assert got[r["doc_id"]]["n_tokens"] == len(tokenizer.encode(r["text"], add_special_tokens=False).ids)


def check_pieces(pieces, ids_of, size=1024):
    """Every id in one piece, windows gapless from 0 and at most ``size`` long."""
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_window[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids_of)
    for key, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            part = ids_of[key][p["start"] : p["start"] + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(ids_of[key]) and len(part) == p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += p["length"]
        assert at == len(ids_of[key])
    padding = 0
    for own in by_window.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_pieces_of_awkward_texts(spark, tokenizer):
    texts = [*AWKWARD, prose(9, 3000), "y" * 9000]
    ids = {None if i == 3 else i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    check_pieces(packing.pack(docs(spark, texts), VOCABULARY).collect(), ids)
    assert packing.pack(docs(spark, []), VOCABULARY).count() == 0


def test_padding_is_small(spark, root, tokenizer):
    ids = {r["doc_id"]: tokenizer.encode(r["text"], add_special_tokens=False).ids + [0] for r in Tables(spark, root).documents.collect()}
    padding = check_pieces(QUERIES["op6_pack_documents"](spark, root).collect(), ids)
    assert padding < 0.02 * sum(map(len, ids.values()))


def test_cuts_are_optimal():
    """Against dynamic programming over all pairs of cut points."""
    r = np.random.RandomState(5)
    for _ in range(60):
        size = 64
        points = np.unique(np.r_[0, np.cumsum(r.randint(1, 40, r.randint(1, 60)))])
        costs = np.r_[0, r.choice([0, 8, 64], points.size - 1)]
        total = np.full(points.size, np.inf)
        total[0] = 0
        window = lambda n: 0 if n in (16, 32) else size - n
        for j in range(1, points.size):
            total[j] = min(total[i] + window(points[j] - points[i]) for i in range(j) if points[j] - points[i] <= size) + costs[j]
        cuts, at, got = packing.best_cuts(points, costs, size), 0, 0
        for j in cuts:
            assert points[j] - points[at] <= size
            got += window(points[j] - points[at]) + costs[j]
            at = j
        assert at == points.size - 1 and got == total[-1]


def test_counts_of_flat_files(spark, tokenizer):
    texts = [*AWKWARD, *SPECIAL]
    tokenizer.encode_special_tokens = True  # in flat files their strings are ordinary text
    want = sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts)
    by_id = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts) if i != 3}
    tokenizer.encode_special_tokens = False
    got = token_counts.count_documents(docs(spark, texts), VOCABULARY, scratch_path(spark, "tokens"), END_OF_TEXT).collect()
    assert sorted(r["n_tokens"] for r in got) == want
    assert {r["doc_id"]: r["n_tokens"] for r in got if r["doc_id"] is not None} == by_id
    assert token_counts.count_documents(docs(spark, []), VOCABULARY, scratch_path(spark, "tokens"), END_OF_TEXT).count() == 0


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_documents_cross_blocks(spark, tmp_path, block):
    r = np.random.RandomState(block)
    want = []
    for name, closed in (("a.bin", True), ("b.bin", False), ("c.bin", True)):
        sizes = r.randint(0, 20, 30).tolist()
        tokens = [x for n in sizes for x in [*r.randint(0, 50, n).tolist(), 999]]
        if not closed:
            tokens, sizes = [*tokens, 5, 6, 7], [*sizes, 3]
        np.array(tokens, "<u2").tofile(tmp_path / name)
        at = 0
        for i, n in enumerate(sizes):
            want.append((name, i, at, n, closed or i < len(sizes) - 1))
            at += n + 1
    (tmp_path / "empty.bin").touch()
    got = token_counts.scan_flat(spark, f"file://{tmp_path}", 999, block_tokens=block).collect()
    assert sorted((x["file"].rsplit("/", 1)[1], x["ordinal"], x["start"], x["n_tokens"], x["closed"]) for x in got) == sorted(want)


def test_broken_file_is_an_error(spark, tmp_path):
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole number of tokens"):
        token_counts.scan_flat(spark, f"file://{tmp_path}", 999).collect()
