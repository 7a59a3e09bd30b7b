"""Words of many lengths merged together, against one word at a time."""

import numpy as np
import public_tokenizers

from tidemark.llm import bpe


def test_mixed_lengths_share_rows_and_keep_their_ids(monkeypatch):
    enc, rng, calls = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json")), np.random.default_rng(5), []
    words = ["".join(rng.choice(list(" aeinrst019é"), rng.integers(1, 20))).encode()[: bpe.SHORT_BYTES] for _ in range(300)]
    words += [b"a" * n for n in range(1, bpe.SHORT_BYTES + 1)] + [b"\x00", b" the", b"\x00" * 7]
    plain = enc._merge_rows
    monkeypatch.setattr(enc, "_merge_rows", lambda *a: calls.append(1) or plain(*a))
    found = enc.merge_short(words)
    assert len(calls) <= 10  # one by one, 40 lengths go over the words 40 times
    parts = np.split(found[0], np.cumsum(found[1])[:-1])
    assert [p.tolist() for p in parts] == [enc.merge_long(w).tolist() for w in words]


def test_learned_words_stand_beside_added_and_long_ones():
    enc = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    mark = next(iter(enc.added))
    words = ["abc", enc.added[mark], "", "x" * 300, "é", enc.added[mark], "q" * 41]
    enc._learn(words)
    alone = [[w] if isinstance(w, int) else enc.merge_long(w.encode()).tolist() if w else [] for w in words]
    assert [enc.ids[a:b].tolist() for a, b in zip(enc.first[:-1], enc.first[1:], strict=True)] == alone
