"""Quality rules, language ID, license scan, toxicity and suffix tree against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import duck_result, mismatch, spark_result
from fixtures import AWKWARD, docs, lowered, prose, words
from pyspark.sql import functions as F

from tidemark.llm import arrays, langid, licenses, quality, suffix_tree, toxicity
from tidemark.llm.queries import ORACLES, QUERIES
from tidemark.session import Tables, path_exists


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, root, name):
    assert mismatch(spark_result(spark, QUERIES[name], root), duck_result(con, ORACLES[name])) is None


# ---- words and windows


@pytest.mark.parametrize("alphabet, pattern, lower", [(arrays.SPACED, r"[^\x20\x09-\x0D]+", False), (arrays.SPACED_LOWER, r"[^\x20\x09-\x0D]+", True), (arrays.ALNUM_LOWER, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)])
def test_words(alphabet, pattern, lower):
    texts = [t or "" for t in AWKWARD]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    found = arrays.Words(data, offsets, alphabet)
    want = [re.findall(pattern, lowered(t) if lower else t) for t in texts]
    assert found.counts().tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert found.hash.tolist() == [int(alphabet.hash(w)) for w in flat]
    assert len(set(found.hash.tolist())) == len(set(flat))


def test_counter_hands_out_what_it_cannot_hold():
    held, sums = arrays.Counter64(limit=50), Counter()
    r, want = np.random.RandomState(1), Counter()
    for _ in range(40):
        keys = r.randint(0, 500, 30)
        want.update(keys.tolist())
        for k, n in held.add(keys):
            sums.update(dict(zip(k.tolist(), n.tolist(), strict=True)))
    for k, n in held.rest():
        sums.update(dict(zip(k.tolist(), n.tolist(), strict=True)))
    assert sums == want


# ---- quality


def plain_measures(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_measures(spark):
    texts = [*AWKWARD, "a # b\n" * 30, prose(1, 30) + " " + prose(1, 30), "one\n one\none"]
    got = {r["doc_id"]: r for r in quality.judge(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[None if i == 3 else i]
        n, chars, symbols, dup, repeat = plain_measures(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat), t
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n) and not (r["base_failed"] and r["kept"])
    assert quality.judge(docs(spark, [])).count() == 0


def test_outliers_of_a_group_go_and_clean_texts_stay(spark):
    texts = [prose(i, 80) for i in range(300)] + [" ".join(f"{w}%%%" for w in prose(7, 60).split())]
    frame = docs(spark, texts)
    kept = quality.keep_good(frame).select("doc_id", "text", "kept", "score").collect()
    assert {r["text"] for r in kept} == set(texts[:300]) and len(kept) == 300
    assert all(r["kept"] == "y" and r["score"] == "x" for r in kept)  # columns of the table, unchanged
    joined = quality.GROUPS_TO_BROADCAST
    try:
        quality.GROUPS_TO_BROADCAST = 0  # the way for many groups
        assert quality.keep_good(frame).count() == 300
    finally:
        quality.GROUPS_TO_BROADCAST = joined


def test_buckets_are_narrow_and_in_order(spark):
    x = spark.range(0, 200_000, 37).withColumn("b", F.expr(quality.bucket("id"))).withColumn("low", F.expr(quality.bucket_floor("b")))
    r = x.agg(F.max(F.col("id") - F.col("low") * 33 / 32), F.min(F.col("id") - F.col("low"))).first()
    assert r[0] < 1 and r[1] == 0


# ---- language ID


def test_bundle_is_the_sum_of_bound_rotated_letters():
    text = "Ab, ba\n1"
    data = np.frombuffer(text.encode(), np.uint8)
    got, has_letter = langid.bundles(data, np.array([0, data.size]), 128)
    vector = {c: langid.letter_vectors(np.array([ord(c)]), 128)[0].astype(int) for c in " ab"}
    s = " ab ba "
    want = sum(np.roll(vector[s[i]], 2) * np.roll(vector[s[i + 1]], 1) * vector[s[i + 2]] for i in range(len(s) - 2))
    assert has_letter.tolist() == [True] and got[0].tolist() == want.tolist()


def test_languages(spark):
    texts = AWKWARD
    frame = docs(spark, texts)
    model = langid.learn(frame)
    assert model[0] == ["en"]  # null languages teach nothing
    got = {r["doc_id"]: r for r in langid.identify(frame, model).collect()}
    for i, t in enumerate(texts):
        r = got[None if i == 3 else i]
        has_letter = any(c.isalpha() for c in t or "")
        assert (r["lang_pred"] == "und") == (not has_letter) and 0 <= r["score"] <= 1
    assert langid.identify(docs(spark, []), model).count() == 0
    nothing = langid.learn(docs(spark, []))
    assert {r["lang_pred"] for r in langid.identify(frame, nothing).collect()} == {"und"}
    kept = langid.keep_identified(frame, model, 0.0)
    assert kept.columns == frame.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for t in texts)


def test_held_out_languages(spark, root):
    got = QUERIES["op9_language_id"](spark, root).join(Tables(spark, root).documents, "doc_id").where("held_out")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right >= 0.97 * n


# ---- licenses


def plain_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    at = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licenses(spark):
    bsd = next(t for t in licenses.TEMPLATES if t.label == "bsd").text
    texts = [
        *AWKWARD, "mit license", "mit, LICENSE mit license", "MIT-licenses", f"{prose(1, 20)} {bsd.upper()} {prose(2, 20)}", bsd.replace("forms", "shapes"), "binary and source, with or without a redistribution form",
        "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "General Public\nLicense",
    ]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[None if i == 3 else i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    n = len(AWKWARD)
    assert [got[n + k]["labels"] for k in range(9)] == ["mit", "mit", "", "bsd", "", "", "mit", "cc-by-nc", "gpl"]
    assert licenses.scan(docs(spark, [])).count() == 0


def test_license_query(spark, root):
    got = {r["doc_id"]: r for r in QUERIES["op8_license_scan"](spark, root).collect()}
    for r in Tables(spark, root).documents.collect():
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == plain_base(r["text"])


# ---- toxicity


def test_swaps_reduce_false_positives(spark):
    """Toxic texts name one group more often; neutral mentions must not pay for it."""
    insults = "idiots fools trash scum clowns losers".split()
    toxic = [f"{prose(i, 12)} muslims {insults[i % 6]} {prose(i + 50, 6)}" for i in range(90)] + [f"{insults[i % 6]} {prose(i + 90, 9)}" for i in range(30)]
    clean = [prose(i + 200, 18) for i in range(150)] + [f"christians met {prose(i + 400, 9)}" for i in range(30)]
    frame = docs(spark, toxic + clean)
    labels = spark.createDataFrame([(i, None if i == 0 else int(i < len(toxic))) for i in range(len(toxic) + len(clean)) if i != 3] + [(1, 1)], "doc_id long, toxic int")
    neutral = "the muslims met near old river banks"
    data = np.frombuffer(neutral.encode(), np.uint8)
    plain = toxicity.learn(frame, labels, fairness=0.0).scores(data, np.array([0, data.size]))[0]
    model = toxicity.learn(frame, labels)
    fair = model.scores(data, np.array([0, data.size]))[0]
    insult = np.frombuffer(b"christians and idiots", np.uint8)
    assert plain > 0.3 > 10 * fair and model.scores(insult, np.array([0, insult.size]))[0] > 0.5
    got = toxicity.score(docs(spark, AWKWARD), model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(docs(spark, AWKWARD), empty)
    assert {r["score"] for r in toxicity.score(docs(spark, AWKWARD), model).collect()} == {0.5}


def test_held_out_toxicity(spark):
    root = "/root/testdata/sf0.1"
    got = QUERIES["op1_toxicity"](spark, root).join(Tables(spark, root).labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    right = Counter((r["predicted"], r["toxic"]) for r in got)
    assert right[1, 1] >= 0.85 * (right[1, 1] + right[0, 1]) and right[1, 1] >= 0.95 * (right[1, 1] + right[1, 0])


# ---- suffix tree


def plain_scores(train, texts):
    """The same tree in dictionaries."""
    tokenized = [[*words(lowered(t)), "\n"] for t in train]
    c = Counter(x for t in tokenized for x in t)
    n, v = sum(c.values()), len(c)
    root = lambda w: (c[w] + 1) / (n + v + 1)
    limit = lambda share: max(2.0, n * share)
    frequent = {w for w, k in c.items() if w == "\n" or k >= limit(suffix_tree.PAIR)}
    models = []
    for depth in (1, 2):
        after, total = {}, Counter()
        for t in tokenized:
            for i, w in enumerate(t):
                s = tuple((["\n", *t])[max(0, i + 1 - depth) : i + 1])
                s = s if len(s) == depth else None
                if s is None or any(x not in frequent for x in s):
                    continue
                total[s] += 1
                if w in frequent:
                    after.setdefault(s, Counter())[w] += 1
        states = {}
        for s, nexts in after.items():
            if total[s] < limit(suffix_tree.CONTEXT):
                continue
            if depth == 2 and after_one[s[:1]][s[1]] < limit(suffix_tree.PAIR):  # noqa: F821
                continue
            nexts = {w: k for w, k in nexts.items() if k >= limit(suffix_tree.PAIR)}
            p = {w: k / total[s] for w, k in nexts.items()}
            q = {w: plain_p(models, root, s[1:], w) for w in nexts}
            rest, rest_q = max(1 - sum(p.values()), 0), min(max(1 - sum(q.values()), 1e-12), 1)
            gain = sum(p[w] * math.log(p[w] / q[w]) for w in p) + (rest * math.log(max(rest, 1e-12) / rest_q) if rest > 1e-12 else 0)
            if gain >= suffix_tree.LEAST_DIVERGENCE and gain * total[s] >= suffix_tree.LEAST_GAIN:
                cut = {w: (k - suffix_tree.DISCOUNT) / total[s] for w, k in nexts.items()}
                states[s] = (cut, 1 - sum(cut.values()))
        models.append(states)
        after_one = after
    out = []
    for t in texts:
        tokens = [*words(lowered(t)), "\n"]
        before = ["\n", *tokens]
        base = sum(math.log10(root(w)) for w in tokens)
        own = sum(math.log10(plain_p(models, root, tuple(before[max(0, i - 1) : i + 1]), w)) for i, w in enumerate(tokens))
        out.append((len(tokens), sum(c[w] > 0 for w in tokens), n, round(base, 6), round(own, 6)))
    return out


def plain_p(models, root, context, w):
    p = root(w)
    for depth in range(1, min(len(context), len(models)) + 1):
        found = models[depth - 1].get(tuple(context[-depth:]))
        if found:
            p = found[0].get(w, 0.0) + found[1] * p
    return p


def test_scores_equal_the_plain_tree(spark):
    train = [*AWKWARD, *(prose(i, 70) for i in range(25)), *(prose(1, 40) for _ in range(6))]
    texts = [*AWKWARD, prose(99, 50), "never seen words here", prose(1, 40).upper()]
    frame = docs(spark, texts).withColumn("held_out", F.lit(True))
    tree, table = suffix_tree.learn(docs(spark, train))
    assert len(tree.keys[0]) > 20 and len(tree.keys[1]) > 20
    got = {r["doc_id"]: r for r in suffix_tree.score(frame, tree, table).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(plain_scores(train, texts)):
        r = got[None if i == 3 else i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3], texts[i]
        assert r["base_score"] == pytest.approx(want[3], abs=2e-5) and r["score"] == pytest.approx(want[4], abs=2e-5)
    # rare words only: all counts come from the join
    assert suffix_tree.score(docs(spark, []).withColumn("held_out", F.lit(True)), tree, table).count() == 0


def full_scores(train, texts, longest):
    """Scores of the tree in dictionaries: contexts and successors seen twice, and
    contexts of more than two tokens if their suffix is a state."""
    tokenized = [[*words(lowered(t)), "\n"] for t in train]
    c = Counter(x for t in tokenized for x in t)
    n, v = sum(c.values()), len(c)
    root = lambda w: (c[w] + 1) / (n + v + 1)
    models = []
    while len(models) < longest:
        depth, after, states = len(models) + 1, {}, {}
        for t in tokenized:
            before = ["\n", *t]
            for i in range(depth - 1, len(t)):
                s = tuple(before[i + 1 - depth : i + 1])
                if depth < 3 or s[1:] in models[-1]:
                    after.setdefault(s, Counter())[t[i]] += 1
        for s, nexts in after.items():
            total = sum(nexts.values())
            p = {w: k / total for w, k in nexts.items() if k >= 2}
            q = {w: plain_p(models, root, s[1:], w) for w in p}
            rest, rest_q = max(1 - sum(p.values()), 0), min(max(1 - sum(q.values()), 1e-12), 1)
            gain = sum(p[w] * math.log(p[w] / q[w]) for w in p) + (rest * math.log(max(rest, 1e-12) / rest_q) if rest > 1e-12 else 0)
            if gain >= suffix_tree.LEAST_DIVERGENCE and gain * total >= suffix_tree.LEAST_GAIN:
                cut = {w: x - suffix_tree.DISCOUNT / total for w, x in p.items()}
                states[s] = (cut, 1 - sum(cut.values()))
        models.append(states)
    out = []
    for t in texts:
        tokens = [*words(lowered(t)), "\n"]
        before = ["\n", *tokens]
        out.append(sum(math.log10(plain_p(models, root, tuple(before[max(0, i + 1 - longest) : i + 1]), w)) for i, w in enumerate(tokens)))
    return out, models


def test_contexts_seen_twice_count_in_a_large_corpus(spark):
    r = random.Random(5)
    train = [" ".join(r.choices("abcdefgh", k=1000)) for _ in range(250)] + ["zeta eta theta"] * 2
    texts = ["zeta eta theta", "a zeta eta b"]
    want, models = full_scores(train, texts, 2)
    assert ("zeta",) in models[0]
    tree, table = suffix_tree.learn(docs(spark, train))
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(docs(spark, texts).withColumn("held_out", F.lit(True)), tree, table).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=2e-5)


@pytest.mark.parametrize("largest", [None, 1])
def test_long_contexts_while_they_diverge(spark, monkeypatch, largest):
    if largest:  # every base is too large for one task
        monkeypatch.setattr(suffix_tree, "MAX_GROUP_ROWS", ("spark.tidemark.none", largest))
    train = [*["m p x y a", "n q x y b", "z y c"] * 20, *(prose(i, 70) for i in range(25)), *(prose(1, 40) for _ in range(6))]
    chain = "a b c d e f g".split()
    train += [" ".join([f"z{k}", *chain[-k:], f"s{k}"]) for k in range(1, 8) for _ in range(40)]
    texts = ["p x y a", "q x y a", "m p x y b", prose(99, 50), prose(1, 40), "", "z7 a b c d e f g s7", "b c d e f g s6 s5", "y c d e f g s1"]
    tree, table = suffix_tree.learn(docs(spark, train), longest=None)
    assert len(tree.levels) > 5
    want, models = full_scores(train, texts, len(tree.levels))
    assert ("p", "x", "y") in models[2] and not models[-1]
    assert [len(b) for b in tree.back] == [len(m) for m in models]
    got = [r["score"] for r in suffix_tree.score(docs(spark, texts).withColumn("held_out", F.lit(True)), tree, table).orderBy(F.col("doc_id").asc_nulls_last()).collect()]
    assert sorted(got) == pytest.approx(sorted(want), abs=2e-5)


def test_few_scans_and_none_left_on_disk(spark, monkeypatch):
    """Once few places are left a scan takes many lengths, and its rows go when they are judged."""
    written, materialize = [], suffix_tree.materialize
    monkeypatch.setattr(suffix_tree, "materialize", lambda df, label: written.append((label, materialize(df, label))) or written[-1][1])
    chain = [f"c{i}" for i in range(40)]
    train = [" ".join([f"z{k}", *chain[-k:], f"s{k}"]) for k in range(1, 31) for _ in range(40)]
    train += [" ".join(f"u{i}v{j}" for j in range(200)) for i in range(600)]
    tree, _ = suffix_tree.learn(docs(spark, train), longest=None)
    assert len(tree.levels) > 20
    scans = [t for label, t in written if label == "scan"]  # lengths 2, 3, 4, 5 to 19 or so, and the rest; doubling alone takes 7
    assert len(scans) <= 5
    assert not any(path_exists(spark, f) for t in scans for f in t.inputFiles())
    assert tree.scores.count() > 0


def test_probabilities_add_up(spark):
    tree, _ = suffix_tree.learn(docs(spark, [prose(i, 70) for i in range(25)]))
    for depth, back in enumerate(tree.back):
        state = tree.keys[depth] // tree.size
        sums = np.bincount(state, tree.shares[depth], back.size)
        assert np.allclose(sums[np.unique(state)] + back[np.unique(state)], 1)


def test_untrained_tree(spark):
    tree, table = suffix_tree.learn(docs(spark, []))
    got = suffix_tree.score(docs(spark, AWKWARD).withColumn("held_out", F.lit(True)), tree, table).collect()
    assert len(got) == len(AWKWARD) and all(r["n_known"] == 0 and r["base_score"] == 0 for r in got)


def test_tree_beats_its_root_on_held_out_texts(spark, root):
    r = QUERIES["op3_suffix_tree"](spark, root).where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert r["s"] > r["b"]


def test_shuffle_files_of_the_tree_go_with_their_jobs(spark, monkeypatch):
    """Files of finished jobs must not pile up until the driver happens to collect its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen, plain = spark.conf.get(setting), [], suffix_tree.materialize
    monkeypatch.setattr(suffix_tree, "materialize", lambda df, label: seen.append(spark.conf.get(setting)) or plain(df, label))
    chain = "a b c d e f g".split()
    tree, _ = suffix_tree.learn(docs(spark, [" ".join([f"z{k}", *chain[-k:], f"s{k}"]) for k in range(1, 8) for _ in range(40)]), longest=None)
    assert seen and set(seen) == {"true"} and spark.conf.get(setting) == before
    # of the long contexts only states are stored
    assert len(tree.levels) > 3 and all(runs.where("back is null").isEmpty() for runs, _ in tree.levels[3:])
