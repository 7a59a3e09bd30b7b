"""Clusters and whitened vectors against plain versions."""

import hashlib
from collections import defaultdict
from math import floor

import numpy as np
import pytest

from tidemark.llm import clustering, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, x string, k string, cluster string"
BAD = [(900, None), (901, []), (902, [1.0] * 5), (903, [None] * 6), (904, [float("nan")] + [0.0] * 5), (905, [float("-inf")] + [0.0] * 5)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(v, x if x is None else [None if c is None else float(c) for c in x], "a", "b", "c") for v, x in rows], SCHEMA).repartition(parts)


def sample(seed, n, d=6):
    r = np.random.RandomState(seed)
    return [(i, (r.randn(d) + 3 * r.randint(0, 3, d)).astype("f4").tolist()) for i in range(n)]


def good(rows, size=None):
    return [(v, x) for v, x in rows if x is not None and all(c is not None and np.isfinite(c) for c in x) and (size is None or len(x) == size)]


def plain_clusters(rows, k, rounds, size):
    vs = [(v, [floor(64 * float(c)) for c in x]) for v, x in good(rows, size)]
    name = lambda v: (v is None, hashlib.sha256(f"1:{v}".encode()).hexdigest())
    centres = [x for _, x in sorted(((name(v), x) for v, x in vs))][:k]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, x in vs:
            of[near(x)[1]].append(x)
        centres = [[sum(c) // len(of[i]) for c in zip(*of[i])] if i in of else centres[i] for i in range(len(centres))]
    return sorted((v is None, v or 0, *reversed(near(x))) for v, x in vs), centres


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_clusters_equal_brute_force(spark, rounds):
    rows = sample(1, 150) + [(300 + i, [0.5] * 6) for i in range(60)] + [(None, [9.0, 1, 1, 1, 1, 1]), (7, [5.0, 1, 1, 1, 1, 1]), (7, [5.0, 1, 1, 1, 1, 2]), (600, [2e5, -1e5, 0, 0, 0, 0])] + BAD
    got, centres = clustering.cluster(frame(spark, rows), 9, rounds, 6)
    want, plain_centres = plain_clusters(rows, 9, rounds, 6)
    assert centres.tolist() == plain_centres
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"]) for r in got.collect()) == want
    out = clustering.report(got, centres).collect()
    assert len(out) == len(want)
    for r in out:
        assert r["inertia"] == sum(w[3] for w in want) and r["cluster_inertia"] == sum(w[3] for w in want if w[2] == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, plain_centres[r["cluster"]])).encode()).hexdigest()


def test_few_vectors_and_none(spark):
    got, centres = clustering.cluster(frame(spark, sample(2, 3)), 16, 3, 6)
    assert len(centres) == 3 and sorted(r["distance"] for r in got.collect()) == [0, 0, 0]
    got, centres = clustering.cluster(frame(spark, [*BAD], 1).limit(0), 16, 3, 6)
    assert clustering.report(got, centres).count() == 0 and not len(centres)
    assert clustering.report(*clustering.cluster(frame(spark, BAD), 16, 3, 6)).count() == 0


def test_large_components_are_exact(spark):
    far = [(1, [3e7] + [0.0] * 5), (2, [-3e7] + [0.0] * 5), (3, [3e7, 1.0] + [0.0] * 4)]
    got, centres = clustering.cluster(frame(spark, far), 2, 2, 6, factor=1.0)
    want, plain = plain_clusters([(v, [c / 64 for c in x]) for v, x in far], 2, 2, 6)
    assert centres.tolist() == plain and sorted((False, r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()) == want
    wide = np.array([[2**40, 1], [-(2**40), 3]])
    number, distance = clustering.Neighbours(wide).nearest(wide, np.array([1, 0]))
    assert number.tolist() == [0, 1] and [int(x) for x in distance] == [0, 0]
    with pytest.raises(OverflowError):
        vectors.floored(np.array([1e30]), 64.0)


def test_orchard_finds_the_nearest_and_skips_some():
    r = np.random.RandomState(5)
    centres = r.randint(-50, 50, (40, 4)) * np.array([[20, 1, 1, 1]])
    centres[7] = centres[3]
    x = centres[r.randint(0, 40, 500)] + r.randint(-9, 9, (500, 4))
    to = clustering.Neighbours(centres)
    d = ((x[:, None] - centres[None]) ** 2).sum(2)
    number, best = to.nearest(x, r.randint(0, 40, 500))
    assert (number == d.argmin(1)).all() and (best == d.min(1)).all()


def plain_whitening(rows, components, repeats=True):
    vs = [(v, [floor(1024 * float(c)) + 100_000 for c in x]) for v, x in good(rows)]
    out = []
    for d in {len(x) for _, x in vs}:
        own = [(v, x) for v, x in vs if len(x) == d]
        fit = [x for _, x in own] if repeats else sorted({tuple(x) for _, x in own})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        centred = np.array([[n * a - b for a, b in zip(x, s)] for x in fit], float).reshape(n, d) / n
        e, axes = np.linalg.eigh(centred.T @ centred / n) if d else (np.zeros(0), np.zeros((0, 0)))
        e, axes = e[::-1], axes[:, ::-1]
        for v, x in own:
            dev = [n * a - b for a, b in zip(x, s)]
            w = np.array(dev, float) / n @ axes
            out += [(v is None, v or 0, x, i + 1, n, sum(c * c for c in dev), w[i], e[i], e.sum()) for i in range(min(components, d))]
    return out


@pytest.mark.parametrize("repeats", [True, False])
def test_whitening_equals_numpy(spark, repeats):
    rows = sample(3, 120, 9) + [(500 + i, [0.25] * 9) for i in range(70)] + [(None, [1.0] * 9), (5, [2.0] * 9)] + [r for r in BAD if r[0] != 902]
    got = whitening.whiten(frame(spark, rows), repeats=repeats).collect()
    want = plain_whitening(rows, 8, repeats)
    assert len(got) == len(want) == 8 * 192
    key = lambda v, c, dev: (v is None, v or 0, c, dev)
    by = {key(r["vec_id"], r["component"], int(r["deviation"])): r for r in got}
    signs = {}
    for null, v, _, c, n, dev, w, e, trace in want:
        r = by[(null, v, c, dev)]
        assert r["n"] == n and abs(r["explained"] - e / trace) < 1e-9 * (e / trace) and r["identity_error"] < 1e-9
        sign = signs.setdefault(c, 1 if r["whitened"] * w >= 0 else -1) if abs(w) > 1e-6 else signs.get(c, 0)
        assert abs(r["whitened"] - sign * w / np.sqrt(e)) < 1e-6 or not sign


def test_whitening_of_sizes_without_variance_and_empty(spark):
    rows = [(i, x) for i, (_, x) in enumerate(sample(4, 30, 3) + sample(5, 20, 6))] + [(100 + i, [1.0, 2.0]) for i in range(5)] + [(200, [4.0])] + BAD[:2]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 30 * 3 + 20 * 6 + 5 * 2 + 1
    assert all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] is None for r in got if r["vec_id"] >= 100)
    assert {r["n"] for r in got} == {30, 20, 5, 1}
    assert whitening.whiten(frame(spark, BAD, 1).limit(0)).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [float("nan")])])).count() == 0


def test_large_groups_go_by_broadcast(spark, monkeypatch):
    rows = [(i, [1.0, float(i % 3)]) for i in range(300)] + [(i, [float(i), 0.0]) for i in range(300, 340)]
    want = sorted(whitening.whiten(frame(spark, rows)).select("vec_id", "component", "deviation").collect())
    monkeypatch.setattr(whitening, "HOT_PER_TASK", 10**6)
    assert sorted(whitening.whiten(frame(spark, rows)).select("vec_id", "component", "deviation").collect()) == want and len(want) == 680
