"""Levels, components and witness cycles against plain versions."""

import random

import pytest

from tidemark.operators import graph

SCHEMA = "src int, dst int"


def frame(spark, pairs):
    return spark.createDataFrame([*pairs], SCHEMA)


def plain_components(pairs):
    after = {}
    for a, b in pairs:
        if a is not None and b is not None:
            after.setdefault(a, set()).add(b)

    def reach(start):
        seen, left = set(), list(after.get(start, ()))
        while left:
            n = left.pop()
            if n not in seen:
                seen.add(n)
                left.extend(after.get(n, ()))
        return seen

    to = {n: reach(n) for n in after}
    on = [n for n in after if n in to[n]]
    return {n: min(m for m in on if m == n or (m in to[n] and n in to[m])) for n in on}


def random_graph(seed):
    r = random.Random(seed)
    n = r.choice([6, 15, 40])
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(int(n * r.choice([0.8, 1.1, 1.6])))]
    at = 100
    for _ in range(4):  # chains and rings that leave the core and come back to it or not
        size = r.randint(1, 9)
        pairs += [(at + i, at + i + 1) for i in range(size)]
        pairs += [(r.randrange(n), at)] * r.randint(0, 1) + [(at + size, r.choice([at, at + size // 2, r.randrange(n)]))] * r.randint(0, 1)
        at += 20
    return pairs + [(None, 1), (2, None)]


@pytest.mark.parametrize("seed", range(2))
def test_components_and_cycles_of_random_graphs(spark, seed):
    # several graphs at once, apart by their numbers
    pairs = [(a if a is None else a + 1000 * k, b if b is None else b + 1000 * k) for k in range(6) for a, b in random_graph(seed * 10 + k)]
    want = plain_components(pairs)
    assert {r["node"]: r["component"] for r in graph.strongly_connected(frame(spark, pairs)).collect()} == want
    edges, by = set(pairs), {}
    for r in graph.find_cycles(frame(spark, pairs)).collect():
        by.setdefault(r["component"], {})[r["step"]] = r
    assert set(by) == set(want.values())
    for component, steps in by.items():
        cycle = [steps[i]["node"] for i in range(len(steps))]
        assert len(set(cycle)) == len(cycle) and cycle[0] == min(cycle) and all(want[n] == component for n in cycle)
        assert all((a, b) in edges for a, b in zip(cycle, cycle[1:] + cycle[:1], strict=True))
        members = {n for n, c in want.items() if c == component}
        assert {(r["nodes"], r["edges"]) for r in steps.values()} == {(len(members), len({(a, b) for a, b in edges if a in members and b in members}))}


def plain_levels(nodes, pairs):
    after = {n: [] for n in nodes}
    for a, b in pairs:
        if a != b:
            after.setdefault(a, []).append(b)
            after.setdefault(b, [])
    level = {}

    def of(n):
        if n not in level:
            level[n] = max((of(m) + 1 for m in after[n]), default=0)
        return level[n]

    return {n: of(n) for n in after}


@pytest.mark.parametrize("seed", [2])
def test_levels_of_random_graphs(spark, seed):
    r = random.Random(seed)
    n = 80
    pairs = [tuple(sorted(r.sample(range(n), 2), reverse=True)) for _ in range(r.choice([60, 110, 200]))] + [(5, 5)]
    pairs += [(200 + i, 201 + i) for i in range(30)] + [(230, 3), (231, 210)]
    pairs += [(n + 1 + i, (n + 1 + i) // 2 + 20) for i in range(40)]
    nodes = [*range(n), 999]
    got = graph.dependency_levels(spark.createDataFrame([(i,) for i in nodes], "id int"), frame(spark, pairs))
    assert {x["node"]: x["level"] for x in got.collect()} == plain_levels(nodes, pairs)


def test_chains_and_rings_of_thousands(spark, monkeypatch):
    """Rounds grow with the logarithm of the length."""
    n, written = 5_000, []
    plain = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: written.append(label) or plain(df, label))
    chain = frame(spark, [(i, i + 1) for i in range(n)])
    nodes = spark.range(n + 1).selectExpr("cast(id as int) id")
    assert {r["node"]: r["level"] for r in graph.dependency_levels(nodes, chain).collect()} == {i: n - i for i in range(n + 1)}
    assert len(written) < 40
    assert graph.find_cycles(chain).count() == 0
    written.clear()
    ring = frame(spark, [(i, (i * 1 + 1) % n) for i in range(n)] + [(17, 9_000), (9_001, 17)])
    rows = {r["step"]: r for r in graph.find_cycles(ring).collect()}
    assert [rows[i]["node"] for i in range(n)] == list(range(n)) and len(rows) == n
    assert {(r["component"], r["nodes"], r["edges"]) for r in rows.values()} == {(0, n, n)}
    assert len(written) < 120
    with pytest.raises(ValueError, match="cycle in the dependency graph"):
        graph.dependency_levels(nodes, ring)


def test_no_edges(spark):
    none = frame(spark, [(1, 2)]).limit(0)
    assert graph.find_cycles(none).count() == 0 and graph.strongly_connected(none).count() == 0
    nodes = spark.createDataFrame([(1,), (2,)], "id int")
    assert sorted(map(tuple, graph.dependency_levels(nodes, none).collect())) == [(1, 0), (2, 0)]
    assert graph.dependency_levels(nodes.limit(0), none).count() == 0


@pytest.mark.parametrize("pairs", [[(0, 1), (1, 2), (2, 1)], [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)], [(1, 2), (1, 3), (2, 4), (4, 1), (3, 5)]])
def test_cycles_have_no_levels(spark, pairs):
    with pytest.raises(ValueError, match="cycle in the dependency graph"):
        graph.dependency_levels(spark.createDataFrame([(0,)], "id int"), frame(spark, pairs))


def test_levels_do_not_seek_repeated_edges_first(spark, monkeypatch):
    """The edges are stored as they come, and the first round stores no table of all nodes."""
    plans, plain = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or plain(df, label))
    pairs = [(1, 2), (1, 2), (2, 3), (2, 3), (4, 1), (4, 3), (4, 1), (5, 4), (5, 4), (6, 6), (None, 2), (7, None)]
    got = graph.dependency_levels(spark.createDataFrame([(9,), (9,)], "id int"), frame(spark, pairs))
    assert {r["node"]: r["level"] for r in got.collect()} == {3: 0, 2: 1, 1: 2, 4: 3, 5: 4, 9: 0} and got.count() == 6
    assert [label for label, _ in plans[:2]] == ["live", "degrees"] and "Exchange" not in plans[0][1]
