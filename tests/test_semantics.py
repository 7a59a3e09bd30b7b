"""Hand-computed cases for the semantics SQL comparison on the shared tables does not reach."""

import datetime as dt
import math
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from tidemark.functions import privacy
from tidemark.functions import scalars as sc
from tidemark.operators import aggregates as ag
from tidemark.operators import cdc, filters, geo, graph, joins, ml, personal_data, quality, reshape, setops
from tidemark.operators import sampling as sm
from tidemark.operators.aggregates import Agg
from tidemark.operators.ordered import framed, group_fits, running
from tidemark.operators.windows import window_fn
from tidemark.session import scratch_path
from tidemark.sources import files as fs
from tidemark.sources.snapshots import SnapshotTable


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- aggregates ---------------------------------------------------------------------

DATA = [("nulls", None), ("nulls", None), ("one", 5.0), ("two", 1.0), ("two", 3.0), ("three", -2.0), ("three", 0.0), ("three", 2.0),
        ("ties", 1.0), ("ties", 1.0), ("ties", 2.0), ("ties", 2.0), ("ties", 9.0)]


@pytest.mark.parametrize("limit", [None, 1])
def test_small_groups(spark, limit):
    df = spark.createDataFrame(DATA, "g string, x double")
    specs = [Agg("x", f, f, p) for f, p in [("count", None), ("median", None), ("mode", None), ("mad", None), ("skewness", None), ("kurtosis", None),
                                           ("geometric_mean", None), ("harmonic_mean", None), ("iqr", None), ("percentile", 25), ("upper_median", None)]]
    out = {r.g: r for r in ag.group_aggregate(df, ["g"], specs, limit=limit).collect()}
    assert out["nulls"]["count"] is None and out["nulls"].median is None and out["nulls"].mode is None
    assert (out["one"].median, out["one"].mad, out["one"].skewness) == (5.0, 0.0, None)
    assert (out["two"].median, out["two"].percentile, out["two"].upper_median) == (2.0, 1.5, 3.0)
    assert out["three"].geometric_mean is None and out["three"].harmonic_mean is None
    assert out["three"].skewness == pytest.approx(0.0) and out["three"].kurtosis is None
    assert (out["ties"].mode, out["ties"].mad, out["ties"].iqr) == (1.0, 1.0, 1.0)


def test_kurtosis_formula(spark):
    x = [1.0, 2.0, 2.5, 7.0, 11.0, 11.5]
    n, m = len(x), sum(x) / len(x)
    s = math.sqrt(sum((v - m) ** 2 for v in x) / n)
    want = n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * sum(((v - m) / s) ** 4 for v in x) - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))
    df = spark.createDataFrame([(v,) for v in x], "x double")
    assert ag.aggregate(df, [Agg("x", "kurtosis", "k")]).first().k == pytest.approx(want)


def test_unparsable_text(spark):
    df = spark.createDataFrame([("4",), ("x",), (None,)], "v string")
    assert ag.aggregate(df, [Agg("v", "average", "m")]).first().m == 4.0
    assert ag.aggregate(df, [Agg("v", "average", "m")], coerce_zero=True).first().m == 2.0


def test_bad_quartile(spark):
    with pytest.raises(ValueError):
        ag.aggregate(spark.range(1), [Agg("id", "quartile", "q", 4)])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st_.lists(st_.tuples(st_.sampled_from("ab"), st_.integers(-5, 5)), min_size=1, max_size=40))
def test_quantiles_equal_sorted_lists(spark, data):
    df = spark.createDataFrame(data, "g string, x int")
    for r in ag.quantiles(df, ["g"], "x", [0.3]).collect():
        v = sorted(x for g, x in data if g == r.g)
        pos = 0.3 * (len(v) - 1)
        lo, hi = v[math.floor(pos)], v[math.ceil(pos)]
        assert r.q0 == pytest.approx(lo + (hi - lo) * (pos - math.floor(pos)))


# --- ordered computations -----------------------------------------------------------


def _skewed(spark):
    random.seed(1)
    data = [("hot" if random.random() < 0.7 else f"k{random.randrange(5)}", i, random.choice([None, 1.0, 2.0, 3.0])) for i in range(300)]
    return spark.createDataFrame(data, "g string, ord long, v double")


@pytest.mark.parametrize("fn,kw", [("row_number", {}), ("rank", {}), ("dense_rank", {}), ("lag", {"offset": 3}), ("lead", {"offset": 7}), ("first_value", {}), ("last_value", {}),
                                   ("cumulative_sum", {}), ("running_avg", {}), ("moving_avg", {"frame": 5}), ("ntile", {}), ("ntile", {"sql_ties": True, "buckets": 7}),
                                   ("percent_rank", {}), ("percent_rank", {"sql_ties": True}), ("cume_dist", {}), ("cume_dist", {"sql_ties": True})])
def test_split_window_equals_plain(spark, fn, kw):
    df = _skewed(spark)
    order = ["v", "ord"] if "rank" in fn or fn == "cume_dist" else ["ord"]
    got = [rows(window_fn(df, fn, "o", value="v", partition_by=["g"], order_by=order, limit=lim, **kw).select("ord", F.round(F.col("o").cast("double"), 9)), "ord") for lim in (10**6, 13)]
    assert got[0] == got[1]


def test_ntile_of_five_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "i int")
    assert [r[1] for r in rows(window_fn(df, "ntile", "t", order_by=["i"]), "i")] == [1, 1, 2, 2, 3]
    assert [r[1] for r in rows(window_fn(df, "ntile", "t", order_by=["i"], sql_ties=True), "i")] == [1, 1, 2, 3, 4]


def test_running_carries_across_chunks(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 100 == 0, F.col("id")).alias("mark"))
    out = running(df, [], ["id"], position="p", sums={"s": F.col("id")}, lasts={"m": F.col("mark")}, limit=10)
    assert rows(out.select("p", "s", "m"), "p") == [(i + 1, i * (i + 1) // 2, i // 100 * 100) for i in range(1000)]


def test_framed_copies_reach_over_block_edges(spark):
    out = framed(spark.range(100), [], ["id"], lambda w: {"s": F.sum("id").over(w.rowsBetween(-4, 3))}, before=4, after=3, limit=5)
    assert [r.s for r in out.orderBy("id").collect()] == [sum(j for j in range(i - 4, i + 4) if 0 <= j < 100) for i in range(100)]


def test_group_check_counts_the_largest_group(spark):
    df = _skewed(spark)
    assert group_fits(df, ["g"], 10**6) and not group_fits(df, ["g"], 50)


# --- sampling -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def thousand(spark):
    return spark.range(1, 1001).select("id", F.concat(F.lit("name_"), "id").alias("name"), (F.col("id") * 10.5).alias("value"),
                                       F.expr("date_add(date'2024-01-01', cast(id % 365 as int))").alias("created"))


def test_sampling_strategies(spark, thousand):
    kw = dict(key=["id"], max_full_rows=100)
    assert sm.sample(thousand, "head", 50, **kw).agg(F.min("id"), F.max("id"), F.count("id")).first()[:] == (1, 50, 50)
    assert sm.sample(thousand, "tail", 50, **kw).agg(F.max("id"), F.count("id")).first()[:] == (1000, 50)
    assert sm.sample(thousand, "query", 10_000, where="id <= 100", **kw).count() == 100
    assert sm.sample(thousand, "random", 100, **kw).count() == 100
    assert sm.sample(thousand, "random", 5000, **kw).count() == 1000
    assert sm.sample(thousand, "full", 5, **kw).count() == 1000
    assert sm.sample(thousand, "recent", 10, date_col="created", **kw).agg(F.min("created")).first()[0] > dt.date(2024, 12, 20)
    assert sm.sample(thousand.where("id <= 50"), "random", 10, **kw).count() == 50
    assert sm.sample(thousand, "tail", 5, **kw).columns == thousand.columns


def test_random_sample_is_repeatable_and_seeded(thousand):
    ids = lambda seed: {r.id for r in sm.random_rows(thousand, 60, ["id"], seed).collect()}
    assert ids(1) == ids(1) and ids(1) != ids(2)


def test_stratified_with_null_and_tiny_strata(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") == 0, "solo").when(F.col("id") <= 10, "ten").when(F.col("id") == 11, None).otherwise("big").alias("s"))
    got = {r.s: r.n for r in sm.sample(df, "stratified", 100, key=["id"], stratify_col="s", max_full_rows=10).groupBy("s").agg(F.count("id").alias("n")).collect()}
    assert got == {"solo": 1, "ten": 1, None: 1, "big": 99}


def test_dedup_null_and_delimiter_keys(spark):
    df = spark.createDataFrame([("a|b", "c", 1), ("a", "b|c", 2), (None, "x", 3), ("NULL", "x", 4), (None, "x", 5)], "a string, b string, i int")
    assert [r[2] for r in rows(sm.dedup(df, ["a", "b"], order_by=["i"]), "i")] == [1, 2, 3, 4]
    assert [r[2] for r in rows(sm.dedup(df, ["a", "b"], "last", order_by=["i"]), "i")] == [1, 2, 4, 5]
    assert sm.dedup_counts(df, ["a", "b"]).first()[:] == (5, 4, 1)


# --- privacy ------------------------------------------------------------------------

TEXTS = ["mail bob.smith@example.com or (555)123-4567", "ssn 123-45-6789 ip 10.0.0.255 zip 12345-6789", "card 4111 1111 1111 1234 and 4111-1111-1111-9999!", "ab@x.io", "nothing here", ""]


def _python_mask(text, change):
    for name, pattern in privacy.PATTERNS.items():
        text = re.sub(pattern, lambda m: change(name, m.group(0)), text)
    return text


def test_text_masks_equal_python(spark):
    import hashlib

    def partial(name, v):
        digits = re.sub(r"\D", "", v)
        if name == "Email":
            u, h = v.split("@")
            return (u[0] + "*" * (len(u) - 2) + u[-1] if len(u) > 2 else "*" * len(u)) + "@" + h
        if name == "Phone":
            return "*" * (len(digits) - 4) + digits[-4:]
        if name == "CreditCard":
            return "**** **** **** " + digits[-4:]
        return "***-**-" + v[-4:] if name == "SSN" else "*" * (len(v) - 4) + v[-4:]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    want = {
        "redact": lambda n, v: f"[{n}]", "remove": lambda n, v: "", "partial": partial,
        "hash": lambda n, v: f"[{n}:{hashlib.sha256(v.encode()).hexdigest().upper()[:8]}]",
    }
    for strategy, change in want.items():
        got = [r[1] for r in rows(df.select("i", privacy.mask_pii(F.col("t"), strategy)), "i")]
        assert got == [_python_mask(t, change) for t in TEXTS], strategy


def test_spans_equal_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    want = sorted((i, n, m.group(0), m.start(), m.end() - m.start()) for i, t in enumerate(TEXTS) for n, p in privacy.PATTERNS.items() for m in re.finditer(p, t))
    assert sorted(r[:5] for r in rows(personal_data.spans(df, ["i"], "t"))) == want


def test_policy_masks(spark):
    df = spark.createDataFrame([("abcd",), ("abcde",), (None,)], "v string")
    assert [r[0] for r in rows(df.select(privacy.policy_partial(F.col("v"))))] == ["***", "ab*de", None]
    assert [r[0] for r in rows(df.select(privacy.mask_keep_first(F.col("v"), 4)))] == ["abcd", "abcd*", None]


# --- scalars, filters, reshape ------------------------------------------------------


def test_json_flatten_and_edit(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 1, "c": [true, {"d": "x"}]}, "e": {}, "n": null}'), (2, "not json"), (3, None), (4, "[[1], 2]")], "id int, j string")
    got = sorted(r[:3] for r in rows(sc.json_flatten(df, ["id"], "j")) if r[3] is False and r[2] is not None)
    assert got == [(1, "a.b", "1"), (1, "a.c[0]", "true"), (1, "a.c[1].d", "x"), (4, "[0][0]", "1"), (4, "[1]", "2")]
    cut = [r for r in rows(sc.json_flatten(df, ["id"], "j", max_depth=1)) if r[3]]
    assert (1, "a.b", "1", False) not in cut and any(r[1] == "a" for r in cut)
    edit = lambda *e: df.where("id = 1").select(sc.json_edit(F.lit('{"x":1,"y":2}'), e)).first()[0]
    assert edit(("rename", "x", "z")) == '{"y":2,"z":1}' and edit(("rename", "q", "z")) == '{"x":1,"y":2}' and edit(("remove", "y"), ("add", "x", "5")) == '{"x":5}'


def test_predicate_quotes_and_nulls(spark):
    df = spark.createDataFrame([("O'Hara", 1), (None, 2), ("x%", 3)], "Name string, n int")
    assert df.where(filters.predicate(("Name", "=", "O'Hara"))).first().n == 1
    assert df.where(filters.predicate({"or": [("Name", "is_null"), {"and": [("n", ">", 2), ("Name", "in", ["x%"])]}]})).count() == 2
    assert filters.select_columns(df, "pattern", patterns=["N?ME"]).columns == ["Name"]


def test_pivot_null_label_and_missing_cells(spark):
    df = spark.createDataFrame([("k", "a", 1.0), ("k", None, 2.0), ("m", "a", None)], "k string, p string, v double")
    out = {r.k: r for r in reshape.pivot(df, ["k"], "p", {"v": "count"}).collect()}
    assert out["k"].asDict() == {"k": "k", "NULL": 1, "a": 1} and out["m"]["a"] is None
    assert reshape.unpivot(df.where("v is null"), ["k"], ["v"]).first().value is None
    with pytest.raises(ValueError):
        reshape.transpose(spark.range(20), ["id"], max_rows=10)


def test_cosine(spark):
    one = spark.range(1)
    v = lambda *x: F.array(*map(F.lit, x))
    assert one.select(sc.cosine_similarity(v(1.0, 0.0), v(0.0, 0.0))).first()[0] == 0.0
    with pytest.raises(Exception, match="lengths differ"):
        one.select(sc.cosine_similarity(v(1.0), v(1.0, 2.0))).collect()


# --- joins, graph, geo --------------------------------------------------------------


def test_lookup_pages_keep_every_match(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.range(25).select(F.lit(1).alias("k"), "id")
    out = rows(joins.lookup(left, right, "k", "k", "m", order_by=["id"], page_rows=10).select("k", "page", F.size("m")), "k", "page")
    assert out == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 0)]


def test_range_join_salts_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 7)
    p, i = spark.range(200).select("id", (F.col("id") % 40 / 2).alias("x")), spark.createDataFrame([(0, 3.0, 9.0), (1, 8.5, 8.5), (2, 19.0, 40.0)], "iv int, a double, b double")
    got = rows(joins.range_join(p, i, F.col("x"), F.col("a"), F.col("b"), 5.0, point_id=F.col("id")).select("iv", "id"))
    want = [(iv, n) for iv, a, b in ((0, 3, 9), (1, 8.5, 8.5), (2, 19, 40)) for n in range(200) if a <= n % 40 / 2 <= b]
    assert sorted(got) == sorted(want)


def test_radius_join_at_poles_and_date_line(spark, monkeypatch):
    monkeypatch.setattr(geo, "HOT_ROWS", 3)
    random.seed(3)
    pts = [(i, random.uniform(-90, 90), random.uniform(-180, 180)) for i in range(150)] + [(200, 89.9, 10.0), (201, 89.9, -170.0), (202, 0.0, 180.0), (203, 0.0, -180.0), (204, 0.1, 179.9), (205, -90.0, 0.0)]

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 6371.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    a = spark.createDataFrame(pts, "i int, lat double, lon double")
    got = {r[:2] for r in rows(geo.radius_join(a, a.withColumnRenamed("i", "j"), 900, a_id="i", b_id="j"))}
    assert got == {(x[0], y[0]) for x in pts for y in pts if km(x, y) <= 900}


def test_paths_cycles_and_levels(spark):
    e = spark.createDataFrame([("e1", "a", "b"), ("e2", "b", "c"), ("e3", "a", "c"), ("e4", "c", "a"), ("e5", "b", "c"), ("e6", "d", "d")], "edge_id string, src string, dst string")
    got = [tuple(r) for r in graph.find_paths(e, "a", "c", 2).collect()]
    assert got == [(1, "a>c", "e3"), (2, "a>b>c", "e1>e2"), (2, "a>b>c", "e1>e5")]
    assert rows(graph.find_cycles(e), "component", "step") == [("a", 3, 4, 0, "a"), ("a", 3, 4, 1, "b"), ("a", 3, 4, 2, "c"), ("d", 1, 1, 0, "d")]
    nodes = spark.createDataFrame([(n,) for n in "abcx"], "id string")
    assert rows(graph.dependency_levels(nodes, e.where("edge_id in ('e1','e2','e3')")), "node") == [("a", 2), ("b", 1), ("c", 0), ("x", 0)]
    with pytest.raises(Exception, match="cycle in the dependency graph"):
        graph.dependency_levels(nodes, e).collect()
    assert rows(graph.neighbors(e, "a", 1), "node") == [("b",), ("c",)]


def test_json_flatten_has_no_depth_limit(spark):
    df = spark.createDataFrame([(1, '{"a":' * 12 + "7" + "}" * 12)], "id int, j string")
    assert [tuple(r) for r in sc.json_flatten(df, ["id"], "j").collect()] == [(1, ".".join("a" * 12), "7", False)]


# --- change data, snapshots, files --------------------------------------------------


def test_apply_changes_edge_cases(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    ch = spark.createDataFrame([(1, "I", 1, "again"), (2, "D", 9, None), (3, "U", 2, "x"), (4, "U", 2, "y"), (5, "D", 3, None), (6, "I", 3, "back"), (7, "U", 8, "no")],
                               "change_id int, op string, k int, v string")
    out, counts = cdc.apply_changes(target, ch, ["k"])
    assert rows(out, "k") == [(1, "again"), (2, "y"), (3, "back")]
    assert sorted(map(tuple, counts.collect())) == [("D", "failed", 1), ("I", "applied", 2), ("U", "applied", 1), ("U", "failed", 1)]


def test_merge_modes(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, None, 1)], "k int, v string, n int")
    s = spark.createDataFrame([(1, "A", 5, "UPSERT"), (2, "B", 0, "DELETE"), (4, "D", 1, "UPSERT"), (5, "E", 1, "DELETE")], "k int, v string, n int, action string")
    assert rows(cdc.merge(t, s.drop("action"), ["k"], update=["v"]), "k") == [(1, "A", 1), (2, "B", 1), (3, None, 1), (4, "D", 1), (5, "E", 1)]
    assert rows(cdc.merge(t, s, ["k"], action="action", when=F.col("s.n") > 9), "k") == [(1, "a", 1), (3, None, 1), (4, "D", 1)]


def test_snapshot_commits_are_exclusive(spark, monkeypatch):
    table = SnapshotTable(spark, scratch_path(spark, "exclusive"))
    assert table.write(spark.range(3)) == 1 and table.write(spark.range(5)) == 2
    # a writer that saw an old log gets the next free number
    monkeypatch.setattr(table, "_next", lambda: 2)
    assert table.write(spark.range(9)) == 3
    monkeypatch.undo()
    assert table.read(2).count() == 5 and table.read(1).count() == 3
    assert not table._create(f"{table.root}/manifest/{1:020d}.json", "other") and table.read(1).count() == 3
    table.delete(1, 3)
    gone = table.vacuum(0, now=dt.datetime.now(dt.timezone.utc) + dt.timedelta(hours=1))
    assert len(gone) == 2 and table.read().count() == 5
    with pytest.raises(ValueError):
        table.read(1)
    # data that a clone points at outlives the source's version
    copy = table.clone_to(scratch_path(spark, "clone"))
    table.write(spark.range(2))
    table.prune(1)
    table.vacuum(0, now=dt.datetime.now(dt.timezone.utc) + dt.timedelta(hours=1))
    assert copy.read().count() == 5 and table.read().count() == 2


def test_null_keys_and_repeated_source_keys(spark):
    t = spark.createDataFrame([(1, 10), (None, 5)], "k int, v int")
    assert sorted(map(tuple, cdc.merge(t, spark.createDataFrame([(None, 6), (2, 20)], "k int, v int"), ["k"]).collect()), key=str) == [(1, 10), (2, 20), (None, 6)]
    for twice in ([(1, 20), (1, 30)], [(None, 1), (None, 2)]):
        with pytest.raises(Exception, match="several source rows for one key"):
            cdc.merge(t, spark.createDataFrame(twice, "k int, v int"), ["k"]).collect()
    same = spark.createDataFrame([(1, 11), (None, 5)], "k int, v int")
    assert [tuple(r) for r in cdc.diff(t, same, ["k"]).collect()] == [("U", 1, 11)]
    assert [tuple(r) for r in setops.compare_tables(t, same, ["k"]).collect()] == [(1, "different")]
    changes = spark.createDataFrame([("U", None, 7, 1)], "op string, k int, v int, change_id int")
    after, counts = cdc.apply_changes(t, changes, ["k"])
    assert sorted(map(tuple, after.collect()), key=str) == [(1, 10), (None, 7)] and [tuple(r) for r in counts.collect()] == [("U", "applied", 1)]


def test_exact_decimals_and_unknown_keys(spark):
    df = spark.createDataFrame([("1,234.5", "9223372036854775807"), ("12345678901234567890.25", "9223372036854775808"), ("0.12345678901234", "7")], "d string, i string")
    got = quality.apply_schema(df, {"d": "Decimal", "i": "Integer"}).collect()
    assert [str(r.d) for r in got] == ["1234.500000000000", "12345678901234567890.250000000000", "None"]
    assert [r.i for r in got] == [2**63 - 1, None, 7] and [sorted(r._rejected) for r in got] == [[], ["i"], ["d"]]
    tests = df.select(*[sc.type_tests(F.col("i"))[k].alias(k) for k in ("Integer", "Decimal")]).collect()
    assert [tuple(r) for r in tests] == [(True, True), (False, True), (True, True)]
    keys = spark.createDataFrame([(1, "0123456789abcdef")], "kid int, secret string")
    secret = spark.createDataFrame([(1, "a"), (2, "b")], "kid int, v string")
    with pytest.raises(Exception, match="no encryption key 2"):
        personal_data.encrypt_column(secret, "v", keys, "kid", "c").collect()


def test_codec_advice_counts_bytes(spark):
    df = spark.createDataFrame([("é" * 50,)], "v string")
    assert fs.codec_advice(df).first().entropy == pytest.approx(1 / 8) and fs.codec_advice(df).first()["size"] == 100
    with pytest.raises(ValueError, match="unknown codec"):
        fs.export_table(df, scratch_path(spark, "codec"), compression="brotli")


def test_choose_k_of_a_short_range(spark):
    points = spark.createDataFrame([([float(i % 3), float(i % 2)],) for i in range(30)], "v array<double>")
    for low, high in ((2, 2), (2, 3)):
        assert sum(r.chosen for r in ml.choose_k(ml.vectors(points, "v"), low, high).collect()) == 1


def test_copy_into_rejects_and_ledger(spark, tmp_path):
    src, table = tmp_path / "src", str(tmp_path / "table")
    src.mkdir()
    (src / "a.csv").write_text("id,v\n1,x\nbad,y\n3,z\n")
    schema = spark.range(1).select(F.col("id"), F.lit("").alias("v")).schema
    assert fs.copy_into(spark, table, str(src), schema, max_errors=1) == {"files": 1, "loaded": 2, "rejected": 1}
    assert fs.copy_into(spark, table, str(src), schema, max_errors=1)["files"] == 0
    (src / "b.csv").write_text("id,v\nno,x\n")
    with pytest.raises(ValueError):
        fs.copy_into(spark, table, str(src), schema, max_errors=0)
    spark.createDataFrame([(9, "dead")], schema).write.parquet(f"{table}/data/load=died-before-commit")
    assert sorted(r.id for r in fs.read_loaded(spark, table).collect()) == [1, 3]


def test_table_choice():
    names = ["Orders", "customer", "part"]
    assert fs.choose_tables(names, ["ORDERS"], ["part"], []) == ["Orders"]
    assert fs.choose_tables(names, None, ["part", "Customer"], ["PART"]) == ["customer"]
    assert fs.choose_tables(names, None, None, ["part"]) == ["Orders", "customer"]


# --- quality and schema -------------------------------------------------------------


def test_rules_pass_nulls_and_count_rows_once(spark):
    df = spark.createDataFrame([(1, "a@b.c", 5.0), (2, None, 50.0), (3, "bad", 500.0)], "id int, mail string, x double")
    rules = [quality.Rule("mail", "pattern", pattern=sc.EMAIL), quality.Rule("x", "range", 0, 100), quality.Rule("mail", "length", 4, 20)]
    assert rows(quality.violations(df, ["id"], rules).select("id", "rule"), "rule") == [(3, "length:mail"), (3, "pattern:mail"), (3, "range:x")]
    s = quality.validation_summary(df, rules).first()
    assert (s.total, s.valid, s.invalid, s.violations) == (3, 2, 1, 3)


def test_inference_classes_and_threshold(spark):
    data = [("true", "1", "1.5", "2024-01-02", "6f9619ff-8b86-d011-b42d-00c04fc964ff", "a@b.co", "http://x.y/z", '{"a":1}', "1", None),
            ("N", "-20", "2", "2024-01-02 03:04:05", "6F9619FF-8B86-D011-B42D-00C04FC964FF", "c@d.org", "ftp://h", "[1]", "word", None)]
    names = ["boolean", "integer", "decimal", "datetime", "guid", "email", "url", "json", "half", "empty"]
    got = {r["column"]: (r.inferred, r.confidence) for r in quality.infer_schema(spark.createDataFrame(data, ", ".join(f"{n} string" for n in names))).collect()}
    assert got == {"boolean": ("Boolean", 1.0), "integer": ("Integer", 1.0), "decimal": ("Decimal", 1.0), "datetime": ("DateTime", 1.0), "guid": ("Guid", 1.0), "email": ("Email", 1.0),
                   "url": ("Url", 1.0), "json": ("Json", 1.0), "half": ("Boolean", 0.5), "empty": ("String", 0.0)}


def test_every_trainer_and_task_is_registered(spark, root, monkeypatch):
    from tidemark.plans import QUERIES, learning

    monkeypatch.setattr(learning, "ROUNDS", 1)
    got = {r["trainer"]: r for r in QUERIES["compare_multiclass_classifiers"](spark, root).collect()}
    assert set(got) == {"max_entropy", "max_entropy_l1", "forest", "one_vs_rest_gbt"}
    assert got["one_vs_rest_gbt"]["micro_accuracy"] > 0 and 0 < got["one_vs_rest_gbt"]["log_loss"] < 10
