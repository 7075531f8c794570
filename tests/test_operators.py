import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandwise.functions import sequences as S
from strandwise.operators import align, graph, identity, metrics, ridge


def test_identity_counts_columns_that_are_not_gaps_in_both():
    assert align.identity("AC--", "AT--") == 0.5
    with pytest.raises(ValueError):
        align.identity("---", "---")


@settings(max_examples=40, deadline=None)
@given(st.text("ACDE", min_size=3, max_size=5), st.text("-ACDE", min_size=6, max_size=6))
def test_projection_is_the_best_gap_placement(raw, reference):
    from itertools import combinations

    found = {}
    for gaps in combinations(range(6), 6 - len(raw)):
        it = iter(raw)
        s = "".join("-" if i in gaps else next(it) for i in range(6))
        found[s] = sum(a != b for a, b in zip(s, reference, strict=True))
    cost, strings = align.project(raw, reference)
    assert cost == min(found.values())
    assert strings == sorted(s for s, c in found.items() if c == cost)[:2]


def _pad(s):
    return s.ljust(S.LENGTH, "-")


def test_edges_find_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("ACDEF"), 30))
    seqs = set()
    for _ in range(120):
        x = list(base)
        for p in rng.integers(0, 30, rng.integers(0, 8)):
            x[p] = rng.choice(list("ACDEF"))
        seqs.add(_pad("".join(x)[: rng.integers(20, 31)]))
    seqs = sorted(seqs)
    df = spark.createDataFrame([(s, f"p{i:03d}", 1) for i, s in enumerate(seqs)], "aligned string, rep string, n long")
    for t in (0.7, 0.85):
        mine = {(r.a, r.b) for r in identity.edges(df, t).collect()}
        true = {(f"p{i:03d}", f"p{j:03d}") for i in range(len(seqs)) for j in range(i + 1, len(seqs)) if align.identity(seqs[i], seqs[j]) + 1e-12 >= t}
        assert mine == true


def test_nearest_ignores_the_own_fold(spark):
    d = spark.createDataFrame([(_pad("AAAA"), 1, "p1", 1, 1.0, 0.0), (_pad("AAAT"), 1, "p2", 1, 2.0, 0.0), (_pad("AAAC"), 2, "p3", 1, 3.0, 0.0), (_pad("CCCC"), 2, "p4", 2, 8.0, 0.0)], "aligned string, fold int, first_id string, n long, s1 double, s2 double")
    got = {(r.aligned[:4], r.fold): r for r in identity.nearest(d, d).collect()}
    assert got["AAAA", 1].first_id == "p3" and got["AAAA", 1].identity == 0.75
    assert got["CCCC", 2].identity == 0 and got["CCCC", 2].ties == 2


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(20)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in p and p[0] != p[1] for p in pairs)}


def test_greedy_folds_rule(spark):
    sizes = [("a", 40), ("b", 34), ("c", 16), ("d", 12), ("e", 4), ("f", 4), ("g", 3), ("h", 2), ("i", 2)] + [(f"s{k}", 1) for k in range(8)]
    load, want = [0, 0, 0], {}
    for root, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        k = load.index(min(load))
        load[k] += size
        want[root] = k + 1
    got = {r.root: r.fold for r in graph.greedy_folds(spark.createDataFrame(sizes, "root string, size long")).collect()}
    assert got == want and sorted(load, reverse=True) == [42, 42, 41]


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 20), max_size=8), st.integers(2, 5))
def test_fold_plan_is_the_sequential_rule(histogram, folds):
    load, want, got = [0] * folds, [], []
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            k = load.index(min(load))
            load[k] += size
            want.append(k + 1)
    for size, _, segments in graph._fold_plan(list(histogram.items()), folds):
        for k in range(histogram[size]):
            first, turn = [s for s in segments if s[0] <= k][-1]
            got.append(turn[(k - first) % len(turn)])
    assert got == want


def test_folds_of_nothing(spark):
    assert graph.greedy_folds(spark.createDataFrame([], "root string, size long")).count() == 0


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_parse_replicates(spark):
    rows = [("12.5", False), (">280000", True), (">1,000", True), (None, False), ("  ", True), ("inactive", True), ("7", True), ("-1", False)]
    df = spark.createDataFrame(rows, "cell string, is_text boolean")
    status, value, bound = S.parse_replicate(F.col("cell"), F.col("is_text"))
    got = [tuple(r) for r in df.select(status, value, bound).collect()]
    assert got == [("observed", 12.5, None), ("right_censored", None, 280000.0), ("right_censored", None, 1000.0), ("missing", None, None), ("missing", None, None), ("error", None, None), ("error", None, None), ("error", None, None)]


def test_censor_and_constraint_losses(spark):
    df = spark.createDataFrame([("lower_bound", 3.0, 4.0), ("lower_bound", 3.0, 2.5), ("exact", 3.0, 4.0), ("upper_bound", 3.0, 4.5), ("uninformative", None, 4.0)], "s string, v double, g double")
    assert [r[0] for r in df.select(S.constraint_loss(F.col("s"), F.col("v"), F.col("g"))).collect()] == [0.0, 0.5, 1.0, 1.5, None]


def test_normalise_names_the_first_rule_that_fails(spark):
    good = "ACDEFGHIKLMNPQRSTVWYACDEFGHIK-"
    rows = [(f" {good.lower()} ",), (good[:-1],), (">x",), ("ſ" + good,), ("  ",), ("X" * 30,), ("-" * 30,), (None,)]
    value, error = S.normalise(F.col("x"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "x string").select(value, error).collect()]
    assert got == [(good, None), (None, "length"), (None, "fasta_header"), (None, "non_ascii"), (None, "empty"), (None, "alphabet"), (None, "all_gap"), (None, "not_text")]


def test_spreadsheet_guard(spark):
    df = spark.createDataFrame([("=FORMULA",), ("a\tb",), ("plain",)], "x string")
    assert [r[0] for r in df.select(S.spreadsheet_safe(F.col("x"))).collect()] == ["'=FORMULA", "a\\u0009b", "plain"]


def test_ridge_primal_is_dual():
    rng = np.random.default_rng(0)
    x = ridge.encode(["".join(rng.choice(list("ACDE-"), 30)) for _ in range(40)])
    y = rng.normal(size=(40, 2))
    parts = [ridge.Moments(x[:10], y[:10]), ridge.Moments(x[10:], y[10:])]
    w = np.concatenate([np.full(10, 40 / 2 / 10), np.full(30, 40 / 2 / 30)])
    b, c = ridge.solve(ridge.balanced(parts)[0], 2.0)
    b2, c2 = ridge.fit_rows(x, y, w, 2.0)
    assert np.allclose(b, b2, atol=1e-9) and np.allclose(c, c2, atol=1e-9)
    with pytest.raises(ValueError):
        ridge.encode(["X" * 30])


def test_metrics_of_constants_are_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0)], "k string, actual double, guess double")
    r = metrics.point_metrics(df, ["k"]).first()
    assert r.r2 is None and r.pearson is None and math.isclose(r.mae, 1.5)
    assert metrics.spearman(df, ["k"]).first().spearman is None


def test_contract_violations(spark):
    from strandwise.operators import graph

    a = spark.createDataFrame([("p1", "EC1"), ("p2", "EC1"), ("p3", None)], "id string, g string")
    assert graph.violations(a, a, "id", ["g"]).count() == 0
    b = spark.createDataFrame([("p1", "EC1"), ("p2", "EC2"), ("p4", "EC3")], "id string, g string")
    assert sorted(r.id for r in graph.violations(a, b, "id", ["g"]).collect()) == ["p2", "p3", "p4"]


def test_fold_loads_are_those_of_the_folds(spark):
    rng = np.random.default_rng(5)
    for folds in (2, 3, 5):
        sizes = [int(x) for x in rng.integers(1, 30, 90) ** 2]
        loads = [0] * folds
        for size in sorted(sizes, reverse=True):
            loads[loads.index(min(loads))] += size
        assert graph.fold_loads([(x, sizes.count(x)) for x in set(sizes)], folds) == loads
    assert graph.fold_loads([(4, 1)]) == [4, 0, 0]


def test_components_of_all_thresholds_are_one_run(spark, monkeypatch):
    """An audit whose time grows with the thresholds' rounds, one after the other, did six runs."""
    from strandwise.plans import panel

    runs, own = [], graph.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda edges: runs.append(1) or own(edges))
    assert panel.threshold_audit(spark, "/root/testdata/sf0.001").count() == 6 and len(runs) == 1


def test_components_with_hot_nodes_leave_one_table(spark, monkeypatch):
    """Nodes with many neighbours join by a broadcast, and the files of a round go after the next one."""
    monkeypatch.setattr(graph, "HOT", 5)
    monkeypatch.setattr(graph, "MOST_HOT", 10**9)
    edges = [(1000 + k % 3, k) for k in range(60)] + [(5000, k) for k in range(60, 100)] + [(k, k + 1) for k in range(200, 230)]
    kept = len(graph._kept)
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    true = {k: k % 3 for k in range(60)} | {1000 + k: k for k in range(3)} | {k: 60 for k in [*range(60, 100), 5000]} | {k: 200 for k in range(200, 231)}
    assert got == true and len(graph._kept) == kept + 1
