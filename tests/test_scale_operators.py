"""Seeds, exact quantiles, grouped ranks and resamples against plain versions, with hot keys, ties, nulls and many partitions."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandwise.functions import sequences as S
from strandwise.operators import align, identity, metrics, resample, ridge, seeds, selection


def peptides(rng, n, letters="ACDEFGHIK"):
    """Copies with changes, cut ends and gaps anywhere."""
    base = ["".join(rng.choice(list(letters), 30)) for _ in range(4)]
    out = set()
    while len(out) < n:
        x = list(base[rng.integers(4)])
        for p in rng.integers(0, 30, rng.integers(0, 22)):
            x[p] = rng.choice(list(letters + "-"))
        if rng.random() < 0.3:
            x[rng.integers(3, 30) :] = []
        s = "".join(x).ljust(30, "-")
        if s.strip("-"):
            out.add(s)
    return sorted(out)


def test_packed_shares_are_identities(spark):
    seqs = peptides(np.random.default_rng(1), 40) + ["-" * 30]
    rows = spark.createDataFrame([(s,) for s in seqs], "aligned string").select("aligned", F.struct(*seeds.pack(F.col("aligned"))).alias("x"))
    pairs = rows.crossJoin(rows.select(F.col("aligned").alias("other"), F.col("x").alias("y"))).select("aligned", "other", seeds.share("x", "y").alias("i"), S.identity(F.col("aligned"), F.col("other")).alias("j")).collect()
    assert len(pairs) == 41 * 41 and all(r.i == r.j for r in pairs)


@pytest.mark.parametrize("threshold", [0.2, 0.45, 0.6, 0.7, 0.85, 1.0])
def test_every_pair_at_a_threshold_shares_a_set(threshold):
    """Every plan, whatever its groups, gives rows that meet for every pair that is near enough."""
    rng = np.random.default_rng(2)
    seqs = peptides(rng, 60)
    near = [(a, b) for a, b in itertools.combinations(seqs, 2) if align.identity(a, b) + 1e-12 >= threshold]
    assert near or threshold == 1.0
    for groups in (1, 2, 3, 5, 7, 10, 15, 30):
        plan = seeds.Plan(threshold, groups)
        if plan.all_sets() > 3000:
            continue
        sets = plan.sets()

        def emitted(s):
            residues = [sum(s[i] != "-" for i in g) for g in plan.groups]
            return {(k, tuple(s[i] for i in c)) for k, (g, size, c) in enumerate(sets) if all(s[i] != "-" for i in c) and size >= plan.least(residues[g] or 1)}

        keys = {s: emitted(s) for s in seqs}
        assert all(keys[a] & keys[b] for a, b in near), groups


@pytest.mark.parametrize("cell", [1024, 5])
@pytest.mark.parametrize("threshold", [0.35, 0.7, 0.85])
def test_edges(spark, monkeypatch, threshold, cell):
    monkeypatch.setattr(seeds, "CELL", cell)
    seqs = peptides(np.random.default_rng(3), 90, "ACD")
    df = spark.createDataFrame([(s, f"p{i:03d}", 1) for i, s in enumerate(seqs)], "aligned string, rep string, n long")
    got = identity.edges(df, threshold).collect()
    true = {(f"p{i:03d}", f"p{j:03d}"): v for (i, a), (j, b) in itertools.combinations(enumerate(seqs), 2) if (v := align.identity(a, b)) + 1e-12 >= threshold}
    assert len(got) == len(true) and {(r.a, r.b): r.identity for r in got} == true


def test_cells_hold_each_pair_once(spark):
    """A key of 40 rows in cells of 6: no cell has many rows, each unordered pair (or each of two tables) meets once."""
    one = spark.createDataFrame([(1, f"r{k:02d}") for k in range(40)] + [(2, "a"), (2, "b")], "key long, rep string")
    x, y = seeds.cells(one, cell=6)
    pairs = x.join(y.withColumnRenamed("rep", "other"), ["key", "i", "j"]).filter("i < j or rep < other").collect()
    assert sorted(tuple(sorted((r.rep, r.other))) for r in pairs if r.key == 1) == list(itertools.combinations([f"r{k:02d}" for k in range(40)], 2)) and len(pairs) == 780 + 1
    assert x.groupBy("key", "i", "j").count().agg(F.max("count")).first()[0] <= 15
    two = spark.createDataFrame([(1, f"s{k:02d}") for k in range(9)] + [(3, "z")], "key long, rep string")
    x, y = seeds.cells(one, two, cell=4)
    pairs = x.join(y.withColumnRenamed("rep", "other"), ["key", "i", "j"]).collect()
    assert len(pairs) == len({(r.rep, r.other) for r in pairs}) == 40 * 9


@pytest.mark.parametrize("same_fold", [False, True])
def test_nearest_by_seeds_and_by_products(spark, same_fold):
    rng = np.random.default_rng(4)
    seqs = peptides(rng, 120, "ACDE") + ["W" * 30]
    rows = [(s, None if k % 11 == 0 else int(rng.integers(1, 4)), f"p{k:03d}", int(rng.integers(1, 4)), float(k), 2.0 * k) for k, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "aligned string, fold int, first_id string, n long, s1 double, s2 double").repartition(3)
    ways = [[tuple(r) for r in identity.nearest(df, df, same_fold, **how).select("aligned", "fold", *identity.RESULT).collect()] for how in ({}, {"level_cost": -math.inf}, {"level_cost": -math.inf, "levels": (0.95, 0.3)})]
    plain = []
    for s, f, *_ in rows:
        others = [(align.identity(s, d[0]), d) for d in rows if same_fold or f is None or d[1] is None or d[1] != f]
        best = max(i for i, _ in others)
        tied = [d for i, d in others if i >= best - 1e-12]
        plain.append((s, f, best, sum(d[3] for d in tied), sum(d[4] for d in tied), sum(d[5] for d in tied), min(d[2] for d in tied), sorted(d[2] for d in tied)))
    for got in ways:
        assert sorted(got, key=repr) == sorted(plain, key=repr)


def test_nearest_of_nothing(spark):
    schema = "aligned string, fold int, first_id string, n long, s1 double, s2 double"
    some, none = spark.createDataFrame([("A" * 30, 1, "p", 1, 0.0, 0.0)], schema), spark.createDataFrame([], schema)
    for cost in (identity.LEVEL_COST, -math.inf):
        assert identity.nearest(some, none, level_cost=cost).collect() == identity.nearest(none, some, level_cost=cost).collect() == []


# ------------------------------------------------------------------ quantiles and ranks

ODD = [0.0, -0.0, -1.5, 1e-310, -1e-310, 1e300, -1e300, math.inf, -math.inf, 1.0, 1.0 + 2**-52, 2.0]


def test_bits_order_like_numbers():
    values = np.array(sorted(set(ODD) - {-0.0}))
    words = selection.ordered_bits(values)
    assert (words[1:] > words[:-1]).all() and [selection.from_bits(int(w)) for w in words] == values.tolist()
    assert selection.ordered_bits(np.array([-0.0]))[0] == selection.ordered_bits(np.array([0.0]))[0]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    rows = [(None if k % 50 == 0 else int(g), *(None if rng.random() < 0.1 else float(x) for x in (rng.normal(), rng.integers(0, 3), rng.choice(ODD[:7])))) for k, g in enumerate(rng.choice([1, 1, 1, 1, 2, 3], 3000))]
    rows += [(9, None, 5.0, None)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double").withColumn("n", F.lit(1)).repartition(7)
    qs = [0.0, 0.025, 0.5, 0.975, 1.0]
    for how in ({"by": "g"}, {"by": "g", "complements": True}, {}):
        got = selection.exact_quantiles(df, ["a", "b", "c"], qs, **how)
        names = {None} if not how else {None, "1", "2", "3", "9"}
        assert set(got) == names
        for t, lines in got.items():
            own = [r for r in rows if not how or ((None if r[0] is None else str(r[0])) == t) != how.get("complements", False)]
            for k, line in enumerate(lines, 1):
                x = [r[k] for r in own if r[k] is not None]
                assert line == pytest.approx(np.quantile(x, qs).tolist(), rel=1e-12, abs=1e-300) if x else line == [None] * 5
    assert selection.exact_quantiles(df.limit(0), ["a"], [0.5]) == {}


def test_too_many_groups_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(selection, "MOST_GROUPS", 5)
    with pytest.raises(ValueError, match="groups"):
        selection.exact_quantiles(spark.range(9), ["id"], [0.5], by="id")


@pytest.mark.parametrize("tasks", [1, 4, 30])
def test_average_ranks_over_tasks(spark, tasks):
    rng = np.random.default_rng(6)
    rows = [(rng.choice(["x", "x", "x", "y"]), int(rng.integers(0, 2)), float(rng.integers(0, 60)), float(rng.integers(0, 9))) for _ in range(2000)] + [("z", 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "m string, e int, a double, g double")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = metrics.average_ranks(df, ["m", "e"], "a", "rank").toPandas()
        rho = {(r.m, r.e): r.spearman for r in metrics.spearman(df, ["m", "e"], "a", "g").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(rows) and np.allclose(got["rank"], got.groupby(["m", "e"])["a"].rank(method="average"))
    plain = pd.DataFrame(rows, columns=["m", "e", "a", "g"])
    for key, own in plain.groupby(["m", "e"]):
        true = own["a"].rank().corr(own["g"].rank())
        assert rho[key] is None if np.isnan(true) else rho[key] == pytest.approx(true, abs=1e-12)


# ------------------------------------------------------------------ resamples


def test_shares_of_blocks_are_whole_resamples():
    sizes = np.array([5, 0, 100, 1, 17, 40, 3])
    draws = np.stack([resample.share(sizes, b, 4000, 7, "s") for b in range(len(sizes))])
    assert (draws.sum(0) == sizes.sum()).all() and (draws[1] == 0).all()
    n, p = sizes.sum(), sizes / sizes.sum()
    assert np.allclose(draws.mean(1), n * p, atol=4 * np.sqrt(n * p * (1 - p) / 4000).max())
    assert np.allclose(np.cov(draws)[2, 5], -n * p[2] * p[5], atol=1.5)  # as of a multinomial


def test_resamples_have_exact_sizes_and_the_right_spread(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_UNITS", 50)
    rng = np.random.default_rng(8)
    rows = [(e, s, k, float(rng.normal(loc=len(s)))) for e in ("a", "b") for s, n in (("one", 300), ("three", 40), ("x", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "e string, s string, id long, v double").withColumn("n", F.lit(1.0))
    draw = lambda parts: {(r.e, r.s, r.resample): (r.v, r.n) for r in resample.resampled(df.repartition(parts), ["e", "s"], "id", ["v", "n"], 2000, seed=3).collect()}
    got = draw(2)
    assert len(got) == 2 * 3 * 2000 and all(n == {"one": 300, "three": 40, "x": 1}[s] for (_, s, _), (_, n) in got.items())
    again = draw(9)
    assert all(again[k][0] == pytest.approx(v, abs=1e-9) for k, (v, _) in got.items())
    for e in ("a", "b"):
        means = np.array([sum(got[e, s, r][0] for s in ("one", "three", "x")) / 341 for r in range(2000)])
        strata = [np.array([x[3] for x in rows if x[:2] == (e, s)]) for s in ("one", "three", "x")]
        plain = metrics.drawn_strata(strata, 2000, seed=1)
        spread = plain.std()
        assert abs(means.mean() - plain.mean()) < 4 * spread / np.sqrt(1000) and abs(means.std() / spread - 1) < 0.07
        assert np.allclose(np.quantile(means, [0.025, 0.975]), np.quantile(plain, [0.025, 0.975]), atol=0.25 * spread)
    assert resample.resampled(df.limit(0), ["e", "s"], "id", ["v", "n"], 10).collect() == []


def test_resampled_groups_against_numpy(spark):
    """Whole groups with unequal sizes: the ratio of sums, as in the bootstrap of components."""
    rng = np.random.default_rng(9)
    sums, sizes = rng.normal(size=17) * 5, rng.integers(1, 30, 17).astype(float)
    df = spark.createDataFrame([("g", k, float(s), float(n)) for k, (s, n) in enumerate(zip(sums, sizes))], "e string, c long, s double, n double")
    got = resample.resampled(df, ["e"], "c", ["s", "n"], 10_000).withColumn("d", F.col("s") / F.col("n"))
    low, high = (resample.intervals(got, ["e"], "d").first()[c] for c in ("low", "high"))
    plain = metrics.drawn_means(sums, sizes, 10_000, 5)
    assert np.allclose([low, high], np.quantile(plain, [0.025, 0.975]), atol=0.06 * plain.std())


# ------------------------------------------------------------------ ridge without a component


def components_of(rng, sizes):
    base = ["".join(rng.choice(list("ACDEFGHIK"), 30)) for _ in range(3)]
    rows = []
    for c, n in enumerate(sizes):
        for _ in range(n):
            x = list(base[c % 3])
            for p in rng.integers(0, 30, 8):
                x[p] = rng.choice(list("ACDEFGHIK-"))
            rows.append((f"c{c}", int(rng.integers(1, 4)), "".join(x), float(rng.normal(c % 3)), float(rng.normal())))
    return rows


def left_out(rows, component, held, alpha):
    """The error sum of a component's rows by a fit of all other rows, every component with the same weight."""
    there = [r for r in rows if r[1] != held]
    own, rest = [r for r in there if r[0] == component], [r for r in there if r[0] != component]
    size = {c: sum(r[0] == c for r in rest) for c, *_ in rest}
    w = np.array([len(rest) / len(size) / size[r[0]] for r in rest])
    y = lambda z: np.array([r[3:] for r in z])
    b, c = ridge.fit_rows(ridge.encode([r[2] for r in rest]), y(rest), w, alpha)
    return float(np.abs(ridge.encode([r[2] for r in own]) @ b + c - y(own)).sum())


@pytest.mark.parametrize("sizes", [[5, 1, 40, 3, 12], [700, 2], [30, 30, 30, 1]])
def test_downdated_fits_are_fits_of_the_other_rows(sizes):
    rows = components_of(np.random.default_rng(sum(sizes)), sizes)
    for held in (0, 2):
        there = [r for r in rows if r[1] != held]
        names = sorted({r[0] for r in there})
        parts = {c: [r for r in there if r[0] == c] for c in names}
        arrays = {c: (ridge.encode([r[2] for r in own]), np.array([r[3:] for r in own])) for c, own in parts.items()}
        total = None
        for x, y in arrays.values():
            m = ridge.Moments.of([p / len(x) for p in ridge.Moments(x, y).parts])
            total = m if total is None else total + m
        whole = ridge.Whole(total, float(len(there)), len(names))
        for c in names:
            alphas = [1e-4, 0.1, 1.0, 1000.0]
            assert whole.without(*arrays[c], alphas) == pytest.approx([left_out(rows, c, held, a) for a in alphas], rel=1e-8)
    assert ridge.Whole(total, 1.0, 1).without(*arrays[names[0]], [1.0]) == []


def test_scores_of_small_and_of_large_components(spark, monkeypatch):
    rows = components_of(np.random.default_rng(11), [6, 1, 25, 9])
    df = spark.createDataFrame(rows, "c string, fold int, aligned string, y1 double, y2 double").repartition(3)
    alphas, found = [0.1, 10.0], []
    for small in (512, 8, 0):
        monkeypatch.setattr(ridge, "SMALL", small)
        fits = ridge.Fits(df, "c", alphas)
        assert fits.has_large == (small < 25)
        found.append({(r.held, r.alpha): (r.components, r.score) for r in fits.scores().collect()})
    for held in range(4):
        for a in alphas:
            there = sorted({r[0] for r in rows if r[1] != held})
            errors = [left_out(rows, c, held, a) / (2 * sum(r[0] == c and r[1] != held for r in rows)) for c in there]
            for got in found:
                assert got[held, a] == (len(there), pytest.approx(np.mean(errors), rel=1e-7))


def test_draws_of_a_block_share_rows_between_columns():
    """Columns of a row are drawn together, a constant one without being looked up; a block's sums are those of its draws."""
    values = np.stack([np.arange(50.0), 3 * np.arange(50.0), np.full(50, 2.0)], 1)
    draws = np.array([0, 7, 100_000, 1, 0, 300_000, 5])
    sums = resample.drawn_sums(values, draws, resample.generator(1, "x"))
    assert np.array_equal(sums[:, 2], 2.0 * draws) and np.array_equal(sums[:, 1], 3 * sums[:, 0])
    big = draws > 1000
    assert np.allclose(sums[big, 0] / draws[big], 24.5, atol=0.3) and not sums[draws == 0].any() and 0 <= sums[3, 0] <= 49
    assert np.array_equal(sums, resample.drawn_sums(values, draws, resample.generator(1, "x")))
