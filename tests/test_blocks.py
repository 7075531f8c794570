"""Tables that meet in blocks against plain versions, over several blocks, gaps anywhere and folds with nulls."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandwise.functions import sequences as S
from strandwise.operators import align, blocks, identity
from tests.test_scale_operators import peptides


@pytest.mark.parametrize("threshold", [0.35, 0.85])
def test_edges_by_blocks_and_by_seeds(spark, monkeypatch, threshold):
    monkeypatch.setattr(blocks, "LEAST", 7)
    monkeypatch.setattr(blocks, "BLOCKS", 5)
    seqs = peptides(np.random.default_rng(6), 60, "ACD")
    df = spark.createDataFrame([(s, f"p{i:03d}", 1) for i, s in enumerate(seqs)], "aligned string, rep string, n long")
    true = sorted((f"p{i:03d}", f"p{j:03d}", v) for (i, a), (j, b) in itertools.combinations(enumerate(seqs), 2) if (v := align.identity(a, b)) + 1e-12 >= threshold)
    for cost in (identity.LEVEL_COST, -math.inf):
        assert sorted(tuple(r) for r in identity.edges(df, threshold, level_cost=cost).collect()) == true


def test_nearest_by_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 9)
    monkeypatch.setattr(blocks, "BLOCKS", 4)
    rng = np.random.default_rng(7)
    seqs = peptides(rng, 50, "ACDE")
    rows = [(s, None if k % 11 == 0 else int(rng.integers(1, 4)), f"p{k:03d}", 2, float(k), 2.0 * k) for k, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "aligned string, fold int, first_id string, n long, s1 double, s2 double")
    plain = []
    for s, f, *_ in rows:
        others = [(align.identity(s, d[0]), d) for d in rows if f is None or d[1] is None or d[1] != f]
        tied = [d for i, d in others if i >= max(i for i, _ in others) - 1e-12]
        plain.append((s, f, max(i for i, _ in others), 2 * len(tied), sum(d[4] for d in tied), sum(d[5] for d in tied), min(d[2] for d in tied), sorted(d[2] for d in tied)))
    got = identity.nearest(df, df).select("aligned", "fold", *identity.RESULT).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(plain, key=repr)
    found = identity.hamming_nearest(df.select("aligned"), df.filter("s1 % 3 = 0").select("aligned", "first_id")).collect()
    far = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    assert sorted(tuple(r) for r in found) == sorted((s, *min((far(s, d[0]), d[2]) for d in rows[::3])) for s in seqs)


def test_what_is_best_leaves_a_slab_once(spark, monkeypatch):
    """A query has a row for each slab of donors at most, not one with ties for each block; with copies of all donors held in between, and without."""
    monkeypatch.setattr(blocks, "LEAST", 6)
    monkeypatch.setattr(blocks, "BLOCKS", 12)
    monkeypatch.setattr(blocks, "SLABS", 2)
    seqs = peptides(np.random.default_rng(9), 72, "AC")
    rows = [(k, s, k % 3) for k, s in enumerate(seqs)]
    queries, donors = (spark.createDataFrame(rows, f"{name} long, aligned string, fold int") for name in ("qid", "did"))
    got = blocks.best(queries, donors, False).collect()
    assert len(got) <= 2 * len(rows) and {r.qid for r in got} == set(range(len(rows)))
    plain = {k: max((align.identity(s, t), []) for _, t, g in rows if g != f)[0] for k, s, f in rows}
    for k, s, f in rows:
        best = {d for r in got if r.qid == k and r.identity >= plain[k] - 1e-12 for d in r.dids}
        assert best == {j for j, t, g in rows if g != f and align.identity(s, t) >= plain[k] - 1e-12}


def test_most_equal_rows_of_a_block():
    """Counts by full adders against plain ones: ties and copies, gaps in the block's rows, folds at words of their own, one that no other has."""
    rng = np.random.default_rng(11)
    seqs = peptides(rng, 150, "ACDE")
    own = [s.replace(S.GAP, "W") for s in seqs[:20]] + seqs[-1:] * (S.GAP not in seqs[-1])
    seqs += own[:5] * 20
    folds = rng.integers(1, 4, len(seqs))
    equal = blocks.Equal(blocks.planes(pa.array(seqs)), folds)
    x = blocks.letters(blocks.planes(pa.array(own)))
    for fold in (None, 1, 2, 3, 9):
        seen = []
        for rows, most, reach in equal.most(x, np.arange(len(own)), fold):
            i, at = reach(np.arange(len(rows)))
            for k, row in enumerate(rows):
                same = [sum(a == b for a, b in zip(own[row], t, strict=True)) if g != fold else -1 for t, g in zip(seqs, folds, strict=True)]
                assert most[k] == max(same) and sorted(at[i == k]) == [j for j, v in enumerate(same) if v == max(same)]
                seen.append(row)
        assert seen == list(range(len(own)))


def test_blocks_are_packed_once_and_never_broadcast(spark):
    """Copies of a block that go to other blocks are dealt by number: a broadcast would hold them all on the driver."""
    df = spark.createDataFrame([(s, f"p{k}") for k, s in enumerate(peptides(np.random.default_rng(8), 20))], "aligned string, first_id string")
    plan = identity.hamming_nearest(df.select("aligned"), df)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=shuffle_hash" in plan


def test_starts_of_texts_give_the_same_sequences(spark):
    """Texts whose first residues come late, at the start's border or never, against the rule over whole texts."""
    texts = [None, "", "bjo" * 200 + "acd" * 20, "1" * 119 + "a" * 40, "x" * 91 + "c" * 29 + "dé" * 3, "c" * 29 + "é" * 400 + "ef", "ß" * 500, "aB-c" * 30]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(S.aligned_from_text(F.col("t"))).collect()]
    plain = ["".join(c for c in (t or "") if c.isascii() and c.isalpha()).upper() for t in texts]
    assert got == ["".join(c for c in p if c not in "BJOUXZ")[:30].ljust(30, "-") for p in plain]
