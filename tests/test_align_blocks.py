"""Raw sequences past blocks of references against the plain rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.functions import sequences as S
from strandwise.operators import align, blocks
from tests.test_scale_operators import peptides


def numbers(sequences):
    return np.array([[S.ALPHABET.index(c) for c in s] for s in sequences], np.uint8).T


@pytest.mark.parametrize("letters", ["AC", "ACDEFGHIKLMNPQRSTVWY"])
def test_placements_of_pairs(letters):
    rng = np.random.default_rng(4)
    references = ["".join(rng.choice(list(letters + "-"), S.LENGTH)) for _ in range(200)]
    for n in range(align.LEAST, S.LENGTH + 1):
        raws = [r.replace("-", "")[:n].ljust(n, letters[0]) for r in references[1:] + references[:1]]
        plain = [align.project(*pair) for pair in zip(raws, references)]
        many, at = align.places(numbers(raws), numbers(references))
        assert align.costs(numbers(raws), numbers(references)).tolist() == [cost for cost, _ in plain]
        assert many.tolist() == [len(found) > 1 for _, found in plain]
        strings = [_string(raw, a) for raw, a in zip(raws, at.tolist())]
        assert all(s in found for s, (_, found), m in zip(strings, plain, many) if not m)


def _string(raw, at):
    left = iter(raw)
    return "".join("-" if at >> j & 1 else next(left) for j in range(S.LENGTH))


@pytest.mark.parametrize("letters", ["AC", "ACDEFGHIKLMNPQRSTVWY"])
def test_statuses_over_several_blocks(spark, monkeypatch, letters):
    """Many equally good references and strings, with gaps anywhere; references come in several blocks and slabs."""
    monkeypatch.setattr(blocks, "LEAST", 12)
    monkeypatch.setattr(blocks, "BLOCKS", 4)
    monkeypatch.setattr(align.Placed, "CELLS", 40)
    monkeypatch.setattr(align.Placed, "PAIRS", 17)
    rng = np.random.default_rng(5)
    references = sorted({*peptides(rng, 50, letters), *("".join(rng.choice(list(letters), 30)) for _ in range(20))})
    raws = {"", "A", "X" * 28}
    for k in range(90):
        raw = list(references[k % len(references)].replace("-", ""))
        for _ in range(k % 5):
            raw[rng.integers(len(raw))] = rng.choice(list(letters))
        for _ in range(k % 4):
            del raw[rng.integers(len(raw))]
        raws.add("".join(raw))
    df = spark.createDataFrame([(r,) for r in sorted(raws)], "raw string").repartition(3)
    got = {r.raw: (r.aligned, r.status) for r in align.prepared(df, spark.createDataFrame([(r,) for r in references + references[:9]], "aligned string")).collect()}
    assert got == {r: align.prepare(r, references) for r in raws}
    assert len({status for _, status in got.values()}) >= 3


@pytest.mark.parametrize("level_cost", [0.0, 1e9])
@pytest.mark.parametrize("letters", ["AC", "ACDEFGHIKLMNPQRSTVWY"])
def test_near_placements_meet_by_seeds(spark, monkeypatch, letters, level_cost):
    """By seeds (keys in cells) or by blocks: the plain rule's strings, and too_far for all that no reference comes near to."""
    monkeypatch.setattr(align, "PRODUCT_COST", 1e6 if level_cost == 0.0 else 0.0)
    monkeypatch.setattr(align.P, "CELL", 3)
    rng = np.random.default_rng(6)
    references = sorted({*peptides(rng, 50, letters), *("".join(rng.choice(list(letters + "-"), 30)) for _ in range(10)), *("".join(rng.choice(list(letters), 30)) for _ in range(40))})
    raws = {"", "A", "X" * 28}
    for k in range(300):
        raw = list(references[k % len(references)].replace("-", ""))
        for _ in range(k % 6 if raw else 0):
            raw[rng.integers(len(raw))] = rng.choice(list(letters))
        for _ in range(min(k % 5, len(raw))):
            del raw[rng.integers(len(raw))]
        raws.add("".join(raw))
    frame = lambda rows, name: spark.createDataFrame([(r,) for r in rows], f"{name} string").repartition(3)
    df = frame(sorted(raws), "raw")
    if level_cost == 0.0:
        assert align._by_seeds(df.select(F.rpad("raw", 30, "-").alias("aligned"), F.lit(1).cast("long").alias("rid")), frame(references, "aligned").withColumn("did", F.lit(1).cast("long")), level_cost) is not None
    got = {r.raw: (r.aligned, r.status) for r in align.prepared(df, frame(references + references[:9], "aligned"), near=True, level_cost=level_cost).collect()}
    want = {}
    for r in raws:
        aligned, status = align.prepare(r, references)
        far = status == "ambiguous" and min(align.project(r, x)[0] for x in references) > align.MOST
        want[r] = (aligned, "too_far" if far else status)
    assert got == want
    assert len({status for _, status in got.values()}) >= 4
