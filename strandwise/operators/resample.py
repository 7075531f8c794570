"""Bootstraps with exact sizes: how often each part of a stratum is drawn comes from a tree of conditional binomials.

A resample of a stratum draws as many units as it has, with replacement. The units are dealt into
blocks by a hash of their ids. The draws of a resample are split between the halves of the blocks by a
binomial, and so on down to a block, which then draws its own share uniformly. All numbers come from
counter-based generators (Philox) keyed by the seed, the stratum and the tree's node or the block, so every
task finds the same splits without hearing of the others, and a task that runs again draws the same.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.operators.graph import cut

#: Units of a block, and the most blocks of all strata together (their sizes go to every task).
BLOCK_UNITS, MOST_BLOCKS = 1 << 14, 1 << 18
#: Draws at once, few enough for a core's cache.
_AT_ONCE = 1 << 18


def generator(seed: int, *at: object) -> np.random.Generator:
    """A stream of its own for each place."""
    key = np.frombuffer(sha256(repr((seed, *at)).encode()).digest()[:16], np.uint64)
    return np.random.Generator(np.random.Philox(key=key))


def share(sizes: np.ndarray, block: int, resamples: int, seed: int, *stratum: object) -> np.ndarray:
    """How many of the draws of each resample fall into a block; over all blocks they sum to the stratum's units."""
    upto = np.concatenate(([0], np.cumsum(sizes)))
    low, high = 0, len(sizes)
    left = np.full(resamples, upto[-1], np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        whole, first = upto[high] - upto[low], upto[middle] - upto[low]
        part = generator(seed, *stratum, "node", low, high).binomial(left, first / whole) if whole else np.zeros(resamples, np.int64)
        low, high, left = (low, middle, part) if block < middle else (middle, high, left - part)
    return left


def drawn_sums(values: np.ndarray, draws: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each resample the sums of so many units (rows of values) drawn uniformly; a column for each of values."""
    out, k, upto = np.zeros((len(draws), values.shape[1])), 0, np.cumsum(draws)
    kind = np.uint16 if len(values) <= 1 << 16 else np.int64
    varies = [c for c in range(values.shape[1]) if values[:, c].min() != values[:, c].max()]
    for c in set(range(values.shape[1])) - set(varies):
        out[:, c] = draws * values[0, c]
    columns = [np.ascontiguousarray(values[:, c]) for c in varies]
    while k < len(draws) and varies:
        end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + _AT_ONCE, "right")))
        own = draws[k:end]
        picked = rng.integers(0, len(values), int(own.sum()), dtype=kind).astype(np.intp)
        some = np.flatnonzero(own)
        if len(some):
            first = (np.cumsum(own) - own)[some]
            for c, column in zip(varies, columns, strict=True):
                out[k + some, c] = np.add.reduceat(column.take(picked), first)
        k = end
    return out


def resampled(units: DataFrame, strata: list[str], unit: str, values: list[str], resamples: int = 10_000, seed: int = 20260820) -> DataFrame:
    """strata, resample and the sums of values over as many draws of units as the stratum has.

    A unit is a row; rows of a stratum are told apart by `unit`, and rows equal in all are units of their own. Null values count as 0.
    """
    named = units.select(*strata, F.col(unit).cast("string").alias("__u"), *(F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values))
    rows = cut(named)
    counts = rows.groupBy(*strata).agg(F.count("*").alias("n")).collect()  # a row for each stratum
    blocks = {tuple(r[s] for s in strata): max(1, -(-r.n // BLOCK_UNITS)) for r in counts}
    scale = max(1.0, sum(blocks.values()) / MOST_BLOCKS)
    table = [(*k, max(1, int(n / scale))) for k, n in blocks.items()]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*strata).schema.fields)
    if not table:
        return units.sparkSession.createDataFrame([], f"{kind}, resample int, " + ", ".join(f"{v} double" for v in values))
    number = units.sparkSession.createDataFrame([(*k[:-1], k[-1]) for k in table], ", ".join(f"__{c}" for c in kind.split(", ")) + ", __blocks int")
    same = [F.col(s).eqNullSafe(F.col(f"__{s}")) for s in strata]
    dealt = cut(rows.join(F.broadcast(number), same).withColumn("__block", F.pmod(F.xxhash64("__u", *values), F.col("__blocks")).cast("int")).select(*strata, "__block", "__u", *values))
    sizes: dict[tuple, np.ndarray] = {k[:-1]: np.zeros(k[-1], np.int64) for k in table}
    for r in dealt.groupBy(*strata, "__block").agg(F.count("*").alias("n")).collect():  # at most MOST_BLOCKS and a row for each stratum
        sizes[tuple(r[s] for s in strata)][r["__block"]] = r.n

    def draw(part: pa.Table) -> pa.Table:
        at, block = tuple(part[s][0].as_py() for s in strata), part["__block"][0].as_py()
        part = part.sort_by([("__u", "ascending"), *((v, "ascending") for v in values)])
        x = np.stack([part[v].to_numpy() for v in values], 1)
        draws = share(sizes[at], block, resamples, seed, *at)
        sums = drawn_sums(x, draws, generator(seed, *at, "block", block))
        lists = [pa.ListArray.from_arrays(pa.array([0, resamples], pa.int32()), pa.array(np.ascontiguousarray(c))) for c in sums.T]
        return pa.Table.from_arrays([*(part[s].combine_chunks()[:1] for s in strata), *lists], [*strata, *values])

    lists = dealt.groupBy(*strata, "__block").applyInArrow(draw, f"{kind}, " + ", ".join(f"{v} array<double>" for v in values))
    each = lists.select(*strata, F.posexplode(F.arrays_zip(*values)).alias("resample", "__x"))
    return each.groupBy(*strata, "resample").agg(*(F.sum(F.col(f"__x.{v}")).alias(v) for v in values))


def intervals(means: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """by, mean, low and high of the resamples' values; there are as many rows of a group as resamples."""
    low, high = (1 - level) / 2, (1 + level) / 2
    return means.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(low)).alias("low"), F.percentile(value, F.lit(high)).alias("high"))
