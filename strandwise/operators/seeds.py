"""Lossless seeds for share-of-equal-columns joins: which columns two sequences must agree in, and how rows meet on them.

Columns are dealt into groups. If at least a share t of the columns that aren't gaps in both are equal, then
so it is in some group: of its u such columns at least ceil(t * u) are equal. So both sequences hold
the same letters at some set of ceil(t * u) columns of that group, and rows that meet on (set, letters)
are all that need to be looked at. A sequence with r residues in a group emits the sets of every size
that a partner with more residues there may ask for. More columns in a group make sets that fewer
pairs share and more of them; the number of groups is chosen by the letters' frequencies and the rows.

Sequences are packed, five bits a column, into three longs, so that keys and verification are a few
bit operations in generated code.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions import sequences as S
from strandwise.operators.graph import cut

LANES, BITS = 12, 5
WORDS = -(-S.LENGTH // LANES)
ONES = sum(1 << BITS * i for i in range(LANES))
PACKED = [f"p{w}" for w in range(WORDS)]
#: Keys that a sequence emits at most (twice as many sets are held against it), and what one costs beside a pair that is looked at.
MOST_KEYS, KEY_COST = 700, 40.0
#: Rows of a key that meet in one cell.
CELL = 1024


def pack(aligned: Column) -> list[Column]:
    """The packed words of a sequence; a gap is 0."""
    code = lambda i: F.position(F.substring(aligned, i + 1, 1), F.lit(S.ALPHABET)).cast("long") - 1
    words = []
    for w in range(WORDS):
        at = range(w * LANES, min((w + 1) * LANES, S.LENGTH))
        words.append(sum((F.shiftleft(code(i), BITS * (i - w * LANES)) for i in at), F.lit(0).cast("long")).alias(PACKED[w]))
    return words


def _held(word: Column) -> Column:
    """A one for each lane that isn't zero."""
    x = word
    for k in range(1, BITS):
        x = x.bitwiseOR(F.shiftright(word, k))
    return x.bitwiseAND(F.lit(ONES))


def share(a: str, b: str) -> Column:
    """Equal residues over the columns that aren't gaps in both, of packed rows named a and b with a dot; null if all are gaps."""
    differ = used = F.lit(0)
    for p in PACKED:
        x, y = F.col(f"{a}.{p}"), F.col(f"{b}.{p}")
        differ = differ + F.bit_count(_held(x.bitwiseXOR(y)))
        used = used + F.bit_count(_held(x.bitwiseOR(y)))
    return F.when(used > 0, (used - differ) / used)


class Plan:
    """Groups of columns and the sets of columns that rows emit for a threshold."""

    def __init__(self, threshold: float, groups: int):
        self.threshold = threshold
        ends = [S.LENGTH * k // groups for k in range(groups + 1)]
        self.groups = [range(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def least(self, used: int) -> int:
        """Equal columns that `used` ones must have."""
        return max(1, math.ceil(self.threshold * used - 1e-9))

    def keys(self) -> int:
        """Sets of a sequence without gaps."""
        return sum(math.comb(len(g), self.least(len(g))) for g in self.groups)

    def sizes(self, group: range) -> list[int]:
        """Sizes of the sets that rows emit for a group, by how many residues they and their partners have there."""
        return [size for size in range(1, self.least(len(group)) + 1) if any(self.least(r) <= size <= r for r in range(1, len(group) + 1))]

    def all_sets(self) -> int:
        return sum(math.comb(len(g), size) for g in self.groups for size in self.sizes(g))

    def rate(self, agree: list[float]) -> float:
        """Expected sets that two unrelated sequences share, from each column's chance that two agree."""
        total = 0.0
        for g in self.groups:
            ways = [1.0]  # elementary symmetric sums
            for i in g:
                ways = [x + (ways[k - 1] * agree[i] if k else 0) for k, x in enumerate([*ways, 0.0])]
            total += ways[self.least(len(g))]
        return total

    def cost(self, rows: int, pairs: float, agree: list[float]) -> float:
        """In pairs that are looked at."""
        return KEY_COST * rows * self.keys() + pairs * self.rate(agree)

    @classmethod
    def best(cls, threshold: float, rows: int, pairs: float, agree: list[float]) -> Plan:
        """The cheapest for so many rows of keys and so many possible pairs."""
        found = [p for n in range(1, S.LENGTH + 1) if (p := cls(threshold, n)).all_sets() <= 2 * MOST_KEYS]
        return min(found, key=lambda p: p.cost(rows, pairs, agree))

    def sets(self) -> list[tuple[int, int, tuple[int, ...]]]:
        """Group, size and columns of every set that some row may emit."""
        return [(number, size, c) for number, g in enumerate(self.groups) for size in self.sizes(g) for c in combinations(g, size)]

    def keyed(self, rows: DataFrame) -> DataFrame:
        """rows (packed) once for each of their keys, hashes of a set and the letters there (a collision adds a pair to look at)."""
        plan, names = self, rows.columns

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sets = plan.sets()
            letters, lanes = _masks([c for *_, c in sets], 31), _masks([c for *_, c in sets], 1)
            groups = _masks(plan.groups, 1)
            group, size = np.array([x[0] for x in sets]), np.array([x[1] for x in sets])
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    p = np.stack([part.column(names.index(w)).to_numpy().astype(np.uint64) for w in PACKED], 1)
                    held = p.copy()
                    for k in range(1, BITS):
                        held |= p >> np.uint64(k)
                    held &= np.uint64(ONES)
                    residues = np.bitwise_count(held[:, None, :] & groups[None]).sum(2)
                    least = np.array([[plan.least(r) if r else 1 for r in range(S.LENGTH + 1)]])[0][residues]
                    use = ((held[:, None, :] & lanes[None]) == lanes[None]).all(2) & (size[None, :] >= least[:, group])
                    row, which = np.nonzero(use)
                    here = p[row] & letters[which]
                    key = which.astype(np.uint64)
                    for w in range(WORDS):
                        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) ^ here[:, w])
                    offsets = np.concatenate(([0], np.cumsum(use.sum(1)))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.view(np.int64)))], [*names, "keys"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(emit, f"{schema}, keys array<long>").withColumn("key", F.explode("keys")).drop("keys")


def _masks(columns: list, fill: int) -> np.ndarray:
    """Words in which the lanes of some columns are filled; a row for each."""
    return np.array([[sum(fill << BITS * (i % LANES) for i in c if i // LANES == w) for w in range(WORDS)] for c in columns], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def agreement(rows: DataFrame) -> list[float]:
    """For each column the chance that two of the sequences have the same residue there."""
    letters = rows.select(F.posexplode(F.split("aligned", "")).alias("i", "x")).filter((F.col("x") != "") & (F.col("i") < S.LENGTH)).groupBy("i", "x").count().collect()  # at most 30 * 21 rows
    total = max(sum(r["count"] for r in letters if r.i == 0), 1)
    return [sum((r["count"] / total) ** 2 for r in letters if r.i == i and r.x != S.GAP) for i in range(S.LENGTH)]


def meetings(keyed: DataFrame, other: DataFrame | None = None) -> float:
    """How many pairs of rows have a key in common: ordered ones of one table."""
    counts = keyed.groupBy("key").agg(F.count("*").cast("double").alias("n"))
    if other is None:
        return counts.filter("n > 1").agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0))).first()[0]
    more = other.groupBy("key").agg(F.count("*").cast("double").alias("m"))
    return counts.join(more, "key").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0.0))).first()[0]


def cells(keyed: DataFrame, other: DataFrame | None = None, by: str = "rep", cell: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on (key, i, j) in which no cell has many rows of a key, however common it is.

    A key with more rows than `cell` on a side has its rows dealt by a hash into so many lines (or columns) of a grid; each row goes
    to all cells of its line, so every pair meets in exactly one. With one table (other None) only cells with i <= j
    are used: rows are the first of a pair in line i and the second in column i. Tables are read several times, so they should be checkpointed.
    """
    cell = cell or CELL
    sides = [keyed, keyed if other is None else other]
    counts = None
    for k, side in enumerate(sides[: 1 if other is None else 2]):
        own = side.groupBy("key").agg(F.count("*").alias(f"n{k}"))
        counts = own if counts is None else counts.join(own, "key")
    if other is None:
        counts = counts.withColumn("n1", F.col("n0"))
    hot = counts.filter(F.greatest("n0", "n1") > cell).select(F.col("key").alias("hot"), *(F.ceil(F.col(f"n{k}") / cell).cast("int").alias(f"g{k}") for k in (0, 1)))
    hot = cut(hot)
    if not hot.limit(1).count():
        return tuple(s.withColumns({"i": F.lit(0), "j": F.lit(0)}) for s in sides)
    out = []
    for k, side in enumerate(sides):
        dealt = side.join(hot, side["key"] == hot["hot"], "left").withColumn("own", F.pmod(F.xxhash64(by), F.coalesce(f"g{k}", F.lit(1))).cast("int"))
        across = F.coalesce(f"g{1 - k}", F.lit(1)) - 1
        if other is not None:
            span = F.sequence(F.lit(0), across)
        else:
            span = F.sequence(F.col("own"), across) if k == 0 else F.sequence(F.lit(0), F.col("own"))
        names = ("own", "to") if k == 0 else ("to", "own")
        out.append(dealt.withColumn("to", F.explode(span)).withColumns({"i": F.col(names[0]), "j": F.col(names[1])}).drop("hot", "g0", "g1", "own", "to"))
    return tuple(out)
