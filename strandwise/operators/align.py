"""Projection of raw sequences onto the 30 reference columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions import sequences as S
from strandwise.operators import blocks as B
from strandwise.operators import seeds as P
from strandwise.operators.graph import cut

LEAST = 26  # residues that can be aligned


def project(raw: str, reference: str, keep: int = 2) -> tuple[int, list[str]]:
    """(mismatches, up to `keep` smallest strings): raw with gaps inserted so that it differs least from the reference.

    A column costs 1 unless raw's symbol, or the gap, equals the reference's. Prefixes of raw against
    prefixes of the reference keep their least cost and the smallest strings that reach it.
    """
    n, m = len(raw), len(reference)
    gaps = m - n
    if gaps < 0:
        raise ValueError("longer than the reference")
    row: dict[int, tuple[int, list[str]]] = {0: (0, [""])}
    for j in range(m):
        now: dict[int, tuple[int, list[str]]] = {}
        for i in range(max(0, j + 1 - gaps), min(n, j + 1) + 1):
            options = []
            if i in row:
                cost, strings = row[i]
                options.append((cost + (reference[j] != S.GAP), [s + S.GAP for s in strings]))
            if i and i - 1 in row:
                cost, strings = row[i - 1]
                options.append((cost + (reference[j] != raw[i - 1]), [s + raw[i - 1] for s in strings]))
            least = min(c for c, _ in options)
            now[i] = least, sorted({s for c, x in options if c == least for s in x})[:keep]
        row = now
    return row[n]


def prepare(raw: str, references: list[str]) -> tuple[str | None, str]:
    """(aligned, status) of a raw sequence of 26 to 30 residues: unmapped if two strings are equally good or none comes near."""
    if S.GAP in raw or not 26 <= len(raw) <= S.LENGTH or any(c not in S.ALPHABET for c in raw):
        return None, "invalid"
    best, strings = S.LENGTH + 1, set()
    for reference in references:
        cost, found = project(raw, reference)
        if cost < best:
            best, strings = cost, set(found)
        elif cost == best:
            strings |= set(found)
    if len(strings) > 1:
        return None, "ambiguous"
    aligned = next(iter(strings), None)
    if aligned is None or max(identity(aligned, r) for r in references) < 0.85:
        return None, "too_far"
    return aligned, "direct" if len(raw) == S.LENGTH else "mapped_unambiguously"


def identity(a: str, b: str) -> float:
    """Equal residues over columns that aren't gaps in both; an error if lengths differ or nothing is comparable."""
    used = [(x, y) for x, y in zip(a, b, strict=True) if (x, y) != (S.GAP, S.GAP)]
    if not used:
        raise ValueError("no comparable column")
    return sum(x == y for x, y in used) / len(used)


def costs(x: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The least mismatches of pairs over all placements of gaps: residues (columns, pairs) of one length and references, by letters' numbers."""
    n, far = len(x), np.int8(S.LENGTH + 1)
    gaps = S.LENGTH - n
    now = np.full((gaps + 1, x.shape[1]), far, np.int8)  # by gaps placed so far
    now[0] = 0
    for j in range(S.LENGTH):
        filled = (references[j] != 0).view(np.int8)
        for g in range(min(gaps, j + 1), max(0, j + 1 - n) - 1, -1):  # falling, as a state needs that of the column before
            here = now[g] + (x[j - g] != references[j]) if j >= g else None
            if g:
                there = now[g - 1] + filled
                here = there if here is None else np.minimum(here, there)
            now[g] = here
        now[: max(0, j + 1 - n)] = far
    return now[gaps]


def places(x: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs as in costs(): whether several placements of gaps reach the least mismatches, and the gaps' columns (bits) of one that does."""
    n, far = len(x), np.int8(S.LENGTH + 1)
    gaps, pairs = S.LENGTH - n, x.shape[1]
    now, many, at = np.full((gaps + 1, pairs), far, np.int8), np.zeros((gaps + 1, pairs), bool), np.zeros((gaps + 1, pairs), np.uint32)
    now[0] = 0
    for j in range(S.LENGTH):
        filled = (references[j] != 0).view(np.int8)
        for g in range(min(gaps, j + 1), max(0, j + 1 - n) - 1, -1):
            keep = now[g] + (x[j - g] != references[j]) if j >= g else np.full(pairs, far, np.int8)
            skip = now[g - 1] + filled if g else np.full(pairs, far, np.int8)
            if g:
                fewer = skip < keep
                many[g] = np.where(fewer, many[g - 1], many[g] | ((skip == keep) & (keep < far)))
                at[g] = np.where(fewer, at[g - 1] | np.uint32(1 << j), at[g])
            now[g] = np.minimum(np.minimum(keep, skip), far)
        now[: max(0, j + 1 - n)] = far
    return many[gaps], at[gaps]


class Placed:
    """For each raw sequence of a block the least mismatches with the references that it met, and how its gaps lie there.

    Strings of a raw sequence differ if and only if their gaps' columns do, so these bits stand for strings. Pairs are told apart by
    a bound first: a residue that differs from the reference at all places that the gaps leave it costs one, and so
    do gaps beyond the reference's own. Only pairs whose bound is no more than what is best so far are placed.
    """

    CELLS, PAIRS = 1 << 22, 1 << 16

    def __init__(self, x: B.Block):
        self.words, self.rid = x.words.copy(), np.array(x.numbers("rid"))
        self.length = S.LENGTH - np.bitwise_count(B.gaps(self.words)).astype(int)
        rows = len(self.rid)
        self.cost, self.used = np.full(rows, S.LENGTH + 1, np.int8), np.zeros(rows, np.int8)
        self.many, self.at = np.zeros(rows, bool), np.zeros(rows, np.uint32)

    def meet(self, y: B.Block) -> None:
        blank, references = B.gaps(y.words), B.letters(y.words)
        own_gaps = np.bitwise_count(blank).astype(int)
        step = max(1, self.CELLS // len(blank))
        shifted: list[np.ndarray] = []
        for n in np.unique(self.length)[::-1].tolist():
            gaps = S.LENGTH - n
            while len(shifted) <= gaps:
                shifted.append(np.ascontiguousarray(y.words >> np.uint32(len(shifted))))
            beyond = np.maximum(gaps - own_gaps, 0).astype(np.uint8)
            rows = np.flatnonzero(self.length == n)
            for k in range(0, len(rows), step):
                self._meet(rows[k : k + step], n, shifted[: gaps + 1], beyond, blank, references)

    def _meet(self, rows: np.ndarray, n: int, shifted: list[np.ndarray], beyond: np.ndarray, blank: np.ndarray, references: np.ndarray) -> None:
        bound = np.empty((len(rows), len(blank)), np.uint8)
        apart, one, always = np.empty((3, len(blank)), np.uint32)
        residues = np.uint32((1 << n) - 1)
        for k, row in enumerate(rows):
            own = self.words[:, row]
            for shift, words in enumerate(shifted):
                into = apart if shift else always
                np.bitwise_xor(words[0], own[0], out=into)
                for b in range(1, B.BITS):
                    np.bitwise_xor(words[b], own[b], out=one)
                    np.bitwise_or(into, one, out=into)
                if shift:
                    np.bitwise_and(always, apart, out=always)
            np.bitwise_and(always, residues, out=always)
            np.bitwise_count(always, out=bound[k])
        x = B.letters(self.words[:, rows])[:n]
        if len(shifted) == 1:  # nothing to place: the bound is the cost
            least = bound.min(1)
            i, r = np.nonzero(bound == np.where(least <= self.cost[rows], least, 255).astype(np.uint8)[:, None])
            self._keep(rows, i, least[i].astype(np.int8), np.zeros(len(i), bool), np.zeros(len(i), np.uint32), blank[r])
            return
        bound += beyond
        first = bound.argmin(1)
        best = np.minimum(self.cost[rows], costs(x, references[:, first]))
        i, r = np.nonzero(bound <= best.astype(np.uint8)[:, None])
        for k in range(0, len(i), self.PAIRS):
            pi, pr = i[k : k + self.PAIRS], r[k : k + self.PAIRS]
            cost = costs(x[:, pi], references[:, pr])
            least = best.copy()
            np.minimum.at(least, pi, cost)
            best = least
            tied = np.flatnonzero(cost == best[pi])
            pi, pr = pi[tied], pr[tied]
            many, at = places(x[:, pi], references[:, pr])
            self._keep(rows, pi, cost[tied], many, at, blank[pr])

    def _keep(self, rows: np.ndarray, i: np.ndarray, cost: np.ndarray, many: np.ndarray, at: np.ndarray, blank: np.ndarray) -> None:
        """Takes in placements of the rows' i-th sequences, all of one sequence at one cost, which is no more than its own."""
        row = rows[i]
        better = cost < self.cost[row]
        fresh = row[better]
        self.cost[fresh], self.many[fresh], self.used[fresh], self.at[fresh] = cost[better], False, 0, at[better]
        self.many[row[many | (at != self.at[row])]] = True
        np.maximum.at(self.used, row, (S.LENGTH - np.bitwise_count(at & blank)).astype(np.int8))

    def found(self) -> Iterator[pa.RecordBatch]:
        there = np.flatnonzero(self.used)
        yield pa.RecordBatch.from_arrays([pa.array(self.rid[there]), pa.array(self.cost[there].astype(np.int32)), pa.array(self.many[there]), pa.array(self.at[there].astype(np.int64)), pa.array(self.used[there].astype(np.int32))], ["rid", "cost", "many", "at", "used"])


#: Mismatches of a string that isn't too far: it differs from a reference in four columns at most (of 26 to 30 that count).
MOST = 4
#: A pair of two blocks, beside a pair that meets by a seed, and what seeds cost in such pairs whatever they find and for each key.
PRODUCT_COST, LEVEL_COST, KEY_COST = 0.02, 4e6, 0.5
#: Rows of a task that emits keys and pairs of one that places them, about.
ROWS, PAIRS = 1 << 14, 1 << 18


def _pieces(n: int) -> list[tuple[int, int]]:
    """First residue and length of the MOST + 1 pieces of a raw sequence."""
    ends = [n * k // (MOST + 1) for k in range(MOST + 2)]
    return [(a, b - a) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _seeds(chosen: DataFrame, donors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, qid and aligned of both sides, once for each key: every pair with MOST mismatches or fewer has a key in common.

    A mismatch is in one piece of the raw sequence, and so is a gap at a residue of the reference, if it lies within a piece at all. One
    of MOST + 1 pieces has none. It equals consecutive residues of the reference, and begins in a column that is
    as far from its own place as there are gaps before it. So keys are a column and the residues from there on.
    """
    of, key = {n: _pieces(n) for n in range(LEAST, S.LENGTH + 1)}, lambda column, text: F.xxhash64(column.cast("int"), text)
    keys = F.lit(None).cast("array<bigint>")
    for n, pieces in of.items():
        here = F.array(*(key(F.lit(i + g), F.substring("aligned", i + 1, m)) for i, m in pieces for g in range(S.LENGTH - n + 1)))
        keys = F.when(F.length(F.rtrim("aligned", F.lit(S.GAP))) == n, here).otherwise(keys)
    x = chosen.select(F.explode(keys).alias("key"), F.col("rid").alias("qid"), "aligned")
    bare, before = F.replace("aligned", F.lit(S.GAP), F.lit("")), lambda c: F.replace(F.substring("aligned", 1, c), F.lit(S.GAP), F.lit(""))
    found = []
    for c in range(S.LENGTH):
        for m in sorted({m for pieces in of.values() for _, m in pieces}):
            text = F.substr(bare, F.length(before(c)) + 1, F.lit(m))
            found.append(F.when((F.substring("aligned", c + 1, 1) != S.GAP) & (F.length(text) == m), key(F.lit(c), text)))
    y = donors.select(F.explode(F.array_compact(F.array(*found))).alias("key"), F.col("did").alias("qid"), "aligned")
    return x, y


def _by_seeds(chosen: DataFrame, donors: DataFrame, level_cost: float) -> DataFrame | None:
    """What Placed finds with MOST mismatches or fewer, from pairs that meet by seeds, some of them more than once; None if blocks cost less. The pairs are counted before they are made."""
    counts = chosen.count(), donors.count()
    products = PRODUCT_COST * counts[0] * counts[1]
    if products < 4 * level_cost:
        return None
    chosen, donors = (side.repartition(max(1, -(-n // ROWS)), name) for side, n, name in zip((chosen, donors), counts, ("rid", "did"), strict=True))
    sides = tuple(map(cut, _seeds(chosen, donors)))
    meetings = P.meetings(*sides)
    if products < 4 * (level_cost + KEY_COST * sum(side.count() for side in sides) + meetings):
        return None
    tasks = min(B.TASKS, max(1, math.ceil(meetings / PAIRS)))  # keys are small, what meets by them isn't
    x, y = (side.repartition(tasks, "key", "i", "j") for side in P.cells(*sides, by="qid"))
    pairs = x.select("key", "i", "j", F.col("qid").alias("rid"), F.col("aligned").alias("of")).join(y.select("key", "i", "j", F.col("aligned").alias("reference")), ["key", "i", "j"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.uint32(1) << np.arange(S.LENGTH, dtype=np.uint32)[:, None]
        for batch in batches:
            rid, x, y = batch.column(0).to_numpy(), *(np.ascontiguousarray(B.numbers(batch.column(k)).T) for k in (1, 2))
            length = (x != 0).sum(0)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                cost = costs(x[:n, own], y[:, own])
                near = cost <= MOST
                own, cost = own[near], cost[near]
                many, at = places(x[:n, own], y[:, own])
                blank = ((y[:, own] == 0) * bits).sum(0, dtype=np.uint32)
                used = S.LENGTH - np.bitwise_count(at & blank)
                yield pa.RecordBatch.from_arrays([pa.array(rid[own]), pa.array(cost.astype(np.int32)), pa.array(many), pa.array(at.astype(np.int64)), pa.array(used.astype(np.int32))], ["rid", "cost", "many", "at", "used"])

    return pairs.select("rid", "of", "reference").mapInArrow(place, PLACED)


PLACED = "rid long, cost int, many boolean, at long, used int"


def prepared(raws: DataFrame, references: DataFrame, near: bool = False, level_cost: float = LEVEL_COST) -> DataFrame:
    """raw, aligned and status of distinct sequences: direct or mapped_unambiguously with the aligned string, or invalid, ambiguous or too_far.

    A string of identity 0.85 with any reference has MOST mismatches at most, so the references with the least mismatches tell
    whether there is one. With near, sequences that no reference comes as near to are too_far, ambiguous or not, and the
    pairs meet by seeds where these cost under a fourth of what all pairs do.
    """
    valid = (F.length("raw").between(LEAST, S.LENGTH)) & ~F.col("raw").rlike(f"[^{S.ALPHABET[1:]}]")
    rows = cut(raws.select("raw", valid.alias("valid"), F.monotonically_increasing_id().alias("rid")))
    chosen = rows.filter("valid").select(F.rpad("raw", S.LENGTH, S.GAP).alias("aligned"), "rid")
    donors = cut(references.select("aligned").distinct().withColumn("did", F.monotonically_increasing_id()))
    each = _by_seeds(chosen, donors, level_cost) if near else None
    if each is None:
        each = B.streamed(chosen, ["rid"], donors, ["did"], Placed, Placed.meet, PLACED)
    if near:
        each = each.filter(F.col("cost") <= MOST)
    level = each.groupBy("rid", "cost").agg((F.bool_or("many") | (F.min("at") < F.max("at"))).alias("many"), F.min("at").alias("at"), F.max("used").alias("used"))
    best = level.groupBy(F.col("rid").alias("of")).agg(F.min(F.struct("cost", "many", "at", "used")).alias("m")).select("of", "m.*")
    fate = best.select("of", "at", F.when(F.col("many"), "ambiguous").when((F.col("used") - F.col("cost")) / F.col("used") < 0.85, "too_far").alias("fate"))
    both = rows.join(fate, F.col("rid") == F.col("of"), "left")
    mapped = F.when(F.length("raw") == S.LENGTH, "direct").otherwise("mapped_unambiguously")
    status = F.when(~F.col("valid"), "invalid").when(F.col("of").isNull(), "too_far").otherwise(F.coalesce("fate", mapped))
    return both.select("raw", status.alias("status"), "at").select("raw", F.when(F.col("status").isin("direct", "mapped_unambiguously"), _with_gaps(F.col("raw"), F.col("at"))).alias("aligned"), "status")


def _with_gaps(raw: Column, at: Column) -> Column:
    """raw with gaps at the columns whose bits are set."""
    step = lambda out, j: F.when(F.getbit(at, j) == 1, F.concat(out, F.lit(S.GAP))).otherwise(F.concat(out, F.substr(raw, j + 1 - (F.length(out) - F.length(F.replace(out, F.lit(S.GAP), F.lit("")))), F.lit(1))))
    return F.aggregate(F.sequence(F.lit(0), F.lit(S.LENGTH - 1)), F.lit(""), step)
