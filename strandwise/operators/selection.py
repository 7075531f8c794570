"""Exact quantiles of many columns and groups at once, by narrowing the bits of doubles.

The bits of a double, with their sign turned, order like the numbers. A round counts, for the values
that share the bits known so far of a wanted order statistic, the next 16 bits; the bucket that
holds the wanted rank is known by the counts, so four rounds give the number itself. Tasks count
their own rows and give the buckets that aren't empty, so neither rows nor distinct values of a group
ever meet in a task.

Targets are unions of groups, whose counts add up: the complement of a fold is counted from the
other folds, without its rows being copied. Nulls don't count; NaN is above all numbers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.operators.graph import cut

ROUND_BITS = 16
#: Groups whose counts the driver adds up.
MOST_GROUPS = 10_000
_SIGN = np.uint64(1 << 63)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned words in the order of the doubles; -0.0 is 0.0."""
    bits = (np.asarray(values, float) + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def from_bits(word: int) -> float:
    bits = word ^ (1 << 63) if word >> 63 else ~word & (1 << 64) - 1
    return float(np.array([bits], np.uint64).view(float)[0])


def _counts(rows: DataFrame, columns: list[str], known: dict[tuple[str, int], list[int]], done: int) -> dict[tuple[str, int], dict[int, dict[int, int]]]:
    """By group and column, for each known prefix of `done` bits how often each value of the next bits occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int, int], np.ndarray] = {}
        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            names, code = groups.dictionary.to_pylist(), groups.indices.to_numpy()
            for k in range(len(columns)):
                column = batch.column(k + 1)
                there = column.is_valid().to_numpy(zero_copy_only=False)
                bits = ordered_bits(column.fill_null(0.0).to_numpy())
                for g, name in enumerate(names):
                    own = bits[there & (code == g)]
                    for prefix in known.get((name, k), ()):
                        here = own[own >> np.uint64(64 - done) == np.uint64(prefix)] if done else own
                        if len(here):
                            seen = np.bincount(((here >> np.uint64(64 - done - ROUND_BITS)) & np.uint64((1 << ROUND_BITS) - 1)).astype(np.int64), minlength=1 << ROUND_BITS)
                            found[name, k, prefix] = found.get((name, k, prefix), 0) + seen
        for (name, k, prefix), seen in found.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), prefix, np.uint64).view(np.int64)), pa.array(at.astype(np.int32)), pa.array(seen[at])], ["g", "k", "prefix", "bucket", "n"])

    parts = rows.mapInArrow(count, "g string, k int, prefix long, bucket int, n long").groupBy("g", "k", "prefix", "bucket").agg(F.sum("n").alias("n"))
    out: dict = defaultdict(lambda: defaultdict(dict))
    for r in parts.collect():  # at most 2**16 rows for each group, column and prefix
        out[r.g, r.k][r.prefix & (1 << 64) - 1][r.bucket] = r.n
    return out


def exact_quantiles(rows: DataFrame, columns: list[str], quantiles: list[float], by: str | None = None, complements: bool = False) -> dict[str | None, list[list[float | None]]]:
    """For each group of `by` (or its complement in all rows, or None for all rows): of each column its quantiles, linear between order statistics.

    Columns without a value have None. Groups are named by their text.
    """
    group = F.lit("") if by is None else F.coalesce(F.col(by).cast("string"), F.lit("\0null"))
    rows = cut(rows.select(group.alias("g"), *(F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns))))
    names = [f"c{k}" for k in range(len(columns))]
    sizes = {r.g: r[1:] for r in rows.groupBy("g").agg(*(F.count(c) for c in names)).limit(MOST_GROUPS + 1).collect()}
    if len(sizes) > MOST_GROUPS:
        raise ValueError(f"over {MOST_GROUPS} groups: their order statistics aren't counted at once")
    members = {t: [g for g in sizes if (g != t) == complements] for t in sizes}
    wanted: dict[tuple[str, int, int], list[int]] = {}  # target, column, rank: known prefix, rank within it
    for t, own in members.items():
        for k in range(len(columns)):
            n = sum(sizes[g][k] for g in own)
            for q in quantiles if n else ():
                place = q * (n - 1)
                for rank in {int(np.floor(place)), int(np.ceil(place))}:
                    wanted[t, k, rank] = [0, rank]
    for done in range(0, 64, ROUND_BITS):
        known: dict[tuple[str, int], set[int]] = defaultdict(set)
        for (t, k, _), (prefix, _) in wanted.items():
            for g in members[t]:
                known[g, k].add(prefix)
        counts = _counts(rows, names, {x: sorted(p) for x, p in known.items()}, done) if wanted else {}
        for (t, k, _), state in wanted.items():
            prefix, rank = state
            total: dict[int, int] = defaultdict(int)
            for g in members[t]:
                for bucket, n in counts[g, k][prefix].items():
                    total[bucket] += n
            for bucket in sorted(total):
                if rank < total[bucket]:
                    break
                rank -= total[bucket]
            state[:] = prefix << ROUND_BITS | bucket, rank
    out: dict[str | None, list[list[float | None]]] = {}
    for t, own in members.items():
        lines = []
        for k in range(len(columns)):
            n = sum(sizes[g][k] for g in own)
            line: list[float | None] = []
            for q in quantiles:
                if not n:
                    line.append(None)
                    continue
                place = q * (n - 1)
                low, high = (from_bits(wanted[t, k, int(f(place))][0]) for f in (np.floor, np.ceil))
                line.append(low if low == high else float(low + (high - low) * (place - np.floor(place))))
            lines.append(line)
        out[None if by is None or t == "\0null" else t] = lines
    return out


def grouped_ranks(counts: DataFrame, by: list[str], value: str, n: str, name: str) -> DataFrame:
    """counts (a row for each group and value, with its number of rows n) with the average rank of the value's rows in their group.

    Range partitions by group and value are summed up within tasks; only the group that a task begins with may have rows before
    it, so one number for each task is all that is added. No task holds a group.
    """
    keys = [*by, value]

    def upto(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, last, before = TaskContext.get().partitionId(), -1, None, 0
        for batch in batches:
            own = list(zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in by), strict=True))
            sizes, seqs, starts = batch.column(batch.schema.names.index(n)).to_pylist(), [], []
            for group, size in zip(own, sizes, strict=True):
                if seq < 0 or group != last:
                    seq, last, before = seq + 1, group, 0
                seqs.append(seq)
                starts.append(before)
                before += size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), part), pa.int32()), pa.array(seqs, pa.int64()), pa.array(starts, pa.int64())], [*batch.schema.names, "__part", "__seq", "__before"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema.fields)
    run = cut(counts.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(upto, f"{schema}, __part int, __seq long, __before long"))
    group = F.struct("__seq", *by)
    ends = run.groupBy("__part").agg(F.min(group).alias("first"), F.max(group).alias("last"), F.sum(F.when(F.col("__seq") == 0, F.col(n))).alias("n_first"), F.max(F.struct("__seq", (F.col("__before") + F.col(n)).alias("n"))).alias("n_last"))
    carried, rows, at = 0, [], None
    for p in ends.orderBy("__part").collect():  # a row for each task
        if at is None or tuple(p.first[1:]) != at:
            carried = 0
        rows.append((p["__part"], carried))
        carried = carried + p.n_first if p.last[0] == 0 else p.n_last.n
        at = tuple(p.last[1:])
    offsets = counts.sparkSession.createDataFrame(rows, "__of int, __more long")
    placed = run.join(F.broadcast(offsets), F.col("__part") == F.col("__of"))  # a row for each task
    rank = F.col("__before") + F.when(F.col("__seq") == 0, F.col("__more")).otherwise(F.lit(0)) + (F.col(n) + 1) / 2.0
    return placed.withColumn(name, rank).drop("__part", "__seq", "__before", "__of", "__more")
