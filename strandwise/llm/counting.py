"""Counting of 64-bit hashes in Spark: tasks sum keys in memory and give sorted, delta-coded runs, one for each part that has keys.

A part is the keys with the same leading bits of their hash, so a hot key is one row of a run and no
part is hot. The parts' number follows the input (see `bits_for`), not their size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandwise.llm import common as C
from strandwise.llm.common import U64

RUN = "part long, n long, keys binary, sums binary"
HELD = 12 << 20  # numbers that a task holds before it sums them
#: Fractions go out in whole parts of at least this many: 1/2 to 1/10 are exact.
PARTS = 2520 << 10


def bits_for(items: int, items_a_part: int) -> int:
    """Leading bits that name a part, for parts of about items_a_part."""
    return max(2, (int(items) // items_a_part).bit_length())


def parts_for(keys: int, tasks: int, columns: int) -> int:
    """Parts of 1 in which fractions go out, so that the rounding of all runs together is under a fourth.

    keys: the most that all tasks add. Before its last run, a task gives one only when it holds over half of what it may, so
    there are at most this many runs; each is off by half a part at most.
    """
    runs = tasks + keys // (HELD // (1 + columns) // 2)
    parts = PARTS
    while parts < 2 * runs:
        parts *= 2
    return parts


class Runs:
    """Sums columns (a row of an array for each) by key and cuts the sums into sorted runs. Columns from `whole` on may be fractions."""

    def __init__(self, bits: int, columns: int = 1, whole: int | None = None, parts: int = PARTS):
        self.bits, self.columns, self.whole, self.parts = bits, columns, columns if whole is None else whole, parts
        self.dtype = np.int64 if whole is None else np.float64
        self.held, self.size, self.most = [], 0, HELD // (1 + columns)

    def add(self, keys: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, sums.astype(self.dtype, copy=False).reshape(self.columns, len(keys))))
        self.size += len(keys)
        if self.size > self.most:
            keys, sums = self._sum()
            if len(keys) > self.most // 2:
                yield from self._out(keys, sums)
            else:
                self.held, self.size = [(keys, sums)], len(keys)

    def _sum(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.held] or [np.zeros(0, U64)])
        sums = np.concatenate([c for _, c in self.held] or [np.zeros((self.columns, 0), self.dtype)], axis=1)
        self.held, self.size = [], 0
        return C.sum_by_key(keys, sums)

    def _out(self, keys: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.dtype == np.float64:
            sums = np.rint(sums * _scale(self.columns, self.whole, self.parts))
            if sums.max(initial=0) >= 2.0**63:
                raise OverflowError("a task's sum of fractions is beyond 64 bits: it needs smaller tasks")
            sums = sums.astype(np.int64)
        for part, i, j in C.parts_of(keys, self.bits):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([j - i], pa.int64()), pa.array([C.pack_sorted(keys[i:j])], pa.binary()), pa.array([b"".join(len(x).to_bytes(4, "little") + x for x in (C.pack(column[i:j]) for column in sums))], pa.binary())], ["part", "n", "keys", "sums"])

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self._out(*self._sum())


def _scale(columns: int, whole: int, parts: int) -> np.ndarray:
    return np.where(np.arange(columns) < whole, 1.0, float(parts))[:, None]


def merged(rows: pa.Table, columns: int = 1, whole: int | None = None, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """The sum of a part's runs."""
    dtype = np.int64 if whole is None else np.float64
    total = sum(rows["n"].to_pylist())
    keys, sums, at = np.zeros(total, U64), np.zeros((columns, total), dtype), 0
    for n, k, c in zip(rows["n"].to_pylist(), rows["keys"], rows["sums"], strict=True):
        keys[at : at + n] = C.unpack_sorted(k.as_py(), n)
        blob, place = c.as_py(), 0
        for column in range(columns):
            size = int.from_bytes(blob[place : place + 4], "little")
            sums[column, at : at + n] = C.unpack(blob[place + 4 : place + 4 + size], n, np.int64)
            place += 4 + size
        at += n
    if whole is not None:
        sums /= _scale(columns, whole, parts)
    return C.sum_by_key(keys, sums)


def by_part(runs: DataFrame, bits: int, merge: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """merge() over each part's runs, in as many tasks as there are parts (at most 2**15)."""
    return runs.repartition(1 << min(bits, 15), "part").groupBy("part").applyInArrow(merge, schema)
