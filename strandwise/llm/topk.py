"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions of a vector are dealt to lists; a list ranks a block's candidates by its part of the
score. Candidates never move: they are packed into blocks by the tasks that read them, and the
queries, in blocks of their own, are files in the shared folder that these tasks map.
Phase 1: every list of every block gives a query its k best parts; the scores of those alone are
completed, and the k-th best of all tasks is the query's cutoff, which no result can be below.
Phase 2: the cutoffs are written beside the queries. A block whose norms can't reach a query's cutoff is
passed over; in the others each list takes the entries that reach an equal share of the cutoff (a score
of at least the cutoff has a part of at least cutoff/lists in some list, so nothing is missed) unless the
other lists couldn't lift them to it. A list whose norms can't reach the share isn't computed at all.
Phase 3: the parts that those entries lack are computed, and only entries at the cutoff leave the task.

Vectors are floor(256 * x) integers (at the ends of the 64-bit range beyond it); products are exact, and
scores beyond 64 bits count as the range's end. Vectors that are null or hold null or non-finite
components take no part, as query or candidate; empty vectors score 0; of two lengths the shorter is
padded by zeros. Repeated ids are separate candidates and separate queries (each with its own ranks), but a
candidate is never one of a query with its id. Ties go to the smaller id. Fewer candidates than k give
all. Blocks follow the rows as they are read, so neither equal vectors nor repeated ids are a hot group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm import common as C

BLOCK, QUERY_BLOCK = 2048, 512
ROUND = 256  # query blocks that a task goes through at once: its state is k numbers for each of their queries
NONE = np.iinfo(np.int64).min
FOUND = "block int, salt int, place binary, vec_id binary, score binary"


def integers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and comps, the whole numbers floor(256 * x), of vectors that take part."""
    v = F.col(vector)
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(whole & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * 256)).alias("comps"))


def dense(lists: pa.ListArray) -> np.ndarray:
    """A row for each list, padded by zeros."""
    n = np.diff(lists.offsets.to_numpy())
    flat, width = lists.flatten().to_numpy(), int(n.max(initial=0))
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), C.ragged(np.zeros(len(n), np.int64), n)] = flat
    return out


def same_width(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(q.shape[1], x.shape[1])
    pad = lambda a: a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))
    return pad(q), pad(x)


class Block:
    """A block of queries against a block of candidates."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, lists: int):
        q, x = same_width(q, x)
        self.qids, self.ids, self.lists = qids, ids, lists
        most = int(max(np.abs(q.astype(float)).max(initial=0), 1)) * int(max(np.abs(x.astype(float)).max(initial=0), 1)) * max(q.shape[1], 1)
        self.exact = most < 2**53  # doubles hold every sum
        cuts = np.linspace(0, q.shape[1], lists + 1).astype(int)
        kind = float if self.exact else object
        self.q, self.x = ([a[:, i:j].astype(kind) for i, j in zip(cuts[:-1], cuts[1:], strict=True)] for a in (q, x))

    def part(self, k: int) -> np.ndarray:
        return self.q[k] @ self.x[k].T

    def own(self) -> np.ndarray:
        return self.qids[:, None] == self.ids[None, :]

    def whole(self) -> np.ndarray:
        """All scores, held within 64 bits."""
        if not self.q[0].shape[1] + self.q[-1].shape[1]:
            return np.zeros((len(self.qids), len(self.ids)), np.int64)
        total = sum(self.part(k) for k in range(self.lists) if self.q[k].shape[1])
        return total.astype(np.int64) if self.exact else np.clip(total, NONE + 1, np.iinfo(np.int64).max).astype(np.int64)

    def best(self, k: int) -> np.ndarray:
        """Scores of the entries that some list has among its k best; -inf for places without one."""
        own, take = self.own(), min(k, len(self.ids))
        if not self.exact:
            total = np.where(own, NONE, self.whole())
            return np.sort(total, axis=1)[:, -take:]
        parts = [self.part(p) for p in range(self.lists)]
        listed = []
        for s in parts:
            s = np.where(own, -np.inf, s)
            listed.append(np.argpartition(s, len(self.ids) - take, axis=1)[:, -take:])
        at = np.sort(np.concatenate(listed, axis=1), axis=1)
        total = sum(np.take_along_axis(s, at, 1) for s in parts)
        again = np.zeros(at.shape, bool)
        again[:, 1:] = at[:, 1:] == at[:, :-1]
        return np.where(again | np.take_along_axis(own, at, 1), NONE, total).astype(np.int64)

    def reaching(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of all entries with scores of at least the cutoffs."""
        if not self.exact:
            total = self.whole()
            i, j = np.nonzero((total >= low[:, None]) & ~self.own())
            return i, j, total[i, j]
        norm = lambda a: np.sqrt(np.einsum("ij,ij->i", a, a))
        bound = np.stack([norm(a) * (norm(b).max(initial=0) * (1 + 1e-9)) for a, b in zip(self.q, self.x, strict=True)])
        live = np.flatnonzero(bound.sum(0) >= low)
        if not len(live):
            return live, live, live
        low, bound, parts = low[live].astype(float), bound[:, live], {}
        sent = np.zeros((len(live), len(self.ids)), bool)
        for k in range(self.lists):
            if (bound[k] >= low / self.lists).any():
                parts[k] = self.q[k][live] @ self.x[k].T
                sent |= parts[k] >= np.maximum(low / self.lists, low - (bound.sum(0) - bound[k]))[:, None]
        sent &= self.qids[live][:, None] != self.ids[None, :]
        i, j = np.nonzero(sent)
        total = np.zeros(len(i))
        for k in range(self.lists):  # phase 3: what an entry lacks
            total += parts[k][i, j] if k in parts else np.einsum("ij,ij->i", self.q[k][live[i]], self.x[k][j])
        keep = total >= low[i]
        return live[i[keep]], j[keep], total[keep].astype(np.int64)


def _first(place: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each query."""
    order = np.lexsort((vec_id, ~score, place))  # ~ reverses without overflow
    place = place[order]
    keep = _ranks(place) < k
    order = order[keep]
    return place[keep], vec_id[order], score[order]


def _ranks(place: np.ndarray) -> np.ndarray:
    """From 0 within each run of equal places."""
    if not len(place):
        return place
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return np.arange(len(place)) - np.repeat(first, np.diff(np.append(first, len(place))))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, lists: int = 2) -> DataFrame:
    """query_id, rank, vec_id and score. vectors: vec_id and comps of integers(); is_query is over vec_id."""
    spark = vectors.sparkSession
    folder = C.SharedFolder.create(spark, "top-k")
    try:
        return C.cut(_search(vectors, is_query, k, lists, folder))
    finally:
        folder.drop()


def _search(vectors: DataFrame, is_query: Column, k: int, lists: int, folder: C.SharedFolder) -> DataFrame:
    vectors = vectors.select("vec_id", "comps")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                ids, comps = (batch.column(c).slice(a, BLOCK) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (ids.to_numpy(), dense(comps))], ["ids", "comps"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, batch.num_rows, QUERY_BLOCK):
                ids, comps = batch.column(0).slice(a, QUERY_BLOCK).to_numpy(), dense(batch.column(1).slice(a, QUERY_BLOCK))
                name = f"q-{part}-{number}"
                folder.write(name, np.array([len(ids)], "<i8"), ids.astype("<i8"), comps.astype("<i8"))
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)], pa.int64())], ["name", "n"])

    candidates = C.cut(vectors.mapInArrow(blocks, "ids binary, comps binary"))
    asked = vectors.filter(is_query)
    names = sorted(r.name for r in asked.repartition(max(1, asked.count() // QUERY_BLOCK)).mapInArrow(ask, "name string, n long").collect())  # a row for each block of queries
    rounds = range(0, len(names), ROUND)
    salts = max(1, candidates.rdd.getNumPartitions() // 256)

    def queries(block: int) -> tuple[np.ndarray, np.ndarray]:
        raw = folder.map(names[block]).view("<i8")
        n = int(raw[0])
        return raw[1 : n + 1], raw[n + 1 :].reshape(n, -1)

    def met(batches: Iterator[pa.RecordBatch], upto: range) -> Iterator[tuple[int, Block]]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, comps = (np.frombuffer(batch.column(c)[row].as_py(), "<i8") for c in (0, 1))
                for b in upto:
                    yield b, Block(*queries(b), ids, comps.reshape(len(ids), -1), lists)

    def out(block: int, place: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        salt = TaskContext.get().partitionId() % salts
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([salt], pa.int32()), *(pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (place, vec_id, score))], ["block", "salt", "place", "vec_id", "score"])

    def first_phase(upto: range):
        def run(batches):
            tops: dict[int, np.ndarray] = {}
            for b, pair in met(batches, upto):
                found = pair.best(k)
                tops[b] = np.sort(np.concatenate([tops[b], found], axis=1) if b in tops else found, axis=1)[:, -k:]
            for b, top in tops.items():
                place, at = np.nonzero(top > NONE)
                yield out(b, place, np.zeros(len(place)), top[place, at])

        return run

    def second_phase(upto: range):
        def run(batches):
            held: dict[int, list] = {}
            cutoffs = {b: folder.map(f"low-{b}").view("<i8") for b in upto}  # none: no query of the block has a candidate
            for b, pair in met(batches, upto):
                low = cutoffs[b] if len(cutoffs[b]) else np.full(len(pair.qids), NONE)
                i, j, score = pair.reaching(low)
                if len(i):
                    own = held.setdefault(b, [])
                    own.append(_first(i, pair.ids[j], score, k))
                    if len(own) > 16:
                        held[b] = [_first(*(np.concatenate(x) for x in zip(*own, strict=True)), k)]
            for b, own in held.items():
                yield out(b, *_first(*(np.concatenate(x) for x in zip(*own, strict=True)), k))

        return run

    def entries(rows: pa.Table) -> tuple[np.ndarray, ...]:
        """The k best entries of a group of rows; of the first phase scores alone count."""
        columns = [np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in rows[c]]) for c in ("place", "vec_id", "score")]
        return _first(*columns, k)

    def merge(rows: pa.Table) -> pa.Table:
        found = [pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in entries(rows)]
        return pa.Table.from_arrays([rows["block"][:1], rows["salt"][:1], *found], ["block", "salt", "place", "vec_id", "score"])

    def write_cutoffs(rows: pa.Table) -> pa.Table:
        place, _, score = entries(rows)
        b = rows["block"][0].as_py()
        n = len(queries(b)[0])
        low, kth = np.full(n, NONE), _ranks(place) == k - 1
        low[place[kth]] = score[kth]  # fewer than k: everything counts
        folder.write(f"low-{b}", low.astype("<i8"))
        return pa.Table.from_arrays([rows["block"][:1]], ["block"])

    def answers(rows: pa.Table) -> pa.Table:
        place, vec_id, score = entries(rows)
        ids, _ = queries(rows["block"][0].as_py())
        return pa.Table.from_arrays([pa.array(ids[place]), pa.array((_ranks(place) + 1).astype(np.int32)), pa.array(vec_id), pa.array(score)], ["query_id", "rank", "vec_id", "score"])

    def gathered(phase) -> DataFrame:
        """A phase over all candidates, with its entries merged by salt, so that no group has more than 256 tasks' rows."""
        made = None
        for a in rounds:
            one = candidates.mapInArrow(phase(range(a, min(a + ROUND, len(names)))), FOUND)
            made = one if made is None else made.unionByName(one)
        return made if salts == 1 else made.groupBy("block", "salt").applyInArrow(merge, FOUND)

    result = "query_id long, rank int, vec_id long, score long"
    if not names:
        return candidates.sparkSession.createDataFrame([], result)
    gathered(first_phase).groupBy("block").applyInArrow(write_cutoffs, "block int").count()
    return gathered(second_phase).groupBy("block").applyInArrow(answers, result)
