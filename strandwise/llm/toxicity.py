"""Toxic passages as maximum-scoring segments of token log-odds.

A token's log-odds of standing in a toxic document have a Dirichlet prior from its five-byte prefix,
that one's from the four-byte prefix, and that one's from all tokens, so forms that were never seen
score as their stem does. Less a drift they are negative on average, and a linear-time scan (all
maximal scoring segments, after Ruzzo and Tompa) finds the passages. By the extreme-value law of such
scans, a passage of score S in a text of n tokens has K n exp(-L S) rivals by chance; L solves
sum p exp(L s) = 1 over the token scores of clean documents, K is fitted to the highest scores of
these. A document's statistic is the sum of L S - ln(K n) over its significant passages, and a
logistic curve, fitted on labelled rows that the counts didn't see, makes it a probability.

The model learns from at most `rows` labelled rows, those with the smallest hashes of the id; label
rows of one id count as one, toxic if any is. Labels null or of no document are ignored. Null or empty
texts have no passages and the score of such. Texts of any length are scanned whole, every word of them.
All learned features count, however many: they are sorted hash arrays in the shared folder, mapped by
workers, until drop(). Copies and ties score alike; with an empty table or labels of one kind alone all scores are the
prior's. Only id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm import common as C
from strandwise.llm.common import U64
from strandwise.llm.counting import RUN, Runs, bits_for, by_part, merged

_WORD = np.zeros(256, bool)
_WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
PREFIXES = (4, 5)


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts and ends of the words, their rows' offsets, and hashes of 4-prefix, 5-prefix and word (0: no such prefix)."""
    low = C.LOWER[data]
    starts, ends = C.runs(_WORD[low], offs)
    hashes = []
    for salt, size in enumerate(PREFIXES, 1):
        h = C.token_hashes(low, starts, np.minimum(starts + size, ends))
        hashes.append(np.where(ends - starts > size, C.mix(h + U64(salt)), U64(0)))
    return starts, ends, C.per_row(starts, offs), *hashes, C.token_hashes(low, starts, ends)


class LogOdds:
    """Log-odds by hash, from the most to the least specific: 4-prefixes, 5-prefixes, words."""

    def __init__(self, levels: list[C.HashArrays]):
        self.levels = levels

    def of(self, hashes: list[np.ndarray], upto: int | None = None) -> np.ndarray:
        out = np.zeros(len(hashes[0]))
        for arrays, h in zip(self.levels[:upto], hashes, strict=False):
            kinds, _, inverse = C.distinct(h)
            held, (value,) = arrays.look(kinds)
            out = np.where(held[inverse], value[inverse], out)
        return out


def maximal_segments(scores: list[float], starts: list[int], ends: list[int], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of positive items between which every position costs `gap`: (start, end, score).

    A segment keeps its nearest predecessor of a lower left sum, so a search goes past those in between
    without looking at them again, and the time is linear.
    """
    start, end, left, right, lower = [], [], [], [], []
    total, at = 0.0, 0
    for s, i, j in zip(scores, starts, ends, strict=True):
        total -= gap * (i - at)
        a, x, y = i, total, total + s
        total, at = y, j
        k = len(start) - 1
        while True:
            while k >= 0 and left[k] >= x:
                k = lower[k]
            if k < 0 or right[k] >= y:
                break
            a, x, above, k = start[k], left[k], k, lower[k]
            del start[above:], end[above:], left[above:], right[above:], lower[above:]
        start.append(a), end.append(j), left.append(x), right.append(y), lower.append(k)
    return [(i, j, r - x) for i, j, x, r in zip(start, end, left, right, strict=True)]


def _solve_lambda(values: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p exp(L v) = 1 for a mean below 0 and some v above 0."""
    if not len(values) or values.max() <= 0 or (values * p).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (p * np.exp(high * values)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * values)).sum() < 1 else (low, mid)
    return low


class ToxicPassages:
    def __init__(self, folder: C.SharedFolder, odds: LogOdds, drift: float, scale: float, constant: float, curve: tuple[float, float]):
        self.folder, self.odds, self.drift, self.scale, self.constant, self.curve = folder, odds, drift, scale, constant, curve

    def drop(self) -> None:
        """Removes the features; what was scored must have been written before."""
        self.folder.drop()

    # -------------------------------------------------------------- scanning

    def scan(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """For each row the number of words and its maximal segments (bytes from, bytes to, score)."""
        starts, ends, at, *hashes = words_of(data, offs)
        s = self.odds.of(hashes) - self.drift
        # words below zero cost what they score; cumulated, so that a gap's cost is a difference
        cost = np.concatenate(([0.0], np.cumsum(np.where(s > 0, 0.0, -s))))
        hits = np.flatnonzero(s > 0)
        of = np.searchsorted(hits, at)
        for row in range(len(offs) - 1):
            here = hits[of[row] : of[row + 1]]
            found = maximal_segments(s[here].tolist(), cost[here].tolist(), cost[here].tolist(), 1.0) if len(here) else []
            if found:  # positions in cost name the words: several hits without a gap share one
                first = np.searchsorted(cost[here], [x[0] for x in found])
                last = np.searchsorted(cost[here], [x[1] for x in found], "right") - 1
                base = offs[row]
                found = [(int(starts[here[a]] - base), int(ends[here[b]] - base), x[2]) for a, b, x in zip(first, last, found, strict=True)]
            yield int(at[row + 1] - at[row]), found

    def passages(self, n: int, segments: list[tuple[int, int, float]]) -> list[tuple[int, int, float, float]]:
        """Those significant in a text of n words, each with its excess over chance."""
        level = np.log(max(self.constant * n, 1e-9))
        return [(a, b, s, self.scale * s - level) for a, b, s in segments if self.scale * s > level]

    def probability(self, statistic: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(statistic), -50, 50)))

    def statistics(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list]:
        found = [self.passages(n, segments) for n, segments in self.scan(data, offs)]
        return np.array([sum(x[3] for x in f) for f in found]), found

    # -------------------------------------------------------------- Spark side

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, train: Column, rows: int = 30_000, prior: float = 20.0, drift: float = 1.5) -> ToxicPassages:
        """train: over labels (doc_id, toxic), which rows may be learned from. rows bounds the fit."""
        chosen = labels.filter(train & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("labelled_id")).agg(F.max(F.col("toxic").cast("int")).alias("is_toxic")).orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(rows)
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        # at most `rows` ids are broadcast
        sample = C.cut(texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select("text", "is_toxic", (F.pmod(F.xxhash64("labelled_id"), F.lit(5)) == 4).alias("held")))
        counted = sample.filter(~F.col("held")).select("text", "is_toxic")
        size = counted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = bits_for(size // 6, 1 << 20)
        folder = C.SharedFolder.create(docs.sparkSession, "toxic-features")

        def counts_of(level: int, odds: LogOdds | None):
            def count(batches):
                held = Runs(bits, 3)
                for batch in batches:
                    toxic = batch.column(1).to_numpy(zero_copy_only=False)
                    for i, j, data, offs in C.text_blocks(batch):
                        _, _, at, *hashes = words_of(data, offs)
                        label = np.repeat(toxic[i:j], np.diff(at)).astype(np.int64)
                        parent = np.zeros(len(label)) if odds is None else odds.of(hashes, level)
                        columns = np.stack([label, 1 - label, np.round(1000 * parent).astype(np.int64)])
                        keep = hashes[level] != 0
                        yield from held.add(*C.sum_by_key(hashes[level][keep], columns[:, keep]))
                yield from held.close()

            return count

        total = counted.mapInArrow(counts_of(2, None), RUN)

        def totals(found: pa.Table) -> pa.Table:
            _, c = merged(found, 3)
            return pa.table({"toxic": pa.array([float(c[0].sum())]), "clean": pa.array([float(c[1].sum())])})

        ones, zeros = by_part(total, bits, totals, "toxic double, clean double").agg(F.coalesce(F.sum("toxic"), F.lit(0.0)), F.coalesce(F.sum("clean"), F.lit(0.0))).first()
        share = min(max((ones + 0.5) / (ones + zeros + 5), 1e-6), 1 - 1e-6)
        centre = np.log(share / (1 - share))
        odds = LogOdds([])
        for level in range(3):
            arrays = C.HashArrays(folder.uri, f"level-{level}", bits, 1)

            def weigh(found: pa.Table) -> pa.Table:
                keys, c = merged(found, 3)
                n = c[0] + c[1]
                parent = c[2] / 1000 / np.maximum(n, 1)
                p = 1 / (1 + np.exp(-np.clip(parent + centre, -30, 30)))
                q = (c[0] + prior * p) / (n + prior)
                value = np.log(q / (1 - q)) - centre
                keep = np.abs(value - parent) > 0.5
                arrays.write(found["part"][0].as_py(), keys[keep], value[None, keep])
                return pa.table({"n": pa.array([int(keep.sum())], pa.int64())})

            by_part(counted.mapInArrow(counts_of(level, odds), RUN), bits, weigh, "n long").agg(F.sum("n")).first()
            odds = LogOdds([*odds.levels, arrays])
        model = cls(folder, odds, drift, 1.0, 1.0, (0.0, 1.0))
        # what clean documents score by chance, then the curve
        held = sample.filter("held").select("text", "is_toxic")
        step = 4

        def chance(batches):
            for batch in batches:
                toxic = batch.column(1).to_numpy(zero_copy_only=False)
                for i, j, data, offs in C.text_blocks(batch):
                    _, _, at, *hashes = words_of(data, offs)
                    label = np.repeat(toxic[i:j], np.diff(at))
                    s = np.round((odds.of(hashes) - drift)[label == 0] * step).astype(np.int64)
                    values, n = np.unique(s, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], ["s", "n"])

        steps = held.mapInArrow(chance, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()  # a row for each quarter of a unit
        values, n = np.array([r.s for r in steps], float) / step, np.array([r.n for r in steps], float)
        model.scale = _solve_lambda(values, n / max(n.sum(), 1))

        def highest(batches):
            for batch in batches:
                for i, j, data, offs in C.text_blocks(batch):
                    scans = list(model.scan(data, offs))
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in scans], pa.int64()), pa.array([max([s for *_, s in f], default=0.0) for _, f in scans], pa.float64()), pa.array([[s for *_, s in f] for _, f in scans], pa.list_(pa.float64())), batch.column(1).slice(i, j - i)], ["n", "top", "scores", "is_toxic"])

        seen = held.mapInArrow(highest, "n long, top double, scores array<double>, is_toxic int").toArrow()  # at most a fifth of `rows`
        n, top, toxic = (seen[x].to_numpy() for x in ("n", "top", "is_toxic"))
        clean = (toxic == 0) & (n > 0) & (top > 0)
        model.constant = float(np.exp(np.mean(model.scale * top[clean] - np.log(n[clean])) - np.euler_gamma)) if clean.any() else 1e-3
        x = np.array([sum(e for *_, e in model.passages(int(k), [(0, 0, s) for s in f])) for k, f in zip(n, seen["scores"].to_pylist(), strict=True)])
        model.curve = _logistic(np.log1p(x), toxic.astype(float), share)
        return model

    def score(self, docs: DataFrame, flag: Column | None = None) -> DataFrame:
        """doc_id, the flag, score, predicted, the statistic and the significant passages (bytes from and to, score, excess) of every row."""
        model = self
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("excess", pa.float64())]))

        def scored(batches):
            for batch in batches:
                for i, j, data, offs in C.text_blocks(batch):
                    x, found = model.statistics(data, offs)
                    p = model.probability(x)
                    rows = [[{"start": a, "end": b, "score": s, "excess": e} for a, b, s, e in f] for f in found]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(x, pa.float64()), pa.array(rows, kind)], ["doc_id", "held_out", "score", "predicted", "statistic", "passages"])

        chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))).alias("held_out"), F.col("text").cast("string").alias("text"))
        return chosen.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int, statistic double, passages array<struct<start:long,end:long,score:double,excess:double>>")

    def keep_clean(self, docs: DataFrame) -> DataFrame:
        """docs without the rows that are predicted toxic; all columns as they were."""
        model, at = self, docs.columns.index("text")

        def kept(batches):
            for batch in batches:
                texts = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
                x = [model.statistics(data, offs)[0] for *_, data, offs in C.text_blocks(texts)]
                if x:
                    yield batch.filter(pa.array(model.probability(np.concatenate(x)) < 0.5))

        return docs.mapInArrow(kept, docs.schema)


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Intercept and slope by penalised Newton steps."""
    if not len(x) or y.min() == y.max():
        return float(np.log(share / (1 - share))), 0.0 if not len(x) else 1.0
    design = np.stack([np.ones(len(x)), x], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 0.01 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])
