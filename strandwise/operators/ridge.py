"""Component-weighted multi-output ridge over one-hot sequences.

Rows are reduced to per-component moments (a Gram block of 631 x 631, sums with the targets) in the
tasks that read them, and only moments move. In a fit every component weighs the same, so a fit
without one component is the sum of all components' normalised moments less its own: the sum is added up by
partitions, one for each outer fold.

A component of few rows (up to SMALL) has no moments of its own: its rows stay together, and its fits
are downdates. The sum of an outer fold is decomposed once, C = V diag(l) V'; without a component, C loses U'U, where
U are the component's centred rows, scaled, and the distance of its mean from all means. Then

    (C - U'U + a I)^-1 r = q + A^-1 U' (I - U A^-1 U')^-1 U q,  q = A^-1 r,  A = C + a I

takes a system of as many unknowns as the component has rows (and one) for each alpha. What moves is rows, not
3 MB of moments for each component and fold. A larger component's moments are decomposed by the task that has them, for
all alphas at once. No task has the rows or moments of all components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions import sequences as S
from strandwise.operators.graph import cut

FEATURES = S.LENGTH * len(S.ALPHABET)
ALPHAS = [10.0**k for k in range(-4, 6)]
SMALL = 512  # rows of a component whose fits are downdates
HELD = 32  # moments that a task holds before it gives them on
ALL = 0  # the outer fold that no row is in: its fits are over all rows


def encode(sequences: list[str]) -> np.ndarray:
    """One-hot rows: position * 21 + place in the alphabet; an unknown symbol is an error."""
    place = np.full(128, -1)
    place[np.frombuffer(S.ALPHABET.encode(), np.uint8)] = np.arange(len(S.ALPHABET))
    codes = place[np.frombuffer("".join(sequences).encode("ascii"), np.uint8).reshape(-1, S.LENGTH)]
    if (codes < 0).any():
        raise ValueError("a symbol is not in the alphabet")
    out = np.zeros((len(sequences), FEATURES))
    out[np.arange(len(sequences))[:, None], np.arange(S.LENGTH) * len(S.ALPHABET) + codes] = 1
    return out


def fit_rows(x: np.ndarray, y: np.ndarray, w: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights, intercepts) minimising sum w |y - xb - c|^2 + alpha |b|^2, the intercept free; by the dual system."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    mx, my = w @ x / w.sum(), w @ y / w.sum()
    root = np.sqrt(w)[:, None]
    z, t = (x - mx) * root, (y - my) * root
    b = z.T @ np.linalg.solve(z @ z.T + alpha * np.eye(len(z)), t)
    return b, my - mx @ b


class Moments:
    """n, sum x, sum y, x'x, x'y and y'y of rows; they add."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.parts = [np.array([float(len(x))]), x.sum(0), y.sum(0), x.T @ x, x.T @ y]

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> Moments:
        out = cls.__new__(cls)
        out.parts = parts
        return out

    def __add__(self, other: Moments) -> Moments:
        return Moments.of([a + b for a, b in zip(self.parts, other.parts, strict=True)])

    def bytes(self) -> bytes:
        return b"".join(p.tobytes() for p in self.parts)

    @classmethod
    def read(cls, raw: bytes, targets: int = 2) -> Moments:
        f, flat, out, at = FEATURES, np.frombuffer(raw), [], 0
        for shape in ((1,), (f,), (targets,), (f, f), (f, targets)):
            size = int(np.prod(shape))
            out.append(flat[at : at + size].reshape(shape))
            at += size
        return cls.of(out)


def balanced(moments: list[Moments]) -> tuple[Moments, float]:
    """Moments in which every component weighs the same, as weights with a mean of 1 over rows."""
    rows = sum(m.parts[0][0] for m in moments)
    total = None
    for m in moments:
        part = Moments.of([p * (rows / len(moments) / m.parts[0][0]) for p in m.parts])
        total = part if total is None else total + part
    return total, rows


def solve(m: Moments, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """As fit_rows, from weighted moments, by the primal system."""
    n, sx, sy, xx, xy = m.parts
    mx, my = sx / n, sy / n
    b = np.linalg.solve(xx - np.outer(sx, mx) + alpha * np.eye(len(sx)), xy - np.outer(sx, my))
    return b, my - mx @ b


def solve_all(m: Moments, alphas: list[float]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """(alpha, weights, intercepts) of solve() for each alpha, from one decomposition."""
    n, sx, sy, xx, xy = m.parts
    mx, my = sx / n, sy / n
    values, vectors = np.linalg.eigh(xx - np.outer(sx, mx))
    right = vectors.T @ (xy - np.outer(sx, my))
    for alpha in alphas:
        b = vectors @ (right / (np.maximum(values, 0) + alpha)[:, None])
        yield alpha, b, my - mx @ b


def component_moments(rows: DataFrame, component: str, x: str = "aligned", y: tuple[str, str] = ("y1", "y2"), fold: str = "fold") -> DataFrame:
    """(component, fold, moments): summed in each task, then by component and fold."""

    def make(batches):
        held: dict[tuple, Moments] = {}

        def out():
            for (c, f), m in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.string()), pa.array([f], pa.int32()), pa.array([m.bytes()], pa.binary())], ["component", "fold", "moments"])
            held.clear()

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            features = encode(batch.column(2).to_pylist())
            targets = np.stack([batch.column(k).to_numpy() for k in (3, 4)], 1)
            for key in sorted(set(keys), key=str):
                here = np.array([k == key for k in keys])
                m = Moments(features[here], targets[here])
                held[key] = held[key] + m if key in held else m
                if len(held) > HELD:
                    yield from out()
        yield from out()

    # rows of a component come together first, in parts, so that few sums of it are made
    dealt = rows.select(F.col(component).cast("string").alias("component"), F.col(fold).cast("int").alias("fold"), x, *y)
    return dealt.mapInArrow(make, MOMENTS).groupBy("component", "fold").applyInArrow(_added(["component", "fold"]), MOMENTS)


MOMENTS = "component string, fold int, moments binary"


def _sum(blobs) -> Moments:
    total = None
    for raw in blobs:
        m = Moments.read(raw.as_py())
        total = m if total is None else total + m
    return total


def _added(keys: list[str]):
    def add(part: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([*(part[k][:1] for k in keys), pa.array([_sum(part["moments"]).bytes()], pa.binary())], [*keys, "moments"])

    return add


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[str | None, np.ndarray, np.ndarray, np.ndarray]]:
    """Component, folds, one-hot rows and targets of each row of `small`."""
    for component, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        own = rows.values
        yield component, own.field("fold").to_numpy(zero_copy_only=False), encode(own.field("aligned").to_pylist()), np.stack([own.field(c).to_numpy(zero_copy_only=False) for c in ("y1", "y2")], 1)


class Whole:
    """The sum of all components' normalised moments, decomposed."""

    def __init__(self, m: Moments, rows: float, components: int):
        _, sx, sy, xx, xy = m.parts
        self.rows, self.components, self.mx, self.my = rows, components, sx / components, sy / components
        values, self.vectors = np.linalg.eigh(xx - np.outer(sx, self.mx))
        self.values = np.maximum(values, 0)
        self.right = self.vectors.T @ (xy - np.outer(sx, self.my))

    def without(self, x: np.ndarray, y: np.ndarray, alphas: list[float]) -> list[float]:
        """For each alpha the sum of absolute errors of a component's rows by the fit without it; none if it is the only one."""
        k, n = self.components, len(x)
        if k < 2:
            return []
        mx, my, root = x.mean(0), y.mean(0), (k / (k - 1)) ** 0.5
        u = np.vstack([(x - mx) / n**0.5, root * (mx - self.mx)]) @ self.vectors
        t = np.vstack([(y - my) / n**0.5, root * (my - self.my)])
        right = self.right - u.T @ t
        mean_x, mean_y = (k * self.mx - mx) / (k - 1), (k * self.my - my) / (k - 1)
        seen, scale, out = (x - mean_x) @ self.vectors, (self.rows - n) / (k - 1), []
        for alpha in alphas:
            d = 1 / (self.values + alpha / scale)
            ud = u * d
            q = d[:, None] * right
            q = q + ud.T @ np.linalg.solve(np.eye(len(u)) - ud @ u.T, u @ q)
            out.append(float(np.abs(seen @ q + mean_y - y).sum()))
        return out


class Fits:
    """Fits with and without components, for each outer fold and for all rows (fold ALL)."""

    def __init__(self, rows: DataFrame, component: str, alphas: list[float] = ALPHAS, x: str = "aligned", y: tuple[str, str] = ("y1", "y2"), fold: str = "fold", outer: bool = True):
        self.rows = cut(rows.select(F.col(component).cast("string").alias("component"), F.col(fold).cast("int").alias("fold"), F.col(x).alias("aligned"), F.col(y[0]).alias("y1"), F.col(y[1]).alias("y2")).filter("fold is not null"))
        self.alphas = sorted(alphas)
        assert self.alphas and self.alphas[0] > 0, "alphas must be positive"
        self.folds = folds = [ALL, *sorted(r.fold for r in self.rows.select("fold").distinct().collect())] if outer else [ALL]
        sizes = self.rows.groupBy(F.col("component").alias("__c")).agg(F.count("*").alias("__n"))
        large = cut(sizes.filter(F.col("__n") > SMALL).select("__c"))
        self.has_large = large.limit(1).count() > 0
        same = F.col("component").eqNullSafe(F.col("__c"))
        self.large_rows = self.rows.join(large, same, "left_semi")
        few = self.rows.join(large, same, "left_anti") if self.has_large else self.rows
        #: rows of each small component, together
        self.small = cut(few.groupBy("component").agg(F.collect_list(F.struct("fold", "aligned", "y1", "y2")).alias("rows")))  # at most SMALL each
        moments = component_moments(self.large_rows, "component")
        held = moments.withColumn("held", F.explode(F.array(*map(F.lit, folds)))).filter("held <> fold")
        keys = ["held", "component"]
        #: moments of each large component without the held fold
        self.moments = cut(held.groupBy(*keys).applyInArrow(_added(keys), "held int, component string, moments binary"))

        def small_sums(batches):
            sums: dict[int, tuple[Moments, float, int]] = {}
            for batch in batches:
                for _, fold, x, y in _unpacked(batch):
                    for f in folds:
                        own = fold != f
                        n = int(own.sum())
                        if n:
                            m = Moments.of([p / n for p in Moments(x[own], y[own]).parts])
                            t, rows_, count = sums.get(f, (None, 0.0, 0))
                            sums[f] = m if t is None else t + m, rows_ + n, count + 1
            for f, (m, n, count) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([float(n)]), pa.array([count], pa.int64()), pa.array([m.bytes()], pa.binary())], ["held", "n", "components", "moments"])

        def normalised(batches):
            sums: dict[int, tuple[Moments, float, int]] = {}
            for batch in batches:
                for f, raw in zip(batch["held"].to_pylist(), batch["moments"], strict=True):
                    m = Moments.read(raw.as_py())
                    n = m.parts[0][0]
                    m = Moments.of([p / n for p in m.parts])
                    t, rows_, count = sums.get(f, (None, 0.0, 0))
                    sums[f] = m if t is None else t + m, rows_ + n, count + 1
            for f, (m, n, count) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([n]), pa.array([count], pa.int64()), pa.array([m.bytes()], pa.binary())], ["held", "n", "components", "moments"])

        def total(part: pa.Table) -> pa.Table:
            return pa.Table.from_arrays([part["held"][:1], pa.array([sum(part["n"].to_pylist())]), pa.array([sum(part["components"].to_pylist())], pa.int64()), pa.array([_sum(part["moments"]).bytes()], pa.binary())], ["held", "n", "components", "moments"])

        schema = "held int, n double, components long, moments binary"
        parts = self.small.mapInArrow(small_sums, schema)
        if self.has_large:
            parts = parts.unionByName(self.moments.select("held", "moments").mapInArrow(normalised, schema))
        salted = parts.withColumn("salt", F.spark_partition_id() % 16).groupBy("held", "salt").applyInArrow(total, schema)
        #: one row for each outer fold: the sum of normalised moments, rows and components
        self.totals = cut(salted.groupBy("held").applyInArrow(total, schema))

    def scores(self) -> DataFrame:
        """held, alpha, components and score: the mean absolute error over rows and targets of a left-out component, averaged over components."""
        found = self._downdated()
        if self.has_large:
            found = found.unionByName(self._refitted())
        each = found.groupBy("held", "component", "alpha").agg((F.sum("s") / F.sum("n")).alias("e"))
        return each.groupBy("held", "alpha").agg(F.count("*").alias("components"), F.avg("e").alias("score"))

    def _downdated(self) -> DataFrame:
        """held, component, alpha, and sums and counts of the left-out errors of small components."""
        alphas, folds = self.alphas, self.folds
        wholes = {r.held: Whole(Moments.read(bytes(r.moments)), r.n, r.components) for r in self.totals.collect()}  # a row for each outer fold
        shared = self.rows.sparkSession.sparkContext.broadcast(wholes)

        def fit(batches):
            for batch in batches:
                out = [(f, c, a, s, 2 * int((fold != f).sum())) for c, fold, x, y in _unpacked(batch) for f in folds if f in shared.value and (fold != f).any() for a, s in zip(alphas, shared.value[f].without(x[fold != f], y[fold != f], alphas), strict=False)]
                columns = list(zip(*out, strict=True)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.int64()), strict=True)], ["held", "component", "alpha", "s", "n"])

        return self.small.mapInArrow(fit, "held int, component string, alpha double, s double, n long")

    def _refitted(self) -> DataFrame:
        """The same of large components."""
        alphas = self.alphas

        def fit(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    own, whole = (Moments.read(batch[c][row].as_py()) for c in ("moments", "total"))
                    n, left = own.parts[0][0], batch["components"][row].as_py() - 1
                    if not left:
                        continue
                    by = (batch["n"][row].as_py() - n) / left
                    rest = Moments.of([(a - b / n) * by for a, b in zip(whole.parts, own.parts, strict=True)])
                    made = list(solve_all(rest, alphas))
                    k = len(made)
                    yield pa.RecordBatch.from_arrays([pa.array([batch["held"][row].as_py()] * k, pa.int32()), pa.array([batch["component"][row].as_py()] * k, pa.string()), pa.array([a for a, *_ in made]), pa.array([b.ravel() for _, b, _ in made], pa.list_(pa.float64())), pa.array([c for *_, c in made], pa.list_(pa.float64()))], ["of", "component", "alpha", "w", "c"])

        # one row for each outer fold is broadcast, of 3 MB
        total = self.totals.select(F.col("held").alias("h"), "n", "components", F.col("moments").alias("total"))
        weights = cut(self.moments.join(F.broadcast(total), F.col("held") == F.col("h")).mapInArrow(fit, "of int, component string, alpha double, w array<double>, c array<double>"))

        def measure(batches):
            for batch in batches:
                sums, counts = [], []
                for k in range(batch.num_rows):
                    x = batch["rows"][k].values
                    y = np.stack([x.field(c).to_numpy(zero_copy_only=False) for c in ("y1", "y2")], 1)
                    b, c = batch["w"][k].values.to_numpy().reshape(-1, 2), batch["c"][k].values.to_numpy()
                    sums.append(float(np.abs(encode(x.field("aligned").to_pylist()) @ b + c - y).sum()))
                    counts.append(y.size)
                yield pa.RecordBatch.from_arrays([batch["of"], batch["component"], batch["alpha"], pa.array(sums), pa.array(counts, pa.int64())], ["held", "component", "alpha", "s", "n"])

        # rows go to their component's weights in blocks, so that no component is one task
        groups = max(1, -(-self.large_rows.count() // 1024))
        dealt = self.large_rows.withColumn("g", F.pmod(F.xxhash64("aligned", "y1", "y2"), F.lit(groups))).groupBy("component", "fold", "g").agg(F.collect_list(F.struct("aligned", "y1", "y2")).alias("rows"))
        return dealt.join(weights, "component").filter("of <> fold").select("of", "component", "alpha", "rows", "w", "c").mapInArrow(measure, "held int, component string, alpha double, s double, n long")

    def selected(self) -> DataFrame:
        """held, alpha and score: the alpha with the least score, the smaller one on ties."""
        return self.scores().groupBy("held").agg(F.min(F.struct("score", "alpha")).alias("m")).select("held", "m.alpha", "m.score")

    def models(self, alphas: DataFrame) -> DataFrame:
        """held, alpha, w1, w2, c1, c2, mx and my (weighted means): fits over all components, one for each row (held, alpha)."""

        def fit(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    by = batch["n"][row].as_py() / batch["components"][row].as_py()
                    m = Moments.of([p * by for p in Moments.read(batch["moments"][row].as_py()).parts])
                    b, c = solve(m, batch["alpha"][row].as_py())
                    yield pa.RecordBatch.from_arrays([batch["held"].slice(row, 1), batch["alpha"].slice(row, 1), *(pa.array([b[:, k].tolist()], pa.list_(pa.float64())) for k in (0, 1)), *(pa.array([float(c[k])]) for k in (0, 1)), *(pa.array([(p / m.parts[0][0]).tolist()], pa.list_(pa.float64())) for p in m.parts[1:3])], ["held", "alpha", "w1", "w2", "c1", "c2", "mx", "my"])

        return self.totals.join(F.broadcast(alphas.select("held", "alpha")), "held").select("held", "n", "components", "moments", "alpha").mapInArrow(fit, "held int, alpha double, w1 array<double>, w2 array<double>, c1 double, c2 double, mx array<double>, my array<double>")


def predicted(rows: DataFrame, models: DataFrame, on) -> DataFrame:
    """rows joined with their model (few rows), with gcgr and glp1r of it."""
    joined = rows.join(F.broadcast(models), on)
    hot = S.one_hot(F.col("aligned"))
    guess = lambda k: F.col(f"c{k}") + F.aggregate(hot, F.lit(0.0), lambda acc, f: acc + F.element_at(f"w{k}", (f + 1).cast("int")))
    return joined.withColumns({"gcgr": guess(1), "glp1r": guess(2)}).drop("w1", "w2", "c1", "c2", "mx", "my", "held")


def leave_one_component_out(rows: list[tuple[str, np.ndarray, np.ndarray]], alphas: list[float] = ALPHAS) -> tuple[float, dict[float, float]]:
    """The alpha with the least mean over components of the held-out mean absolute error; the smaller one on ties."""
    scores = {}
    for alpha in alphas:
        errors = []
        for k in range(len(rows)):
            rest = [Moments(x, y) for j, (_, x, y) in enumerate(rows) if j != k]
            b, c = solve(balanced(rest)[0], alpha)
            errors.append(float(np.abs(rows[k][1] @ b + c - rows[k][2]).mean()))
        scores[alpha] = float(np.mean(errors))
    return min(scores, key=lambda a: (scores[a], a)), scores
