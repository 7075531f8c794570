"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic by their tokens. The cells' shares are
raked to the three target marginals in turn. Targets are given for the values named; what they leave of 1 is
shared by the other values as their tokens tempered by an exponent. A document's inclusion probability
is that of its cell, min(1, a * b * c) with a multiplier for each value of each dimension, and the drawn
tokens have the target marginals whatever the corpus has: a step sets one dimension's multipliers
so that its values get their parts of the budget, cells at 1 included. The largest budget for which
that holds is searched in two rounds of 16 that run side by side. If it is less than asked for,
there is a warning. If no probabilities have the marginals within `tolerance` (a value's cells may be
empty), it is an error that names the worst value, or a warning if not `strict`: then the shares are raked
as far as they go. `report` lists targets and drawn shares. Whether a document is
taken depends on its id alone (an md5 draw), so a run again takes the same ones.

The law is one at any size. Only sums by value are needed for a step: up to `bound` cells are summed
in the driver's memory, more by Spark jobs over the cells; the multipliers, one for each value, are the
driver's in both.

Null source, language or topic is a value of its own (empty text); null text is empty and has its end
token alone. Repeated rows of an id are drawn alike. An empty table gives an empty one. Only the named
columns are read; all others stay with the row in sample(), whatever their names.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm import common as C

DIMS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """A rule of thumb over whole texts."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.contains(F.lower(t), F.lit("licen")), "legal").when(F.contains(t, F.lit("@")), "contact").when(F.contains(t, F.lit("|")), "table").otherwise("prose")


def tokens_of(text: Column) -> Column:
    """Words and one end."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def draw(doc_id: Column, seed: str = "mix") -> Column:
    """Uniform on 0 to 1 from the id."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def goals_of(values: np.ndarray, totals: np.ndarray, exponent: float, named: dict[str, float]) -> np.ndarray:
    """Target shares of a dimension's values."""
    own = np.array([named.get(v, 0.0) for v in values], float)
    rest = np.array([v not in named for v in values])
    if rest.any():
        own[rest] = max(1 - sum(named.values()), 0.0) * tempered(np.where(rest, totals, 0.0), exponent)[rest]
    return own / own.sum() if own.sum() else tempered(totals, exponent)


def tempered(totals: np.ndarray, exponent: float) -> np.ndarray:
    x = np.power(totals, exponent)
    return x / x.sum()


#: Budgets that are tried at once, in each of two rounds.
BUDGETS = 16


class Cells:
    """Tokens of cells and their values' numbers in each dimension, in memory."""

    def __init__(self, codes: list[np.ndarray], tokens: np.ndarray, widths: list[int]):
        self.codes, self.tokens, self.widths = codes, tokens, widths

    def sums(self, d: int, multipliers: list[np.ndarray], bounded: bool) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of cells that are whole, and tokens * product of the others, by budget and value of dimension d."""
        return cell_sums(self.codes, self.tokens, d, multipliers, bounded, self.widths[d])


def cell_sums(codes: list[np.ndarray], tokens: np.ndarray, d: int, multipliers: list[np.ndarray], bounded: bool, width: int) -> tuple[np.ndarray, np.ndarray]:
    whole, part = np.zeros((2, len(multipliers[0]), width))
    for k in range(len(whole)):
        m = multipliers[0][k][codes[0]]
        for x, code in zip(multipliers[1:], codes[1:], strict=True):
            m = m * x[k][code]
        full = m >= 1 if bounded else np.zeros(len(m), bool)
        whole[k] = np.bincount(codes[d], tokens * full, width)
        part[k] = np.bincount(codes[d], tokens * np.where(full, 0.0, m), width)
    return whole, part


class SparkCells:
    """The same sums as jobs over a table of cells (code_0, code_1, code_2, t)."""

    def __init__(self, cells: DataFrame, widths: list[int]):
        self.cells, self.widths = cells, widths
        self.folder, self.step = C.SharedFolder.create(cells.sparkSession, "mixture"), 0

    def sums(self, d: int, multipliers: list[np.ndarray], bounded: bool) -> tuple[np.ndarray, np.ndarray]:
        folder, n, step = self.folder.uri, len(multipliers[0]), self.step
        for k, x in enumerate(multipliers):
            self.folder.write(f"{step}-by-{k}", x)
        self.step += 1

        def add(batches):
            held, found = None, {}
            for batch in batches:
                if held is None:
                    held = [C.SharedFolder(folder).map(f"{step}-by-{k}").view(float).reshape(n, -1) for k in range(len(DIMS))]
                codes = [batch.column(k).to_numpy() for k in range(len(DIMS))]
                values, own = np.unique(codes[d], return_inverse=True)
                local = [own if k == d else codes[k] for k in range(len(DIMS))]
                whole, part = cell_sums(local, batch.column(3).to_numpy(), d, [x[:, values] if k == d else x for k, x in enumerate(held)], bounded, len(values))
                for v, w, p in zip(values.tolist(), whole.T, part.T, strict=True):
                    found[v] = found.get(v, 0) + np.concatenate([w, p])
                if len(found) > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.float64()))], ["v", "s"])
                    found = {}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.float64()))], ["v", "s"])

        parts = self.cells.select(*(f"code_{k}" for k in range(len(DIMS))), "t").mapInArrow(add, "v long, s array<double>")
        by_value = parts.groupBy("v").agg(*(F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(2 * n)))
        whole, part = np.zeros((2, n, self.widths[d]))
        for r in by_value.collect():  # a row for each value of the dimension
            whole[:, r.v], part[:, r.v] = r[1 : n + 1], r[n + 1 :]
        return whole, part


def rake(cells: Cells | SparkCells, goals: list[np.ndarray], budgets: np.ndarray, rounds: int, bounded: bool = True) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Multipliers, a row for each budget; how far the worst value is from its goal; and the drawn tokens of each dimension's values.

    A step solves whole + s * part = goal * budget for every value of a dimension: with the cells that are whole now
    fixed, which the next steps set right, as products only grow where they were too small.
    """
    now = [np.ones((len(budgets), len(g))) for g in goals]
    now[0] *= (budgets / sum(cells.sums(0, now, False)[1][0]))[:, None]
    for _ in range(rounds):
        for d, goal in enumerate(goals):
            whole, part = cells.sums(d, now, bounded)
            want = goal[None, :] * budgets[:, None]
            # a value whose whole cells are too much already has them made smaller by half its excess
            by = np.where(part > 0, (want - whole) / np.where(part > 0, part, 1), np.where(whole > 0, want / np.where(whole > 0, whole, 1), 0.0))
            now[d] = now[d] * np.where(by > 0, by, np.where(want > 0, np.clip(want / np.where(whole + part > 0, whole + part, 1), 0.25, 1), 0.0))
    drawn = [sum(cells.sums(d, now, bounded)) for d in range(len(goals))]
    error = np.max([np.abs(x / budgets[:, None] - g[None, :]).max(1) for x, g in zip(drawn, goals, strict=True)], axis=0)
    return now, error, drawn


def calibrated_multipliers(cells: Cells | SparkCells, goals: list[np.ndarray], totals: list[np.ndarray], keep: float, rounds: int) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """Multipliers and drawn tokens of the largest budget whose marginals are met, and that budget's part of all tokens.

    No budget is above what a value's own tokens allow. Met means as near as raking without a bound gets (a value's
    cells may be empty): a budget that is next to nothing shows how near that is.
    """
    total = totals[0].sum()
    high = min([keep * total, *((t[g > 0] / g[g > 0]).min() * (1 - 1e-9) for t, g in zip(totals, goals, strict=True))])
    low, best, floor = 0.0, None, None
    for _ in range(6):  # a sixteenth of the last range each time
        budgets = np.concatenate(([1e-12 * total], low + (high - low) * np.arange(1, BUDGETS + 1) / BUDGETS))  # in the first one no cell is whole
        now, error, drawn = rake(cells, goals, budgets, rounds)
        floor = error[0] if floor is None else floor
        met = np.flatnonzero(error[1:] < floor + 1e-5) + 1
        if not len(met):
            high = budgets[1] if best is None else high
            if best is None:
                continue
            break
        k, refined = met[-1], best is not None
        best = [x[k] for x in now], [x[k] for x in drawn], budgets[k] / total
        if refined or k == BUDGETS:
            break
        low, high = budgets[k], budgets[k + 1]
    if best is None:
        best = [x[1] for x in now], [x[1] for x in drawn], budgets[1] / total
    return best


def _check(report: list[tuple[str, str, float, float]], drawn: float, keep: float, tolerance: float, strict: bool) -> None:
    d, value, goal, have = max(report, key=lambda r: abs(r[3] - r[2]))
    if not abs(have - goal) <= tolerance:
        said = f"no probabilities have the target marginals: {d} {value!r} has {have:.4f} of the drawn tokens, its target is {goal:.4f}"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=3)
    if drawn < keep * (1 - 1e-3):
        warnings.warn(f"the targets allow {drawn:.4f} of the tokens, not {keep}", stacklevel=3)


class Mixture:
    """The calibrated probability of each cell, as a table (cell_source, cell_lang, cell_topic, prob)."""

    def __init__(self, cells: DataFrame, small: bool, report: list[tuple[str, str, float, float]]):
        self.cells, self.small, self.report = cells, small, report  # report: dimension, value, target and drawn share

    @classmethod
    def calibrate(cls, keyed: DataFrame, exponent: float = 0.7, keep: float = 0.8, rounds: int = 60, targets: dict[str, dict[str, float]] | None = None, bound: int = 500_000, tolerance: float = 0.01, strict: bool = True) -> Mixture:
        """keyed: __source, __lang, __topic, __tokens. targets: shares of a dimension's values; keep is the most that is drawn of all tokens."""
        spark, targets, names = keyed.sparkSession, targets or {}, [f"cell_{d}" for d in DIMS]
        cells = C.cut(keyed.groupBy(*(F.col(f"__{d}").alias(c) for d, c in zip(DIMS, names, strict=True))).agg(F.sum("__tokens").cast("double").alias("t")))
        n = cells.count()
        if not n:
            return cls(spark.createDataFrame([], ", ".join(f"{c} string" for c in names) + ", prob double"), True, [])
        values, totals, goals = [], [], []
        for d, c in zip(DIMS, names, strict=True):
            rows = sorted((r[c], r.t) for r in cells.groupBy(c).agg(F.sum("t").alias("t")).collect())  # a row for each value
            values.append([v for v, _ in rows])
            totals.append(np.array([t for _, t in rows]))
            goals.append(goals_of(np.array(values[-1], object), totals[-1], exponent, targets.get(d, {})))
        widths = list(map(len, values))
        if n <= bound:
            rows = cells.collect()  # at most `bound`
            at = [{v: k for k, v in enumerate(x)} for x in values]
            codes = [np.array([at[d][r[c]] for r in rows]) for d, c in enumerate(names)]
            held = Cells(codes, np.array([r.t for r in rows]), widths)
        else:
            coded = cells
            for d, c in enumerate(names):
                lookup = spark.createDataFrame(list(enumerate(values[d])), f"code_{d} long, value_{d} string")
                coded = coded.join(lookup, F.col(c) == F.col(f"value_{d}")).drop(f"value_{d}")
            coded = C.cut(coded)
            held = SparkCells(coded, widths)
        by, drawn, part = calibrated_multipliers(held, goals, totals, keep, rounds)
        report = [(d, v, float(g), float(x / max(have.sum(), 1e-300))) for d, own, goal, have in zip(DIMS, values, goals, drawn, strict=True) for v, g, x in zip(own, goal, have, strict=True)]
        _check(report, float(part), keep, tolerance, strict)
        kind = ", ".join(f"{c} string" for c in names) + ", prob double"
        if n <= bound:
            prob = np.minimum(1, by[0][codes[0]] * by[1][codes[1]] * by[2][codes[2]])
            return cls(spark.createDataFrame([(*(r[c] for c in names), float(p)) for r, p in zip(rows, prob, strict=True)], kind), True, report)
        for d, x in enumerate(by):
            factors = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], f"of_{d} long, by_{d} double")
            coded = coded.join(factors, F.col(f"code_{d}") == F.col(f"of_{d}"))
        found = C.cut(coded.select(*names, F.least(F.lit(1.0), F.col("by_0") * F.col("by_1") * F.col("by_2")).alias("prob")))
        held.folder.drop()
        return cls(found, False, report)

    def join(self, keyed: DataFrame) -> DataFrame:
        cells = F.broadcast(self.cells) if self.small else self.cells
        on = [F.col(f"__{d}") == F.col(f"cell_{d}") for d in DIMS]
        return keyed.join(cells, on).drop(*(f"cell_{d}" for d in DIMS))


def keyed(docs: DataFrame, source: str = "source", lang: str = "lang", text: str = "text", topic: Column | None = None) -> DataFrame:
    """`row`, a struct of all columns of docs, with the cell and the tokens of each row."""
    t = F.col(text).cast("string")
    at = {"source": F.col(source), "lang": F.col(lang), "topic": topic_of(t) if topic is None else topic}
    return docs.select(C.as_struct(docs, "row"), *(F.coalesce(c.cast("string"), F.lit("")).alias(f"__{d}") for d, c in at.items()), tokens_of(t).alias("__tokens"))


def calibrated(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, lang, topic, tokens, prob and sampled of every row."""
    rows = C.cut(keyed(docs.select("doc_id", "source", "lang", "text")).select(F.col("row.doc_id").cast("long").alias("doc_id"), *(f"__{d}" for d in DIMS), "__tokens"))
    found = Mixture.calibrate(rows, **how).join(rows)
    return found.select("doc_id", *(F.col(f"__{d}").alias(d) for d in DIMS), F.col("__tokens").alias("tokens"), "prob", (draw(F.col("doc_id")) < F.col("prob")).alias("sampled"))


def sample(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that are drawn, with all their columns; the drawn tokens have the target marginals."""
    rows = keyed(docs)
    mixture = Mixture.calibrate(rows, **how)
    return C.from_struct(mixture.join(rows).filter(draw(F.col("row.doc_id")) < F.col("prob")), "row", docs)
