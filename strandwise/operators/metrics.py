"""Point metrics, weights and grouped errors over long tables of predictions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.operators.graph import cut
from strandwise.operators.selection import grouped_ranks


def pearson(a: str, b: str) -> Column:
    """Correlation; null for fewer than two rows or a constant."""
    flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return F.when(~flat, F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def point_metrics(rows: DataFrame, by: list[str], actual: str = "actual", guess: str = "guess") -> DataFrame:
    """n, mae, rmse, geometric fold error and r2 of each group; r2 is null where all actual values are equal."""
    e = F.col(guess) - F.col(actual)
    sst = F.sum(F.col(actual) * F.col(actual)) - F.sum(actual) * F.sum(actual) / F.count("*")
    flat = F.min(actual) == F.max(actual)
    return rows.filter(F.col(actual).isNotNull() & F.col(guess).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.pow(F.lit(10.0), F.avg(F.abs(e))).alias("fold_error"),
        F.when(~flat, 1 - F.sum(e * e) / F.nullif(sst, F.lit(0.0))).alias("r2"),
        pearson(actual, guess).alias("pearson"),
    )


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """rows with the average rank of value within its group: ranks come from counts of distinct values over range partitions."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("__n"))
    ranks = grouped_ranks(counts, by, value, "__n", name).select(*(F.col(b).alias(f"__{b}") for b in by), F.col(value).alias("__v"), name)
    on = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by] + [F.col(value).eqNullSafe(F.col("__v"))]
    return rows.join(ranks, on).drop("__v", *(f"__{b}" for b in by))


def spearman(rows: DataFrame, by: list[str], actual: str = "actual", guess: str = "guess") -> DataFrame:
    """Correlation of average ranks; null for fewer than two rows or a constant. Rows are counted by pairs of values first, so copies are cheap."""
    pairs = cut(rows.filter(F.col(actual).isNotNull() & F.col(guess).isNotNull()).groupBy(*by, F.col(actual).alias("__a"), F.col(guess).alias("__g")).agg(F.count("*").alias("__n")))
    ranked = pairs
    for value, name in (("__a", "ra"), ("__g", "rg")):
        counts = pairs.groupBy(*by, value).agg(F.sum("__n").alias("__m"))
        ranks = grouped_ranks(counts, by, value, "__m", name).select(*(F.col(b).alias(f"__{b}") for b in by), F.col(value).alias("__v"), name)
        on = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by] + [F.col(value) == F.col("__v")]
        ranked = ranked.join(ranks, on).drop("__v", *(f"__{b}" for b in by))
    n, mean = F.sum("__n"), lambda x: F.sum(F.col("__n") * x) / F.sum("__n")
    flat = (F.min("ra") == F.max("ra")) | (F.min("rg") == F.max("rg"))
    moments = ranked.groupBy(*by).agg(n.alias("n"), flat.alias("flat"), mean(F.col("ra")).alias("a"), mean(F.col("rg")).alias("g"), mean(F.col("ra") * F.col("ra")).alias("aa"), mean(F.col("rg") * F.col("rg")).alias("gg"), mean(F.col("ra") * F.col("rg")).alias("ag"))
    spread = F.sqrt((F.col("aa") - F.col("a") * F.col("a")) * (F.col("gg") - F.col("g") * F.col("g")))
    return moments.select(*by, F.when(~F.col("flat"), (F.col("ag") - F.col("a") * F.col("g")) / F.nullif(spread, F.lit(0.0))).alias("spearman"))


def component_weights(rows: DataFrame, component: str) -> DataFrame:
    """component, rows_in, weight: 1 / rows of the component, scaled to a mean of 1 over rows."""
    n = rows.groupBy(component).agg(F.count("*").alias("rows_in"))
    total = n.agg(F.sum("rows_in").alias("all_rows"), F.count("*").alias("all_components"))
    return n.join(F.broadcast(total)).select(component, "rows_in", (F.col("all_rows") / F.col("all_components") / F.col("rows_in")).alias("weight"))  # one row on the right


def balanced_mean(rows: DataFrame, component: str, values: list[str]) -> DataFrame:
    """Means in which every component weighs the same."""
    inner = rows.groupBy(component).agg(*(F.avg(v).alias(v) for v in values))
    return inner.agg(*(F.avg(v).alias(v) for v in values))


def macro_mae(rows: DataFrame, by: list[str], component: str, error: Column) -> DataFrame:
    """Mean over components of the components' mean absolute errors."""
    inner = rows.groupBy(*by, component).agg(F.avg(F.abs(error)).alias("m"))
    return inner.groupBy(*by).agg(F.count("*").alias("components"), F.avg("m").alias("macro_mae"))


def leave_one_out(rows: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """For each group the mean of all other groups' rows, by subtraction from the totals; null where there are none."""
    own = rows.groupBy(*by, group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    w = Window.partitionBy(*by)
    left = F.sum("n").over(w) - F.col("n")
    return own.select(*by, group, "n", F.when(left > 0, (F.sum("s").over(w) - F.col("s")) / left).alias("others_mean"))


def drawn_means(sums: np.ndarray, sizes: np.ndarray, resamples: int, seed: int, at_once: int = 1 << 22) -> np.ndarray:
    """Pooled means of resampled groups: as many draws of groups as there are, `resamples` times, from one seeded generator."""
    k, rng, out = len(sums), np.random.default_rng(seed), []
    step = max(1, at_once // k)
    for a in range(0, resamples, step):
        x = rng.integers(0, k, size=(min(step, resamples - a), k))
        out.append(sums[x].sum(axis=1) / sizes[x].sum(axis=1))
    return np.concatenate(out)


def drawn_strata(strata: list[np.ndarray], resamples: int, seed: int) -> np.ndarray:
    """Means of rows resampled within each stratum, as many as it has; strata in their order for each resample."""
    rng, n = np.random.default_rng(seed), sum(map(len, strata))
    return np.array([sum(float(x[rng.integers(0, len(x), size=len(x))].sum()) for x in strata) / n for _ in range(resamples)])


def seeded_bootstrap(rows: DataFrame, by: list[str], group: str, value: str, resamples: int = 10_000, seed: int = 20260820, level: float = 0.95) -> DataFrame:
    """by, groups, mean_delta, low and high: percentile intervals of the mean of value, resampling whole groups.

    Rows are summed by group first; what a task of `by` has is a sum and a size for each group.
    """
    own = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(group).cast("string").alias("__g")).agg(F.sum(value).alias("__s"), F.count("*").alias("__n"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.select(*by).schema.fields)

    def draw(part: pa.Table) -> pa.Table:
        order = np.argsort(np.array(part["__g"].to_pylist(), object))
        sums, sizes = part["__s"].to_numpy()[order], part["__n"].to_numpy()[order]
        low, high = np.quantile(drawn_means(sums, sizes, resamples, seed), [(1 - level) / 2, (1 + level) / 2])
        return pa.Table.from_arrays([*(part[b][:1] for b in by), pa.array([len(sums)], pa.int64()), pa.array([float(sums.sum() / sizes.sum())]), pa.array([float(low)]), pa.array([float(high)])], [*by, "groups", "mean_delta", "low", "high"])

    return own.groupBy(*by).applyInArrow(draw, f"{kind}, groups long, mean_delta double, low double, high double")
