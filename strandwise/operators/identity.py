"""Sequence identity joins: thresholded by lossless seeds, nearest by seeds at falling thresholds and products for the rest.

Both work on distinct sequences; copies ride along as counts, so a sequence that a third of all rows
share costs as much as any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions import sequences as S
from strandwise.operators import blocks as B
from strandwise.operators import seeds as P
from strandwise.operators.graph import cut


def classes(panel: DataFrame) -> DataFrame:
    """aligned, rep (smallest id) and n of each distinct sequence but the all-gap one."""
    return panel.filter(F.col("aligned") != S.ALL_GAP).groupBy("aligned").agg(F.min("peptide_id").alias("rep"), F.count("*").alias("n"))


#: A pair of two blocks, beside a pair that meets by a seed, and what seeds cost in such pairs whatever they find.
PRODUCT_COST, LEVEL_COST = 0.001, 4e6


def edges(distinct: DataFrame, threshold: float, level_cost: float = LEVEL_COST) -> DataFrame:
    """(a, b, identity) of distinct sequences with identity >= threshold, a < b.

    Blocks meet all of each other unless seeds cost under a fourth of that. Otherwise rows meet where they hold the same letters at one of the seeds' sets
    of columns, common keys in cells, and each pair is verified; pairs that meet at several sets are made one after that. What the seeds'
    pairs would be is guessed from single columns first, and then counted, as words make many more.
    """
    rows = cut(distinct.select("rep", "aligned", *P.pack(F.col("aligned"))))
    n, agree = rows.count(), P.agreement(rows)
    products = PRODUCT_COST * n * n / 2
    plan = P.Plan.best(threshold, n, n * n / 2, agree)
    keyed = None if products < 4 * (level_cost + plan.cost(n, n * n / 2, agree)) else cut(plan.keyed(rows.drop("aligned")))
    if keyed is None or products < 4 * (level_cost + P.meetings(keyed) / 2):
        return B.near_pairs(rows, "rep", threshold)
    x, y = P.cells(keyed)
    packed = lambda side, name: side.select("key", "i", "j", F.struct("rep", *P.PACKED).alias(name))
    pairs = packed(x, "x").join(packed(y, "y"), ["key", "i", "j"]).filter("i < j or x.rep < y.rep")
    pairs = pairs.withColumn("identity", P.share("x", "y")).filter(F.col("identity") + S.EPS >= threshold)
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"), "identity").distinct()


def forest(distinct: DataFrame, thresholds: list[float]) -> DataFrame:
    """(a, b, level, edges): links with the components of edges() at each of the rising thresholds, and the numbers of its pairs; see blocks.near_forest."""
    return cut(B.near_forest(cut(distinct.select("aligned", "rep")), "rep", thresholds))


#: Thresholds at which nearest() may look for donors by seeds, one after the other; what has none at the last meets all donors.
LEVELS = (0.85, 0.7, 0.6, 0.5, 0.4)


def nearest(queries: DataFrame, donors: DataFrame, same_fold: bool = False, levels: tuple[float, ...] = LEVELS, level_cost: float = LEVEL_COST) -> DataFrame:
    """For each distinct query (aligned, fold): best identity, and over all donors tied at it (within 1e-12) their count, sums s1 and s2, smallest id, and ids: first_id of each tied donor row, sorted.

    donors: aligned, fold, first_id, n, s1, s2. With same_fold False donors of the query's fold don't
    count (fold null: all count). At each threshold the queries that are left meet donors by seeds, which finds all
    donors at or above it: a query with one has its best and all ties and is done. Queries without any go on to
    the next one, and those without one at the last meet donors in blocks dealt by hashes. A level is passed over
    if, by the letters' frequencies, its keys and pairs cost over a fourth of what the products would for the
    queries that are left; rows are the same.
    """
    packed = P.pack(F.col("aligned"))
    left = cut(queries.select("aligned", "fold").distinct().select("*", F.monotonically_increasing_id().alias("qid"), *packed))
    donors = cut(donors.select("aligned", "fold", "first_id", "n", "s1", "s2", *packed))
    q, n, agree, found = left.count(), donors.count(), None, []
    for threshold in levels:
        products = PRODUCT_COST * q * n
        if products < 4 * level_cost or not n:
            break
        agree = agree or P.agreement(donors)
        plan = P.Plan.best(threshold, q + n, q * n, agree)
        if 4 * (level_cost + plan.cost(q + n, q * n, agree)) > products:
            continue
        sides = cut(plan.keyed(left.drop("aligned"))), cut(plan.keyed(donors.select(F.xxhash64("first_id").alias("qid"), "fold", "first_id", *P.PACKED)))
        if 4 * (level_cost + P.meetings(*sides)) > products:
            continue
        x, y = P.cells(*sides, by="qid")
        x = x.select("key", "i", "j", F.struct("qid", "fold", *P.PACKED).alias("x"))
        y = y.select("key", "i", "j", F.struct("fold", "first_id", *P.PACKED).alias("y"))
        pairs = x.join(y, ["key", "i", "j"])
        if not same_fold:
            pairs = pairs.filter("x.fold is null or y.fold is null or x.fold <> y.fold")
        near = pairs.withColumn("identity", P.share("x", "y")).filter(F.col("identity") + S.EPS >= threshold)
        near = cut(near.select(F.col("x.qid").alias("of"), F.col("y.fold").alias("df"), F.col("y.first_id").alias("donor"), "identity").distinct())
        top = near.groupBy("of").agg(F.max("identity").alias("top"))
        best = near.join(top, "of").filter(F.col("identity") >= F.col("top") - S.EPS)
        rows = donors.select(F.col("fold").alias("f"), F.col("first_id").alias("d"), "n", "s1", "s2")
        best = best.join(rows, (F.col("donor") == F.col("d")) & F.col("df").eqNullSafe(F.col("f")))
        best = best.groupBy("of").agg(F.max("identity").alias("identity"), F.sum("n").cast("long").alias("ties"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.min("donor").alias("first_id"), F.array_sort(F.collect_list("donor")).alias("ids"))
        found.append(left.join(best, left["qid"] == best["of"]).select("aligned", "fold", *RESULT))
        left = cut(left.join(top, left["qid"] == top["of"], "left_anti"))
        q = left.count()
    rest = _by_blocks(left, donors, same_fold).select("aligned", "fold", *RESULT)
    for part in found:
        rest = rest.unionByName(part)
    return rest


RESULT = ["identity", "ties", "s1", "s2", "first_id", "ids"]


def _by_blocks(queries: DataFrame, donors: DataFrame, same_fold: bool) -> DataFrame:
    """nearest() by blocks that meet all of each other: only numbers of a slab's best leave it, and the donors' columns join what is best of all."""
    donors = cut(donors.withColumn("did", F.monotonically_increasing_id()))
    local = cut(B.best(queries, donors, same_fold).withColumnRenamed("qid", "of"))
    top = local.groupBy(F.col("of").alias("q")).agg(F.max("identity").alias("top"))
    tied = local.join(top, F.col("of") == F.col("q")).filter(F.col("identity") >= F.col("top") - S.EPS).select("of", "top", F.explode("dids").alias("d"))
    of = tied.join(donors.select("did", "first_id", "n", "s1", "s2"), F.col("d") == F.col("did")).groupBy("of").agg(F.max("top").alias("identity"), F.sum("n").cast("long").alias("ties"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.array_sort(F.collect_list("first_id")).alias("ids"))
    return queries.join(of, queries["qid"] == of["of"]).select("aligned", "fold", "identity", "ties", "s1", "s2", F.col("ids")[0].alias("first_id"), "ids")


def hamming_nearest(queries: DataFrame, references: DataFrame) -> DataFrame:
    """aligned, distance and nearest: the reference (aligned, first_id) with the fewest differing columns, the smallest id on ties."""
    queries = cut(queries.select("aligned", F.monotonically_increasing_id().alias("qid")))
    local = B.fewest(queries, cut(references)).groupBy(F.col("qid").alias("of")).agg(F.min(F.struct("distance", "nearest")).alias("m"))
    return queries.join(local, queries["qid"] == local["of"]).select("aligned", "m.distance", "m.nearest")
