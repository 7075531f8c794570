"""Components of edge tables, their numbering, and evaluation folds over them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of its own is set only where none is and all tasks run on this machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(given or "file://" + tempfile.mkdtemp(prefix="strandwise-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Evaluates df once into the shared folder."""
    root(df.sparkSession)
    return kept_until_end(df.checkpoint(eager=True))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; it goes when the driver ends."""
    place = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(place)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    _kept.append(place)
    return place


_kept: list[str] = []


def kept_until_end(checkpointed: DataFrame) -> DataFrame:
    """A checkpointed table, whose files go when the driver ends."""
    try:
        place = checkpointed._jdf.queryExecution().logical().rdd().getCheckpointFile()
    except Exception:  # another kind of plan or session: its files are that one's to clean
        return checkpointed
    if place.isDefined():
        _kept.append(str(place.get()))
    return checkpointed


def _drop(place: str) -> None:
    fs, path = FileSystem.from_uri(place if "://" in place else "file://" + place.removeprefix("file:"))
    if fs.get_file_info(path).type.name == "Directory":
        fs.delete_dir(path)


def drop(*tables: DataFrame) -> None:
    """The files of tables that cut() gave go now; what was cut after them stays."""
    for table in tables:
        place = table._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if place.isDefined() and str(place.get()) in _kept:
            _drop(str(place.get()))
            _kept.remove(str(place.get()))


def kept_places(*tables: DataFrame) -> set[str]:
    """The folders of tables that cut() gave; without any, of all that are there."""
    if not tables:
        return set(_kept)
    found = (table._jdf.queryExecution().logical().rdd().getCheckpointFile() for table in tables)
    return {str(place.get()) for place in found if place.isDefined()}


def drop_but(stay: set[str]) -> None:
    """All files of tables go now but those of the folders that stay."""
    for place in [p for p in _kept if p not in stay]:
        _drop(place)
        _kept.remove(place)


@atexit.register
def _drop_kept() -> None:
    for place in _kept:
        _drop(place)


#: Neighbours of a node that joins by a broadcast, and how many such nodes there are at most for each end of the edges.
HOT, MOST_HOT = 100_000, 10_000


def _with_minimum(edges: DataFrame, end: str, minima: DataFrame, hot: int | None) -> DataFrame:
    """edges with the minimum m of one end's neighbours (c, m, and n of them); no task gets all edges of a node with more than `hot` (None: there is none)."""
    if hot is None:
        low = minima.select(F.col("c").alias("e"), "m")
        return edges.join(low, edges[end] == low["e"]).select("u", "v", "m")
    many = F.broadcast(minima.filter(F.col("n") > hot).select("c", "m"))
    some = edges.join(many, edges[end] == many["c"]).select("u", "v", "m")
    rest = edges.join(many.select("c"), edges[end] == many["c"], "left_anti")
    few = minima.filter(F.col("n") <= hot).select(F.col("c").alias("e"), "m")
    return some.unionByName(rest.join(few, rest[end] == few["e"]).select("u", "v", "m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): the smallest node that each reaches.

    Alternating large-star and small-star steps; minima are aggregated before they are joined back, those of nodes with
    more than HOT neighbours by a broadcast, so that none is a hot group. Rounds grow with the logarithm of the size, and each one's files go after the next.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct())
    seen = _digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        hot = max(HOT, 2 * seen[0] // MOST_HOT)
        hot = hot if seen[0] > hot else None  # a node has no more neighbours than there are edges
        least = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = _with_minimum(both, "u", least, hot).filter("v > u").select("v", F.col("m").alias("u")).distinct()
        low = large.groupBy(F.col("v").alias("c")).agg(F.min("u").alias("m"), F.count("*").alias("n"))
        small = _with_minimum(large, "v", low, hot).select(F.col("u").alias("v"), F.col("m").alias("u"))
        last, now = now, cut(small.unionByName(low.select(F.col("c").alias("v"), F.col("m").alias("u"))).filter("u < v").distinct())
        drop(last)
        before, seen = seen, _digest(now)
        if before == seen:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple[int, int]:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def rooted(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """nodes with `root`: itself for nodes without edges."""
    found = connected_components(edges)
    return nodes.join(found, nodes[node] == found["node"], "left").withColumn("root", F.coalesce("root", F.col(node))).drop("node")


def global_rank(df: DataFrame, keys: list, name: str = "rank") -> DataFrame:
    """df with the 1-based position of each row in the order of keys, without one task that holds all rows: range partitions are counted and offset."""
    run = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    at, part = F.col("__at").bitwiseAND((1 << 33) - 1), F.shiftright("__at", 33)
    offsets, total = [], 0
    for r in run.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row for each partition
        offsets.append((r.p, total))
        total += r["count"]
    before = df.sparkSession.createDataFrame(offsets, "__p long, __before long")
    return run.join(F.broadcast(before), part == F.col("__p")).withColumn(name, at + F.col("__before") + 1).drop("__at", "__p", "__before")


def numbered(clusters: DataFrame, prefix: str = "SC") -> DataFrame:
    """clusters (root, size) with cluster_id by falling size, then root."""
    return global_rank(clusters, [F.desc("size"), F.asc("root")], "__rank").withColumn("cluster_id", F.format_string(prefix + "%03d", "__rank")).drop("__rank")


def violations(derived: DataFrame, protocol: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Ids whose groups aren't those of the protocol, or that only one side has: none if the contract holds."""
    x, y = (df.select(F.col(key).alias(f"{p}k"), F.struct(*(F.col(c).cast("string").alias(c) for c in columns)).alias(f"{p}v")) for df, p in ((derived, "d"), (protocol, "p")))
    both = x.join(y, F.col("dk") == F.col("pk"), "full_outer").filter(~F.col("dv").eqNullSafe(F.col("pv")))
    return both.select(F.coalesce("dk", "pk").alias(key), F.col("dv").alias("derived"), F.col("pv").alias("protocol"))


def _fold_plan(histogram: list[tuple[int, int]], folds: int) -> list[tuple[int, int, list[tuple[int, list[int]]]]]:
    """(size, clusters before it, segments) by falling size, for the greedy rule on clusters of equal size.

    With loads base + q * size + r (0 <= r < size), a fold's next places have the levels q, q + 1, ...; a level
    is filled in the order of (r, fold) by the folds that have reached it. A segment is a run of levels
    that the same folds fill: the number of its first place and those folds in order.
    """
    loads, plan, before = [0] * folds, [], 0
    for size, n in sorted(histogram, reverse=True):
        base = min(loads)
        levels = [(load - base) // size for load in loads]
        turn = sorted(range(folds), key=lambda f: ((loads[f] - base) % size, f))
        borders, segments, first = sorted(set(levels)), [], 0
        for low, high in zip(borders, [*borders[1:], None], strict=True):
            here = [f for f in turn if levels[f] <= low]
            segments.append((first, [f + 1 for f in here]))
            room = n - first if high is None else min((high - low) * len(here), n - first)
            rounds, rest = divmod(room, len(here))
            for k, f in enumerate(here):
                loads[f] += size * (rounds + (k < rest))
            first += room
            if first == n:
                break
        plan.append((size, before, segments))
        before += n
    return plan


def fold_loads(histogram: list[tuple[int, int]], folds: int = 3) -> list[int]:
    """Rows of each fold by the rule of greedy_folds, from (size, clusters)."""
    counts, loads = dict(histogram), [0] * folds
    for size, _, segments in _fold_plan(histogram, folds):
        ends = [first for first, _ in segments[1:]] + [counts[size]]
        for (first, turn), end in zip(segments, ends, strict=True):
            rounds, rest = divmod(end - first, len(turn))
            for k, fold in enumerate(turn):
                loads[fold - 1] += size * (rounds + (k < rest))
    return loads


def greedy_folds(clusters: DataFrame, folds: int = 3) -> DataFrame:
    """root, size and fold: largest cluster first (then by root), always to the fold with the fewest rows (lowest number on ties).

    The rule is sequential in the sizes alone: which fold the k-th cluster of a size gets follows from the loads
    before that size. So the driver walks over the distinct sizes (N rows have at most sqrt(2 N) of them),
    and clusters find their fold by their rank and a broadcast row of their size.
    """
    clusters = cut(clusters.select("root", F.col("size").cast("long").alias("size")))
    histogram = [tuple(r) for r in clusters.groupBy("size").count().collect()]
    plan = clusters.sparkSession.createDataFrame(_fold_plan(histogram, folds), "__size long, __before long, __segments array<struct<first:long,turn:array<int>>>")
    ranked = global_rank(clusters, [F.desc("size"), F.asc("root")], "__rank").join(F.broadcast(plan), F.col("size") == F.col("__size"))
    placed = ranked.withColumn("__k", F.col("__rank") - F.col("__before") - 1)
    placed = placed.withColumn("__s", F.element_at(F.filter("__segments", lambda s: s["first"] <= F.col("__k")), -1))
    at = F.pmod(F.col("__k") - F.col("__s.first"), F.size("__s.turn")).cast("int")
    return placed.select("root", "size", F.get(F.col("__s.turn"), at).alias("fold"))
