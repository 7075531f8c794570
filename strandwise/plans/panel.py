"""Queries over the panel: normalising, validation, identity, components and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions import sequences as S
from strandwise.operators import align as A
from strandwise.operators import blocks as B
from strandwise.operators import graph as G
from strandwise.operators import identity as I
from strandwise.operators import rules as V
from strandwise.operators import screening as C
from strandwise.plans.base import CLASSES, EDGES, IDENTITY, MEASURED, PANEL, query
from strandwise.sources import tables as T

THRESHOLDS = [0.70, 0.75, 0.80, 0.85, 0.90, 0.95]


@query(f"with {PANEL} select peptide_id, aligned, cast(length(replace(aligned, '-', '')) as integer) as residues, sha256(aligned) as aligned_sha256, aligned <> repeat('-', 30) as valid from panel")
def panel_normalize(spark, d) -> DataFrame:
    p = T.panel(spark, d)
    _, error = S.normalise(F.col("aligned"))
    return p.select("peptide_id", "aligned", S.residues(F.col("aligned")).alias("residues"), F.sha2("aligned", 256).alias("aligned_sha256"), error.isNull().alias("valid"))


ISSUES = """, w as (select 'seq_pep' || (doc_id - (doc_id % 31 = 0)::int) as peptide_id, doc_id, case when doc_id % 29 = 0 then 'X' else '' end || replace(aligned, '-', '') as raw, 30 - (doc_id % 19 = 0)::int as declared, ec1, log10(ec1 * 1e-12) + case when doc_id % 17 = 0 then 0.05 else 0 end as log1 from m),
d as (select peptide_id, min(doc_id) as first from w group by peptide_id),
i as (select peptide_id, unnest(list_filter([
    case when doc_id > first then 'duplicate_id' end,
    case when raw = '' then 'invalid_sequence' end,
    case when regexp_matches(upper(raw), '[^ACDEFGHIKLMNPQRSTVWY]') then 'invalid_residue' end,
    case when length(raw) <> declared then 'length_mismatch' end,
    case when ec1 is null or ec1 <= 0 then 'invalid_ec50' end,
    case when ec1 > 0 and abs(log10(ec1 * 1e-12) - log1) > 0.011 then 'log_ec50_mismatch' end], lambda x: x is not null)) as code from w join d using (peptide_id))"""


def _issues(spark, d) -> DataFrame:
    """What is wrong with measured rows, some of which have another row's id, a foreign residue, length or logarithm."""
    m = T.measured(spark, d)
    given = F.concat(F.lit("seq_pep"), F.col("doc_id") - (F.col("doc_id") % 31 == 0).cast("int"))
    raw = F.concat(F.when(F.col("doc_id") % 29 == 0, "X").otherwise(""), F.replace(F.col("aligned"), F.lit("-"), F.lit("")))
    true = F.log10(F.col("ec1") * 1e-12)
    said = true + F.when(F.col("doc_id") % 17 == 0, 0.05).otherwise(0.0)
    declared = 30 - (F.col("doc_id") % 19 == 0).cast("int")
    bad = F.col("ec1").isNull() | (F.col("ec1") <= 0)
    w = m.select("doc_id", given.alias("peptide_id"), raw.alias("raw"), declared.alias("declared"), bad.alias("bad"), (~bad & (F.abs(true - said) > 0.011)).alias("other"))
    first = w.groupBy(F.col("peptide_id").alias("of")).agg(F.min("doc_id").alias("first"))
    raw = F.col("raw")
    found = F.array_compact(F.array(F.when(F.col("doc_id") > F.col("first"), "duplicate_id"), F.when(raw == "", "invalid_sequence"), F.when(F.upper(raw).rlike(f"[^{S.ALPHABET[1:]}]"), "invalid_residue"), F.when(F.length(raw) != F.col("declared"), "length_mismatch"), F.when(F.col("bad"), "invalid_ec50"), F.when(F.col("other"), "log_ec50_mismatch")))
    return w.join(first, F.col("peptide_id") == F.col("of")).select("peptide_id", F.explode(found).alias("code"))


@query(f"with {MEASURED} {ISSUES} select count(*) as errors, count(*) = 0 as passed from i")
def validation_passed(spark, d) -> DataFrame:
    return _issues(spark, d).agg(F.count("*").alias("errors"), (F.count("*") == 0).alias("passed"))


@query(f"with {MEASURED} {ISSUES} select peptide_id, code, 'error' as severity from i")
def validate_issues(spark, d) -> DataFrame:
    return _issues(spark, d).withColumn("severity", F.lit("error"))


@query(f"with {MEASURED} {ISSUES} select code, count(*) as issues, count(distinct peptide_id) as peptides from i group by code")
def validate_report(spark, d) -> DataFrame:
    return _issues(spark, d).groupBy("code").agg(F.count("*").alias("issues"), F.countDistinct("peptide_id").alias("peptides"))


def _sheets(spark, d) -> tuple[DataFrame, DataFrame]:
    """Measured rows as a dataset and an alignment sheet, in order of doc_id, some of them broken in every way that rules know."""
    m = G.global_rank(T.measured(spark, d), [F.asc("doc_id")], "k").withColumn("row", F.col("k") + 1)
    every = lambda n: F.col("doc_id") % n == 0
    bare = F.replace("aligned", F.lit("-"), F.lit(""))
    log = lambda c: F.log10(F.col(c) * 1e-12)
    dataset = m.select(
        "row",
        F.when(every(37), "").when(every(31), F.concat(F.lit("seq_pep"), F.col("doc_id") - 1)).otherwise(F.col("peptide_id")).alias("peptide_id"),
        F.when(every(59), "").otherwise(F.concat(F.when(every(29), "X").otherwise(""), bare)).alias("sequence"),
        (F.length(bare) + every(19).cast("int")).alias("declared"),
        "ec1",
        (log("ec1") + F.when(every(17), 0.05).otherwise(0.0)).alias("log1"),
        F.when(every(41), -1.0).otherwise(F.col("ec2")).alias("ec2"),
        F.when(~every(23), log("ec2") - F.when(every(13), 0.05).otherwise(0.0)).alias("log2"),
    )
    kept = G.global_rank(m.filter(~every(43)).drop("k", "row"), [F.asc("doc_id")], "k")
    short = F.when(every(53), "").when(every(47), F.substring("aligned", 1, 29)).when(every(61), F.concat(F.lit("*"), F.substring("aligned", 2, 29))).otherwise(F.col("aligned"))
    return dataset, kept.select((F.col("k") + 1).alias("row"), "peptide_id", short.alias("sequence"), F.when(~every(67), 30).alias("declared"))


EXPECTED = 100


@query(f"""with {MEASURED}, d as materialized (select row_number() over (order by doc_id) + 1 as row, case when doc_id % 37 = 0 then '' when doc_id % 31 = 0 then 'seq_pep' || (doc_id - 1) else peptide_id end as id,
 case when doc_id % 59 = 0 then '' else case when doc_id % 29 = 0 then 'X' else '' end || replace(aligned, '-', '') end as s, length(replace(aligned, '-', '')) + (doc_id % 19 = 0)::int as declared,
 ec1, log10(ec1 * 1e-12) + case when doc_id % 17 = 0 then 0.05 else 0 end as log1, case when doc_id % 41 = 0 then -1.0 else ec2 end as ec2, case when doc_id % 23 <> 0 then log10(ec2 * 1e-12) - case when doc_id % 13 = 0 then 0.05 else 0 end end as log2 from m),
a as materialized (select row_number() over (order by doc_id) + 1 as row, peptide_id as id, case when doc_id % 53 = 0 then '' when doc_id % 47 = 0 then substr(aligned, 1, 29) when doc_id % 61 = 0 then '*' || substr(aligned, 2, 29) else aligned end as s, case when doc_id % 67 <> 0 then 30 end as declared from m where doc_id % 43 <> 0),
f as (select id, min(row) as first from d where id <> '' group by id), x as (select d.*, first from d left join f using (id)),
i as (select row, 'dataset' as sheet, unnest(list_filter([case when id = '' then 'missing_id' when row > first then 'duplicate_id' end, case when s = '' then 'invalid_sequence' when regexp_matches(upper(s), '[^ACDEFGHIKLMNPQRSTVWY]') then 'invalid_residue' end, case when s <> '' and length(s) <> declared then 'length_mismatch' end,
  case when not ec1 > 0 then 'invalid_ec50' when log1 is null then 'invalid_log_ec50' when abs(log10(ec1 * 1e-12) - log1) > 0.011 then 'log_ec50_mismatch' end, case when not ec2 > 0 then 'invalid_ec50' when log2 is null then 'invalid_log_ec50' when abs(log10(nullif(greatest(ec2, 0), 0) * 1e-12) - log2) > 0.011 then 'log_ec50_mismatch' end], lambda v: v is not null)) as code, first from x
 union all select row, 'alignment', unnest(list_filter([case when s = '' then 'invalid_sequence' when regexp_matches(s, '[^-ACDEFGHIKLMNPQRSTVWY]') then 'invalid_residue' end, case when s <> '' and (length(s) <> 30 or declared is distinct from 30) then 'aligned_length_mismatch' end], lambda v: v is not null)), null from a
 union all select null, 'dataset', 'record_count', null from (select count(*) as n from d) where n <> {EXPECTED} union all select null, 'alignment', 'record_count', null from (select count(*) as n from a) where n <> {EXPECTED}
 union all select null, 'alignment', 'id_set_mismatch', null from (select (select count(*) from (select id from d where id <> '' except select id from a)) + (select count(*) from (select id from a except select id from d where id <> '')) as n) where n > 0)
select code, sheet, row, case when code = 'duplicate_id' then first end as first_row from i""")
def validation_places(spark, d) -> DataFrame:
    """Every issue of the two sheets with its place: both targets, and of an id that is taken the row that has it."""
    dataset, alignment = _sheets(spark, d)
    found = V.dataset_issues(G.cut(dataset), G.cut(alignment), [("gcgr", "ec1", "log1"), ("glp1r", "ec2", "log2")], EXPECTED)
    return found.select("code", "sheet", "row", "first_row")


@query("select (select count(*) from (select doc_id from documents except select doc_id from labels)) as only_left, (select count(*) from (select doc_id from labels except select doc_id from documents)) as only_right")
def idset_difference(spark, d) -> DataFrame:
    a = T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("s"))
    b = T.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit(2).alias("s"))
    sides = a.unionByName(b).groupBy("id").agg(F.bit_or("s").alias("s"))
    return sides.agg(F.count_if(F.col("s") == 1).alias("only_left"), F.count_if(F.col("s") == 2).alias("only_right"))


@query("select doc_id as id, count(*) as copies from (select doc_id from documents union all select doc_id from labels) group by 1 having count(*) > 1")
def duplicate_ids(spark, d) -> DataFrame:
    ids = T.table(spark, d, "documents").select("doc_id").unionByName(T.table(spark, d, "labels").select("doc_id"))
    return ids.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("copies")).filter("copies > 1")


@query(f"with {EDGES} select a, b, round(identity, 9) as identity from pairs where identity + 1e-12 >= 0.85")
def identity_edges_085(spark, d) -> DataFrame:
    return I.edges(I.classes(T.panel(spark, d)), 0.85).withColumn("identity", F.round("identity", 9))


@query(f"with {EDGES} select cast(t as double) as threshold, count(*) filter (identity + 1e-12 >= t) as edges from pairs, (select unnest({THRESHOLDS}) as t) group by t")
def identity_threshold_counts(spark, d) -> DataFrame:
    found = I.forest(I.classes(T.panel(spark, d)), THRESHOLDS)
    counts = found.agg(*(F.coalesce(F.sum(F.when(F.col("level") >= k, F.col("edges"))), F.lit(0)).alias(f"t{k}") for k in range(len(THRESHOLDS))))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{k}").alias("edges")) for k, t in enumerate(THRESHOLDS)))).alias("x")).select("x.*")


def _rooted(spark, d) -> DataFrame:
    """aligned, rep, n and root of every distinct sequence, at 0.85."""
    distinct = G.cut(I.classes(T.panel(spark, d)))
    return G.rooted(distinct, I.forest(distinct, [0.85]).filter("a is not null").select("a", "b"), "rep")


COMPONENTS = EDGES + """,
e as materialized (select a as x, b as y from pairs where identity + 1e-12 >= 0.85 union all select b, a from pairs where identity + 1e-12 >= 0.85),
reach as (select rep as x, rep as y from cls union select r.x, e.y from reach r join e on r.y = e.x),
root as materialized (select x as rep, min(y) as root from reach group by x),
member as (select p.peptide_id, p.fold, p.aligned, root.root from panel p join cls on p.aligned = cls.aligned join root on root.rep = cls.rep),
sizes as materialized (select root, count(*) as size from member group by root),
named as materialized (select root, size, 'SC' || printf('%03d', row_number() over (order by size desc, root)) as cluster_id from sizes)"""


@query(f"with recursive {COMPONENTS} select root, size from sizes")
def sequence_components(spark, d) -> DataFrame:
    return _rooted(spark, d).groupBy("root").agg(F.sum("n").alias("size"))


@query(f"with recursive {COMPONENTS} select cluster_id, root, size from named")
def component_numbering(spark, d) -> DataFrame:
    return G.numbered(_rooted(spark, d).groupBy("root").agg(F.sum("n").alias("size"))).select("cluster_id", "root", "size")


def _walk(partition: str = "") -> str:
    """The greedy rule one cluster after the other, for each value of a column or once."""
    key = f"{partition}, " if partition else ""
    first = f"select distinct {key}" if partition else "select "
    return f""",
turn as materialized (select {key}root, size, row_number() over ({f'partition by {partition} ' if partition else ''}order by size desc, root) as k from sizes),
walk as ({first}cast(0 as bigint) as k, '' as root, cast(0 as bigint) as size, 0 as fold, cast(0 as bigint) as l1, cast(0 as bigint) as l2, cast(0 as bigint) as l3{' from sizes' if partition else ''}
  union all select {f'w.{partition}, ' if partition else ''}turn.k, turn.root, turn.size, f, l1 + if(f = 1, turn.size, 0), l2 + if(f = 2, turn.size, 0), l3 + if(f = 3, turn.size, 0)
  from (select *, case when l1 <= l2 and l1 <= l3 then 1 when l2 <= l3 then 2 else 3 end as f from walk) w join turn on turn.k = w.k + 1{f' and turn.{partition} = w.{partition}' if partition else ''})"""


FOLDED = COMPONENTS + _walk()


@query(f"with recursive {FOLDED} select root, size, fold from walk where k > 0")
def greedy_folds(spark, d) -> DataFrame:
    return G.greedy_folds(_rooted(spark, d).groupBy("root").agg(F.sum("n").alias("size")))


@query(f"with recursive {FOLDED} select peptide_id, cluster_id, named.size as cluster_size, walk.fold as outer_fold, sha256(aligned) as aligned_sha256 from member join named using (root) join walk using (root)")
def split_rows(spark, d) -> DataFrame:
    """Peptide, cluster, size, fold and checksum: clusters stay whole."""
    rooted = G.cut(_rooted(spark, d))
    clusters = G.cut(rooted.groupBy("root").agg(F.sum("n").alias("size")))
    folds = G.greedy_folds(clusters).select(F.col("root").alias("r"), F.col("fold").alias("outer_fold"))
    named = G.numbered(clusters).join(folds, F.col("root") == F.col("r")).drop("r")
    member = T.panel(spark, d).select("peptide_id", "aligned").join(rooted.select("aligned", "root"), "aligned")
    return member.join(named, "root").select("peptide_id", "cluster_id", F.col("size").alias("cluster_size"), "outer_fold", F.sha2("aligned", 256).alias("aligned_sha256"))


AUDIT = EDGES + f""",
th as materialized (select cast(unnest({THRESHOLDS}) as double) as t),
e as materialized (select t, a as x, b as y from pairs, th where identity + 1e-12 >= t union all select t, b, a from pairs, th where identity + 1e-12 >= t),
reach as (select t, rep as x, rep as y from cls, th union select r.t, r.x, e.y from reach r join e on r.t = e.t and r.y = e.x),
roots as materialized (select t, x as rep, min(y) as root from reach group by t, x),
sizes as materialized (select t, root, cast(sum(n) as bigint) as size from roots join cls using (rep) group by t, root)""" + _walk("t") + """,
fold_sizes as (select t, fold, sum(size) as f from walk where k > 0 group by t, fold),
spread as (select t, min(f) as smallest, max(f) as largest_fold, string_agg(f, ';' order by fold) as sizes from fold_sizes group by t),
about as (select t, count(*) as components, count(*) filter (size = 1) as singletons, max(size) as largest, sum(size) as members from sizes group by t),
audit as (select t as threshold, (select count(*) from e where e.t = about.t) // 2 as edges, components, singletons, largest, round(largest / members, 9) as largest_fraction, sizes as fold_sizes, round(largest_fold / smallest, 9) as fold_ratio, components >= 3 and largest_fold / smallest <= 1.5 as eligible
  from about join spread using (t))"""


def _audit(spark, d) -> tuple[DataFrame, list[tuple]]:
    """(rep, aligned, n and root of each distinct sequence and number k of a threshold, rows of the audit).

    Sequences meet once, at the lowest threshold, and one run of components takes all thresholds, whose nodes have the threshold's
    number before their ids. The driver gets clusters by threshold and size (N rows have at most sqrt(2 N) sizes).
    """
    distinct = G.cut(I.classes(T.panel(spark, d)))
    found = I.forest(distinct, THRESHOLDS)
    numbers = F.array(*(F.lit(k) for k in range(len(THRESHOLDS))))
    of = lambda k, c: F.concat(k.cast("string"), F.lit(":"), c)
    links = found.filter("a is not null").select("a", "b", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("k")).select(of(F.col("k"), F.col("a")).alias("a"), of(F.col("k"), F.col("b")).alias("b"))
    nodes = distinct.withColumn("k", F.explode(numbers)).withColumn("node_id", of(F.col("k"), F.col("rep")))
    rooted = G.cut(G.rooted(nodes, links, "node_id").select("k", "rep", "aligned", "n", F.expr("substring(root, instr(root, ':') + 1)").alias("root")))
    sizes = rooted.groupBy("k", "root").agg(F.sum("n").alias("size")).groupBy("k", "size").count().collect()
    edges = found.agg(*(F.coalesce(F.sum(F.when(F.col("level") >= k, F.col("edges"))), F.lit(0)) for k in range(len(THRESHOLDS)))).first()
    rows = []
    for k, t in enumerate(THRESHOLDS):
        histogram = [(r["size"], r["count"]) for r in sizes if r.k == k]
        if histogram:
            loads = [x for x in G.fold_loads(histogram) if x]  # three folds, fewer with fewer clusters
            components, members, largest = sum(n for _, n in histogram), sum(size * n for size, n in histogram), max(size for size, _ in histogram)
            rows.append((t, edges[k], components, dict(histogram).get(1, 0), largest, largest / members, ";".join(map(str, loads)), max(loads) / min(loads), components >= 3 and max(loads) / min(loads) <= 1.5))
    return rooted, rows


@query(f"with recursive {AUDIT} select * from audit")
def threshold_audit(spark, d) -> DataFrame:
    """Edges, components, fold sizes and eligibility at each threshold."""
    out = spark.createDataFrame(_audit(spark, d)[1], "threshold double, edges long, components long, singletons long, largest long, largest_fraction double, fold_sizes string, fold_ratio double, eligible boolean")
    return out.withColumns({c: F.round(c, 9) for c in ("largest_fraction", "fold_ratio")})


@query(f"with recursive {AUDIT} select * from audit where eligible order by threshold limit 1")
def selected_threshold(spark, d) -> DataFrame:
    """The lowest eligible threshold; no row if none is."""
    return threshold_audit(spark, d).filter("eligible").orderBy("threshold").limit(1)


@query("select source, count(distinct doc_id % 3 + 1) as folds from documents group by source having count(distinct doc_id % 3 + 1) > 1")
def leak_check(spark, d) -> DataFrame:
    return T.panel(spark, d).groupBy("source").agg(F.countDistinct("fold").alias("folds")).filter("folds > 1")


@query(f"""with {CLASSES}, f as (select cls.aligned, gaps, fold, max(peptide_id) as id from panel join cls using (aligned) group by all),
x as (select {IDENTITY.format(a='x', b='y')} as identity, least(x.id, y.id) as a, greatest(x.id, y.id) as b from f x join f y on x.fold < y.fold)
select round(identity, 9) as identity, a as first_id, b as second_id from x order by x.identity desc, a desc, b desc limit 1""")
def max_cross_fold_identity(spark, d) -> DataFrame:
    """The greatest identity over folds and the largest pair of ids that has it; no row if nothing crosses folds."""
    p = G.cut(_valid(spark, d).groupBy("aligned", "fold").agg(F.max("peptide_id").alias("first_id"), F.count("*").alias("n")).withColumns({"s1": F.lit(0.0), "s2": F.lit(0.0)}))
    best = I.nearest(p, p).select(F.col("aligned").alias("x"), F.col("fold").alias("f"), "identity", "ids")
    pairs = p.join(best, (F.col("aligned") == F.col("x")) & (F.col("fold") == F.col("f"))).select("identity", F.col("first_id").alias("own"), F.element_at("ids", -1).alias("other"))
    top = pairs.agg(F.max(F.struct("identity", F.least("own", "other").alias("first_id"), F.greatest("own", "other").alias("second_id"))).alias("m")).filter("m is not null")
    return top.select(F.round("m.identity", 9).alias("identity"), "m.first_id", "m.second_id")


@query(f"with {PANEL}, x as (select peptide_id, doc_id, aligned, min(doc_id) over (partition by aligned) as first from panel where aligned <> repeat('-', 30)) select peptide_id, 'seq_pep' || first as first_seen from x where doc_id > first")
def first_seen_duplicates(spark, d) -> DataFrame:
    """Every row whose sequence stands in an earlier row, with the first of these."""
    p = _valid(spark, d).select("peptide_id", "doc_id", "aligned")
    first = p.groupBy(F.col("aligned").alias("of")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return p.join(first, F.col("aligned") == F.col("of")).filter("doc_id > first").select("peptide_id", F.concat(F.lit("seq_pep"), "first").alias("first_seen"))


@query()
def split_pipeline(spark, d) -> DataFrame:
    """Audit, the lowest eligible threshold, components and folds at it: the rows of the split, once no pair of two folds reaches the threshold.

    It is an error if no threshold is eligible, an id is in two folds, or a pair crosses folds.
    """
    rooted, audit = _audit(spark, d)
    chosen = min((r[0] for r in audit if r[-1]), default=None)
    if chosen is None:
        raise ValueError("no threshold is eligible")
    rooted = rooted.filter(F.col("k") == THRESHOLDS.index(chosen)).drop("k")
    clusters = G.cut(rooted.groupBy("root").agg(F.sum("n").alias("size")))
    folds = G.cut(G.greedy_folds(clusters).select(F.col("root").alias("r"), F.col("fold").alias("outer_fold")))
    where = rooted.join(folds, F.col("root") == F.col("r")).select("aligned", "rep", F.col("outer_fold").alias("group"))
    # the sequences meet once more: each with the folds that it reaches
    if B.reached(where.select("aligned", "rep"), where.select("aligned", "group"), chosen).join(where.select(F.col("rep").alias("own"), F.col("group").alias("fold")), F.col("rep") == F.col("own")).filter("group <> fold").limit(1).count():
        raise ValueError("a pair at the threshold crosses folds")
    named = G.numbered(clusters).join(folds, F.col("root") == F.col("r")).drop("r")
    member = T.panel(spark, d).select("peptide_id", "aligned").join(rooted.select("aligned", "root"), "aligned")
    out = G.cut(member.join(named, "root").select("peptide_id", "cluster_id", F.col("size").alias("cluster_size"), "outer_fold", F.lit(chosen).alias("threshold")))
    if out.groupBy("peptide_id").count().filter("count > 1").limit(1).count():
        raise ValueError("an id is in the split twice")
    return out


def _valid(spark, d) -> DataFrame:
    return T.panel(spark, d).filter(F.col("aligned") != S.ALL_GAP)


@query(f"with {PANEL} select p as position, substr(aligned, cast(p + 1 as integer), 1) as symbol, count(*) as n from panel, (select unnest(range(30)) as p) where aligned <> repeat('-', 30) group by all")
def onehot_counts(spark, d) -> DataFrame:
    hot = _valid(spark, d).select(F.explode(S.one_hot(F.col("aligned"))).alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    return hot.select(F.floor(F.col("f") / 21).cast("long").alias("position"), F.substring(F.lit(S.ALPHABET), (F.col("f") % 21 + 1).cast("int"), F.lit(1)).alias("symbol"), "n")


NEAREST = CLASSES + f""",
ref as materialized (select cls.aligned, gaps, min(peptide_id) as first_id, count(*) as n from panel join cls using (aligned) where doc_id % 8 = 0 group by all),
qry as materialized (select distinct cls.aligned, gaps from panel join cls using (aligned) where doc_id % 8 <> 0),
sc as materialized (select qry.aligned, first_id, n, hamming(qry.aligned, ref.aligned) as h, {IDENTITY.format(a='qry', b='ref')} as identity from qry, ref)"""


@query(f"with {NEAREST}, b as (select aligned, min(h) as h from sc group by aligned) select p.peptide_id, b.h as distance, min(sc.first_id) as nearest from panel p join b using (aligned) join sc on sc.aligned = b.aligned and sc.h = b.h where p.doc_id % 8 <> 0 group by all")
def hamming_nearest(spark, d) -> DataFrame:
    """The reference with the fewest differing columns, the smallest id on ties: references meet queries in blocks of one letter group each."""
    p = _valid(spark, d)
    ref = p.filter("doc_id % 8 = 0").groupBy("aligned").agg(F.min("peptide_id").alias("first_id"))
    qry = p.filter("doc_id % 8 <> 0").select("aligned").distinct()
    found = I.hamming_nearest(qry, ref)
    return p.filter("doc_id % 8 <> 0").select("peptide_id", "aligned").join(found, "aligned").select("peptide_id", "distance", "nearest")


def _applicability(spark, d) -> DataFrame:
    p = _valid(spark, d)
    ref = p.filter("doc_id % 8 = 0").groupBy("aligned").agg(F.min("peptide_id").alias("first_id"), F.count("*").alias("n")).withColumns({"fold": F.lit(None).cast("int"), "s1": F.lit(0.0), "s2": F.lit(0.0)})
    qry = p.filter("doc_id % 8 <> 0").select("aligned", F.lit(None).cast("int").alias("fold"))
    return I.nearest(qry, ref).select("aligned", "identity", "ties", "first_id", "ids")


TIER = "case when {x} >= 0.85 then 'close_analogue' when {x} >= 0.70 then 'distant_analogue' else 'outside_reference_neighborhood' end"
EVIDENCE = "case when {x} >= 1 - 1e-12 then 'training_reference_match' when {x} >= 0.85 then 'local_analogue_mixed_evidence' when {x} >= 0.70 then 'outside_ranking_scope' else 'far_outside_reference_scope' end"
BEST = NEAREST + """,
top as materialized (select aligned, max(identity) as identity from sc group by aligned),
app as materialized (select top.aligned, top.identity, cast(sum(n) as bigint) as ties, min(first_id) as nearest, string_agg(first_id, ';' order by first_id) as ids from top join sc on sc.aligned = top.aligned and sc.identity >= top.identity - 1e-12 group by all)"""


@query(f"with {BEST} select p.peptide_id, round(identity, 9) as identity, ties, nearest, {TIER.format(x='identity')} as tier, {EVIDENCE.format(x='identity')} as evidence from panel p join app using (aligned) where p.doc_id % 8 <> 0")
def applicability(spark, d) -> DataFrame:
    q = _valid(spark, d).filter("doc_id % 8 <> 0").select("peptide_id", "aligned")
    best = F.col("identity")
    return q.join(_applicability(spark, d), "aligned").select("peptide_id", F.round(best, 9).alias("identity"), "ties", F.col("first_id").alias("nearest"), S.tier(best).alias("tier"), S.evidence(best).alias("evidence"))


def _w(pos: str, sym: str) -> tuple[str, str]:
    return f"((({pos}) * 31 + ascii({sym}) * 17) % 101 - 50) / 100.0", f"((({pos}) * 13 + ascii({sym}) * 29) % 97 - 48) / 100.0"


@query(f"""with {BEST}, r as (select peptide_id as ref_id, aligned as ref from panel),
q as (select p.peptide_id, p.aligned, app.nearest, r.ref from panel p join app using (aligned) join r on r.ref_id = app.nearest where p.doc_id % 8 <> 0 and p.aligned <> r.ref)
select peptide_id, nearest, cast(k + 1 as integer) as position, substr(ref, cast(k + 1 as integer), 1) as from_symbol, substr(aligned, cast(k + 1 as integer), 1) as to_symbol,
 round({_w('k', 'substr(aligned, cast(k + 1 as integer), 1)')[0]} - {_w('k', 'substr(ref, cast(k + 1 as integer), 1)')[0]}, 9) as d_gcgr,
 round({_w('k', 'substr(aligned, cast(k + 1 as integer), 1)')[1]} - {_w('k', 'substr(ref, cast(k + 1 as integer), 1)')[1]}, 9) as d_glp1r
from q, (select unnest(range(30)) as k) where substr(aligned, cast(k + 1 as integer), 1) <> substr(ref, cast(k + 1 as integer), 1)""")
def nearest_reference_decomposition(spark, d) -> DataFrame:
    """What each changed position adds to the prediction over the nearest reference's."""
    p = _valid(spark, d)
    ref = p.select(F.col("peptide_id").alias("ref_id"), F.col("aligned").alias("ref"))
    q = p.filter("doc_id % 8 <> 0").select("peptide_id", "aligned").join(_applicability(spark, d), "aligned").join(ref, F.col("first_id") == F.col("ref_id"))
    at = q.select("peptide_id", F.col("first_id").alias("nearest"), "aligned", "ref", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("position"))
    at = at.select("peptide_id", "nearest", "position", F.substr("ref", "position", F.lit(1)).alias("from_symbol"), F.substr("aligned", "position", F.lit(1)).alias("to_symbol")).filter("from_symbol <> to_symbol")
    delta = lambda k: F.round(S.weight(F.col("position") - 1, F.col("to_symbol"), k) - S.weight(F.col("position") - 1, F.col("from_symbol"), k), 9)
    return at.withColumns({"d_gcgr": delta(0), "d_glp1r": delta(1)})


PREDICTED = """,
lin as materialized (select aligned, cast(sum((k * 31 + ascii(substr(aligned, cast(k + 1 as integer), 1)) * 17) % 101 - 50) as double) / 100 + 2.0 as gcgr, cast(sum((k * 13 + ascii(substr(aligned, cast(k + 1 as integer), 1)) * 29) % 97 - 48) as double) / 100 + 1.5 as glp1r from (select distinct aligned from panel where aligned <> repeat('-', 30)), (select unnest(range(30)) as k) group by aligned)"""


@query(f"with {PANEL} {PREDICTED} select peptide_id, round(gcgr, 6) as gcgr, round(glp1r, 6) as glp1r from panel join lin using (aligned)")
def linear_predict(spark, d) -> DataFrame:
    a = F.col("aligned")
    return _valid(spark, d).select("peptide_id", F.round(S.linear(a, 0), 6).alias("gcgr"), F.round(S.linear(a, 1), 6).alias("glp1r"))


DIRECTION = "case when pow(10.0, {s}) >= 3 then 'glp1r_preferring' when pow(10.0, {s}) <= 1.0/3 then 'gcgr_preferring' else 'within_threefold' end"


@query(f"with {PANEL} {PREDICTED} select peptide_id, round(log10(pow(10.0, gcgr)), 6) as log_pm, round(log10(pow(10.0, gcgr) / 1000), 6) as log_nm, round(gcgr - glp1r, 6) as selectivity, {DIRECTION.format(s='round(gcgr - glp1r, 9)')} as direction from panel join lin using (aligned)")
def unit_conversions(spark, d) -> DataFrame:
    p = _valid(spark, d).select("peptide_id", S.linear(F.col("aligned"), 0).alias("a"), S.linear(F.col("aligned"), 1).alias("b"))
    pm, sel = F.pow(F.lit(10.0), F.col("a")), F.col("a") - F.col("b")
    return p.select("peptide_id", F.round(F.log10(pm), 6).alias("log_pm"), F.round(F.log10(pm / 1000), 6).alias("log_nm"), F.round(sel, 6).alias("selectivity"), S.direction(F.round(sel, 9)).alias("direction"))


@query(f"with {PANEL}, r as (select distinct aligned from panel where doc_id % 8 = 0 and aligned <> repeat('-', 30)) select case doc_id % 3 when 0 then 'dual' when 1 then 'gcgr_selective' else 'glp1r_selective' end as design_group, count(*) as n, count(*) filter (aligned in (select aligned from r)) as exact_overlap from panel where doc_id % 8 <> 0 and aligned <> repeat('-', 30) group by 1")
def holdout_overlap(spark, d) -> DataFrame:
    p = _valid(spark, d)
    ref = p.filter("doc_id % 8 = 0").select(F.col("aligned").alias("r")).distinct()
    q = p.filter("doc_id % 8 <> 0").join(ref, F.col("aligned") == F.col("r"), "left")
    group = F.when(F.col("doc_id") % 3 == 0, "dual").when(F.col("doc_id") % 3 == 1, "gcgr_selective").otherwise("glp1r_selective")
    return q.groupBy(group.alias("design_group")).agg(F.count("*").alias("n"), F.count("r").alias("exact_overlap"))


@query(f"with {NEAREST}, b as (select aligned, min(h) as h from sc group by aligned) select p.peptide_id, case p.doc_id % 3 when 0 then 'dual' when 1 then 'gcgr_selective' else 'glp1r_selective' end as design_group, b.h as distance, min(sc.first_id) as nearest, b.h = 0 as exact_overlap from panel p join b using (aligned) join sc on sc.aligned = b.aligned and sc.h = b.h where p.doc_id % 8 <> 0 group by all")
def holdout_rows(spark, d) -> DataFrame:
    """Each held-out row with its design group, its nearest reference by differing columns, and whether it is one."""
    group = F.when(F.col("doc_id") % 3 == 0, "dual").when(F.col("doc_id") % 3 == 1, "gcgr_selective").otherwise("glp1r_selective")
    rows = T.panel(spark, d).select(F.col("peptide_id").alias("of"), group.alias("design_group"))
    return hamming_nearest(spark, d).join(rows, F.col("peptide_id") == F.col("of")).select("peptide_id", "design_group", "distance", "nearest", (F.col("distance") == 0).alias("exact_overlap"))


@query(f"""with {PANEL} {PREDICTED}, c as (select doc_id, case when doc_id % 11 = 0 then '=' || peptide_id when doc_id % 13 = 0 then '' else peptide_id end as candidate_id from panel)
select doc_id, case when regexp_matches(candidate_id, '^[=+@-]') then '''' || candidate_id else candidate_id end as shown, case when candidate_id = '' then 'missing_id' when not regexp_matches(candidate_id, '^[A-Za-z0-9][A-Za-z0-9_.:-]{{0,127}}$') then 'invalid_id' end as error from c""")
def candidate_ids(spark, d) -> DataFrame:
    c = T.panel(spark, d).select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("="), "peptide_id")).when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("peptide_id")).alias("candidate_id"))
    return c.select("doc_id", S.spreadsheet_safe(F.col("candidate_id")).alias("shown"), S.candidate_id_error(F.col("candidate_id")).alias("error"))


#: The frozen stand-in model that the screening queries name: its weights are a formula, so that SQL can score, too.
STAND_IN = C.Model("stand-in-linear", "1", "none", {"glp1r": 1.07, "gcgr": 0.63}, warnings={"endpoint": "one assay each", "validation": "stand-in weights", "ranking": "an order to explore, no probability of success"})


def _screen_sql(objective: str) -> str:
    score = {"glp1r": "glp1r", "gcgr": "gcgr", "dual": "greatest(gcgr, glp1r)"}[objective]
    mae, w = STAND_IN.mae_of(objective), STAND_IN.warnings
    ok, safe = "status <> 'input_error'", "case when regexp_matches({x}, '^[=+@-]') then '''' || {x} else {x} end"
    when = lambda c, **k: ", ".join(f"case when {c} then {v} end as {n}" for n, v in k.items())
    return f"""with {BEST} {PREDICTED},
c as (select p.doc_id, case when p.doc_id % 11 = 0 then '=' || p.peptide_id when p.doc_id % 13 = 0 then '' else p.peptide_id end as cid, p.aligned, identity, ids, length(replace(p.aligned, '-', '')) as residues, gcgr, glp1r, {TIER.format(x='identity')} as tier
      from panel p left join app using (aligned) left join lin using (aligned) where p.doc_id % 8 <> 0),
e as (select *, {score} as score, case when cid = '' then 'missing_id' when not regexp_matches(cid, '^[A-Za-z0-9][A-Za-z0-9_.:-]{{0,127}}$') then 'invalid_id' end as id_error,
  concat_ws('; ', case when tier <> 'close_analogue' then 'applicability_tier=' || tier end, case when residues < 26 then 'standard_residue_count=' || residues || ' is below 26' end) as reasons from c),
g as (select *, case when id_error is not null or identity is null then 'input_error' when reasons <> '' then 'not_ranked_out_of_scope' else 'ranked' end as status from e),
dup as (select aligned, count(*) as copies from g where {ok} group by aligned),
k as (select doc_id, dense_rank() over (order by round(score, 9)) as rank, score - min(score) over () as delta from g where status = 'ranked')
select g.doc_id as input_row, {safe.format(x='cid')} as candidate_id, {safe.format(x='g.aligned')} as input_sequence, 'provided_alignment' as input_mode,
  {when(ok, aligned_sequence=safe.format(x='g.aligned'), alignment_method="'provided_30_column_alignment'", alignment_status="'provided'", alignment_reference_ids="''", alignment_adapter_id="''", alignment_adapter_version="''", alignment_adapter_sha256="''")},
  status, case when id_error is not null then 'invalid_candidate_id' when identity is null then 'invalid_aligned_sequence' end as error_code, case when id_error is not null then id_error when identity is null then 'no_valid_sequence' end as error_message,
  '{objective}' as ranking_objective, '{C.OBJECTIVES[objective]}' as ranking_objective_definition, {when(ok, ranking_eligible="status = 'ranked'", ranking_exclusion_reason="reasons")},
  cast(k.rank as bigint) as rank, {when("status = 'ranked'", ranking_score="round(score, 9)", score_delta_from_first_log10="round(delta, 9)", score_fold_ratio_from_first="round(pow(10.0, delta), 6)", development_mae_context_log10=f"cast({mae} as double)", within_one_development_mae_of_first=f"delta <= {mae} + 1e-12", ranking_context=f"case when delta <= {mae} + 1e-12 then 'within_one_development_mae_of_first' else 'more_than_one_development_mae_from_first' end")},
  {when(ok, glp1r_log10_ec50_pm="round(glp1r, 9)", glp1r_ec50_pm="round(pow(10.0, glp1r), 6)", gcgr_log10_ec50_pm="round(gcgr, 9)", gcgr_ec50_pm="round(pow(10.0, gcgr), 6)", selectivity_log10_gcgr_over_glp1r="round(gcgr - glp1r, 9)", applicability_tier="tier", applicability_evidence_state=EVIDENCE.format(x="identity"), exact_reference_match="identity >= 1 - 1e-12", nearest_aligned_identity="round(identity, 9)", nearest_reference_ids="ids", standard_residue_count="cast(residues as integer)", duplicate_sequence_count="copies")},
  '{STAND_IN.software_version}' as software_version, '{STAND_IN.artifact_id}' as artifact_id, '{STAND_IN.artifact_version}' as artifact_version, '{STAND_IN.artifact_sha256}' as artifact_sha256, '{w["endpoint"]}' as endpoint_warning, '{w["validation"]}' as validation_warning, '{w["ranking"]}' as ranking_warning,
  row_number() over (order by status <> 'ranked', case when status = 'ranked' then score end, g.doc_id) as display_order
from g left join dup using (aligned) left join k on g.doc_id = k.doc_id"""


def _records(spark, d) -> DataFrame:
    p = T.panel(spark, d).filter("doc_id % 8 <> 0")
    cid = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("="), "peptide_id")).when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("peptide_id"))
    return p.select(F.col("doc_id").alias("input_row"), cid.alias("candidate_id"), F.col("aligned").alias("sequence"), F.lit("provided_alignment").alias("input_mode"), "aligned", F.lit("provided_30_column_alignment").alias("alignment_method"), F.lit("provided").alias("alignment_status"))


def screen(spark, d, objective: str) -> DataFrame:
    """Screened candidates of the panel, by the stand-in model; distinct sequences are scored once."""
    scored = _applicability(spark, d).select("aligned", "identity", "ids", S.linear(F.col("aligned"), 0).alias("gcgr"), S.linear(F.col("aligned"), 1).alias("glp1r"))
    return C.screen(_records(spark, d), scored, STAND_IN, objective)


for _objective in ("glp1r", "gcgr", "dual"):
    query(_screen_sql(_objective), f"screen_{_objective}")(lambda spark, d, o=_objective: screen(spark, d, o))


@query(f"select status, count(*) as n, count(distinct rank) as ranks, count(*) filter (within_one_development_mae_of_first) as within_mae from ({_screen_sql('dual')}) group by status")
def screen_counts(spark, d) -> DataFrame:
    return screen(spark, d, "dual").groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("ranks"), F.count_if("within_one_development_mae_of_first").alias("within_mae"))


@query(f"with {PANEL} {PREDICTED} select count(*) as rows_in, count(distinct aligned) as scored from panel where aligned <> repeat('-', 30) and doc_id % 8 <> 0")
def screen_distinct_cache(spark, d) -> DataFrame:
    return _valid(spark, d).filter("doc_id % 8 <> 0").groupBy("aligned").agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows_in"), F.count("*").alias("scored"))


@query("""with p as (select p_partkey, trim(regexp_replace(lower(replace(p_name, '-', ' ')), '\\s+', ' ', 'g')) as name from part),
s as (select n_nationkey, lower(n_name) as nation from nation) select n_nationkey, count(*) filter (name = nation) as exact, count(*) filter (contains(name, substr(nation, 1, 2))) as partial from s, p group by n_nationkey""")
def structure_entity_match(spark, d) -> DataFrame:
    """Entities matched to names: exactly, else by a part of the name. Names are the nations, a fixed and small table."""
    part = T.table(spark, d, "part").select(S.squeeze(F.col("p_name")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    nation = T.table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("nation"))
    both = part.join(F.broadcast(nation))
    return both.groupBy("n_nationkey").agg(F.sum(F.when(F.col("name") == F.col("nation"), F.col("n")).otherwise(0)).alias("exact"), F.sum(F.when(F.contains("name", F.substring("nation", 1, 2)), F.col("n")).otherwise(0)).alias("partial"))


ALIGNED = PANEL + """,
refs as materialized (select distinct rpad(substr(regexp_replace(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '[BJOUXZ]', '', 'g'), 1, 30), 30, '-') as r from benchmark),
raws as materialized (select distinct replace(aligned, '-', '') as raw from panel where aligned <> repeat('-', 30)),
grow as (select raw, '' as s, 0 as i from raws where length(raw) >= 26
  union select raw, s || if(take, substr(raw, i + 1, 1), '-'), i + take::int from grow, (select unnest([true, false]) as take) where length(s) < 30 and if(take, i < length(raw), length(s) - i < 30 - length(raw))),
costs as (select raw, s, min(hamming(s, r)) as h from grow, refs where length(s) = 30 and r <> repeat('-', 30) group by raw, s),
least as (select raw, min(h) as h from costs group by raw),
hits as (select raw, count(*) as hits, min(s) as s from costs join least using (raw, h) group by raw),
gaps as (select raw, r, hits, s, hamming(s, r) as h, len(list_filter(range(1, 31), lambda k: s[k] = '-' and r[k] = '-')) as blank from hits, refs where r <> repeat('-', 30)),
near as (select raw, any_value(hits) as hits, any_value(s) as s, max((30 - h - blank) / (30 - blank)::double) as identity from gaps group by raw),
fate as (select raw, s, case when length(raw) < 26 then 'invalid' when hits > 1 then 'ambiguous' when hits is null or identity < 0.85 then 'too_far' when length(raw) = 30 then 'direct' else 'mapped_unambiguously' end as status from raws left join near using (raw))"""


@query(f"with recursive {ALIGNED} select peptide_id, raw, case when status in ('direct', 'mapped_unambiguously') then s end as aligned, status from (select peptide_id, replace(aligned, '-', '') as raw from panel where aligned <> repeat('-', 30)) join fate using (raw)")
def raw_alignment(spark, d) -> DataFrame:
    """Raw sequences of 26 to 30 residues projected on all of the benchmark's references. Distinct sequences meet the distinct references in blocks; both are dealt by hashes."""
    refs = T.table(spark, d, "benchmark").select(S.aligned_from_text(F.col("text")).alias("aligned")).filter(F.col("aligned") != S.ALL_GAP).distinct()
    raw = _valid(spark, d).select("peptide_id", F.replace("aligned", F.lit("-"), F.lit("")).alias("raw"))
    return raw.join(A.prepared(raw.select("raw").distinct(), refs), "raw").select("peptide_id", "raw", "aligned", "status")
