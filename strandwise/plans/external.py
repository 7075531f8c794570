"""Queries over held-out rows: dependency groups, locked predictions, prediction rows, receipts and JSON access.

Development rows are the panel's with doc_id % 8 = 0, all others are external.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions import sequences as S
from strandwise.operators import align as A
from strandwise.operators import blocks as B
from strandwise.operators import graph as G
from strandwise.operators import identity as I
from strandwise.operators import metrics as M
from strandwise.operators import predict as D
from strandwise.operators import ridge as R
from strandwise.operators import screening as C
from strandwise.operators.selection import exact_quantiles
from strandwise.plans import panel as P
from strandwise.plans.base import IDENTITY, MEASURED, PANEL, query
from strandwise.sources import sinks
from strandwise.sources import tables as T

NEAR, SAME = 0.70, 0.85
#: References that an artifact holds itself; more of them lie in files beside it.
INSIDE = 20_000

_EDGES = "select a as x, b as y from near where identity + 1e-12 >= 0.85 and {a} and {b} union all select b, a from near where identity + 1e-12 >= 0.85 and {a} and {b}"
GROUPS = f"""with recursive {PANEL}, px as (select * from panel where aligned <> repeat('-', 30)),
cls as materialized (select aligned, min(peptide_id) as rep, 30 - length(replace(aligned, '-', '')) as gaps, bool_or(doc_id % 8 <> 0) as ext, bool_or(doc_id % 8 = 0) as dev from px group by aligned),
scored as (select a.rep as a, b.rep as b, a.ext as ea, a.dev as da, b.ext as eb, b.dev as db, {IDENTITY.format(a='a', b='b')} as identity from cls a join cls b on a.rep < b.rep),
near as materialized (select * from scored where identity + 1e-12 >= 0.70),
ee as materialized ({_EDGES.format(a='ea', b='eb')}), de as materialized ({_EDGES.format(a='da', b='db')}),
er as (select rep as x, rep as y from cls where ext union select er.x, ee.y from er join ee on er.y = ee.x),
ec as materialized (select x as rep, min(y) as ec from er group by x),
dr as (select rep as x, rep as y from cls where dev union select dr.x, de.y from dr join de on dr.y = de.x),
dc as materialized (select x as rep, min(y) as dc from dr group by x),
touch as materialized (select cls.rep, dc from cls join dc on cls.rep = dc.rep where ext union select a, dc from near join dc on dc.rep = b where ea and db union select b, dc from near join dc on dc.rep = a where eb and da),
link as materialized (select rep as x, 'EC:' || ec as y from ec union select rep, 'DC:' || dc from touch),
sym as materialized (select x, y from link union select y, x from link),
lr as (select rep as x, rep as y from ec union select lr.x, sym.y from lr join sym on lr.y = sym.x),
lc as materialized (select x as rep, min(y) filter (y like 'seq_pep%') as lc from lr group by x),
member as materialized (select p.doc_id, p.peptide_id, cls.rep, ec, lc from px p join cls on p.aligned = cls.aligned join ec on ec.rep = cls.rep join lc on lc.rep = cls.rep where p.doc_id % 8 <> 0),
en as materialized (select ec, count(*) as size, min(doc_id) as first, 'EC' || printf('%03d', row_number() over (order by min(doc_id))) as id from member group by ec),
ln as materialized (select lc, 'LC' || printf('%03d', row_number() over (order by min(doc_id))) as id from member group by lc)"""


def _classes(spark, d) -> DataFrame:
    """aligned, rep, and whether external or development rows have the sequence."""
    p = T.panel(spark, d).filter(F.col("aligned") != S.ALL_GAP)
    return G.cut(p.groupBy("aligned").agg(F.min("peptide_id").alias("rep"), F.bool_or(F.col("doc_id") % 8 != 0).alias("ext"), F.bool_or(F.col("doc_id") % 8 == 0).alias("dev")))


def _members(spark, d) -> tuple[DataFrame, DataFrame]:
    """(external rows with the roots of their components and linked components, links of external classes to development components)."""
    cls = _classes(spark, d)
    ext, dev = G.cut(cls.filter("ext").select("aligned", "rep")), G.cut(cls.filter("dev").select("aligned", "rep"))
    same = lambda side: I.forest(side, [SAME]).filter("a is not null").select("a", "b")
    ec = G.cut(G.rooted(ext.select("rep"), same(ext), "rep").withColumnRenamed("root", "ec"))
    dc = G.cut(G.rooted(dev, same(dev), "rep").select("aligned", F.col("root").alias("group")))
    touch = G.cut(B.reached(ext, dc, NEAR).withColumnRenamed("group", "dc"))
    # a group's node stands between its members, so that no pair of them is made
    links = ec.select(F.col("rep").alias("a"), F.concat(F.lit("EC:"), "ec").alias("b")).unionByName(touch.select(F.col("rep").alias("a"), F.concat(F.lit("DC:"), "dc").alias("b")))
    linked = G.rooted(ec, links, "rep")
    first = linked.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("lc"))
    groups = G.cut(linked.join(first, F.col("root") == F.col("r")).select("rep", "ec", "lc"))
    ext = T.panel(spark, d).filter("doc_id % 8 <> 0").select("doc_id", "peptide_id", "aligned")
    return G.cut(ext.join(cls.select("aligned", "rep"), "aligned").join(groups, "rep").select("doc_id", "peptide_id", "rep", "ec", "lc")), touch


def _named(members: DataFrame, key: str, prefix: str) -> DataFrame:
    """Each group with its size, first row and name: numbered by the smallest number of a member."""
    g = members.groupBy(key).agg(F.count("*").alias("size"), F.min("doc_id").alias("first"))
    return G.global_rank(g, [F.asc("first")], "__n").withColumn("id", F.format_string(prefix + "%03d", "__n")).drop("__n")


@query(f"{GROUPS} select id as component_id, size, first as first_doc from en")
def external_components(spark, d) -> DataFrame:
    members, _ = _members(spark, d)
    return _named(members, "ec", "EC").select(F.col("id").alias("component_id"), "size", F.col("first").alias("first_doc"))


@query(f"{GROUPS}, tn as (select rep, count(*) as n from touch group by rep) select peptide_id, en.id as component_id, ln.id as linked_id, coalesce(n, 0) as development_components from member join en on member.ec = en.ec join ln on member.lc = ln.lc left join tn on tn.rep = member.rep")
def linked_components(spark, d) -> DataFrame:
    """External rows are linked if they share a component, or their sequences reach one development component at 0.70."""
    members, touch = _members(spark, d)
    ec, lc = _named(members, "ec", "EC").select("ec", F.col("id").alias("component_id")), _named(members, "lc", "LC").select("lc", F.col("id").alias("linked_id"))
    reached = touch.groupBy("rep").agg(F.count("*").alias("n"))
    return members.join(ec, "ec").join(lc, "lc").join(reached, "rep", "left").select("peptide_id", "component_id", "linked_id", F.coalesce("n", F.lit(0)).alias("development_components"))


LOCKED = MEASURED + f""", dev as materialized (select * from m where doc_id % 8 = 0),
dn as materialized (select aligned, gaps, count(*) as n, sum(y1) as s1, sum(y2) as s2 from dev group by all),
q as materialized (select distinct aligned, 30 - length(replace(aligned, '-', '')) as gaps from panel where doc_id % 8 <> 0 and aligned <> repeat('-', 30)),
sc as materialized (select q.aligned, n, s1, s2, {IDENTITY.format(a='q', b='dn')} as identity from q, dn),
top as (select aligned, max(identity) as best from sc group by aligned),
nn as materialized (select sc.aligned, sum(s1) / sum(n) as a, sum(s2) / sum(n) as b from sc join top on sc.aligned = top.aligned and identity >= best - 1e-12 group by sc.aligned),
c as (select avg(y1) as a, avg(y2) as b from dev group by source), g as (select peptide_id, aligned from panel where doc_id % 8 <> 0 and aligned <> repeat('-', 30)),
guess as (select peptide_id, 'nn' as model, a, b from g join nn on g.aligned = nn.aligned
  union all select peptide_id, 'median', (select median(y1) from dev), (select median(y2) from dev) from g union all select peptide_id, 'component_mean', (select avg(a) from c), (select avg(b) from c) from g)"""


def _development(spark, d) -> DataFrame:
    return T.measured(spark, d).filter("doc_id % 8 = 0")


@query(f"with {LOCKED} select peptide_id, model, round(a, 6) as gcgr, round(b, 6) as glp1r, round(a - b, 6) as selectivity from guess")
def locked_baselines(spark, d) -> DataFrame:
    """External predictions of the tied nearest neighbours, the median and the component-balanced mean of development rows."""
    dev = _development(spark, d)
    donors = dev.groupBy("aligned").agg(F.min("peptide_id").alias("first_id"), F.count("*").alias("n"), F.sum("y1").alias("s1"), F.sum("y2").alias("s2")).withColumn("fold", F.lit(None).cast("int"))
    ext = T.panel(spark, d).filter((F.col("doc_id") % 8 != 0) & (F.col("aligned") != S.ALL_GAP)).select("peptide_id", "aligned")
    nn = I.nearest(ext.withColumn("fold", F.lit(None).cast("int")), donors).select("aligned", F.lit("nn").alias("model"), (F.col("s1") / F.col("ties")).alias("a"), (F.col("s2") / F.col("ties")).alias("b"))
    medians = exact_quantiles(dev, ["y1", "y2"], [0.5]).get(None, [[None], [None]])
    median = spark.createDataFrame([(*(x[0] for x in medians), "median")], "a double, b double, model string")
    mean = M.balanced_mean(dev, "source", ["y1", "y2"]).select(F.col("y1").alias("a"), F.col("y2").alias("b"), F.lit("component_mean").alias("model"))
    fixed = ext.join(F.broadcast(median.unionByName(mean))).select("peptide_id", "model", "a", "b")  # two rows
    both = ext.join(nn, "aligned").select("peptide_id", "model", "a", "b").unionByName(fixed)
    return both.select("peptide_id", "model", F.round("a", 6).alias("gcgr"), F.round("b", 6).alias("glp1r"), F.round(F.col("a") - F.col("b"), 6).alias("selectivity"))


@query()
def locked_ridge(spark, d) -> DataFrame:
    """External predictions of the ridge refitted on all development rows, at the alpha with the least held-out error."""
    dev = _development(spark, d)
    fits = R.Fits(dev, "source", outer=False)
    ext = T.panel(spark, d).filter((F.col("doc_id") % 8 != 0) & (F.col("aligned") != S.ALL_GAP))
    p = R.predicted(ext, fits.models(fits.selected()), F.lit(True))  # one model
    return p.select("peptide_id", "alpha", F.round("gcgr", 6).alias("gcgr"), F.round("glp1r", 6).alias("glp1r"), F.round(F.col("gcgr") - F.col("glp1r"), 6).alias("selectivity"))


def _fitted(spark, d) -> tuple[DataFrame, dict, dict[str, float]]:
    """(development rows, the model fitted on all of them, mean absolute errors of the models of the outer folds)."""
    dev = G.cut(_development(spark, d))
    fits = R.Fits(dev, "source")
    models = G.cut(fits.models(fits.selected()))
    oof = R.predicted(dev, models.filter(F.col("held") != R.ALL), F.col("fold") == F.col("held"))
    mae = oof.agg(F.avg(F.abs(F.col("gcgr") - F.col("y1"))).alias("gcgr"), F.avg(F.abs(F.col("glp1r") - F.col("y2"))).alias("glp1r")).first().asDict()
    return dev, models.filter(F.col("held") == R.ALL).first().asDict(), mae


@query()
def screen_fitted(spark, d) -> DataFrame:
    """External candidates screened by the ridge that development rows fit, with its own out-of-fold errors as context."""
    dev, model, mae = _fitted(spark, d)
    digest = hashlib.sha256(json.dumps({k: model[k] for k in ("alpha", "w1", "w2", "c1", "c2")}, sort_keys=True).encode()).hexdigest()
    donors = dev.groupBy("aligned").agg(F.min("peptide_id").alias("first_id"), F.count("*").alias("n")).withColumns({"fold": F.lit(None).cast("int"), "s1": F.lit(0.0), "s2": F.lit(0.0)})
    records = P._records(spark, d)
    near = I.nearest(records.filter(F.col("aligned") != S.ALL_GAP).select("aligned", F.lit(None).cast("int").alias("fold")), donors).select("aligned", "identity", "ids")
    one = spark.createDataFrame([(R.ALL, model["alpha"], model["w1"], model["w2"], model["c1"], model["c2"], [], [])], "held int, alpha double, w1 array<double>, w2 array<double>, c1 double, c2 double, mx array<double>, my array<double>")
    scored = R.predicted(near, one, F.lit(True)).select("aligned", "identity", "ids", "gcgr", "glp1r")
    return C.screen(records, scored, C.Model("fitted-ridge", "1", digest, mae), "dual")


def _artifact(spark, d) -> D.Predictor:
    """The fitted ridge, written as an artifact into the shared folder and read again by its checksum."""
    dev, model, mae = _fitted(spark, d)
    folder = G.shared_folder(spark, "artifact")
    receipt = sinks.write_artifact(spark, folder, model, dev.select("peptide_id", "aligned"), "component-ridge", "1", {}, beside=INSIDE)
    aligner = hashlib.sha256(json.dumps({"references": receipt["artifact_sha256"], "least": A.LEAST, "identity": SAME}, sort_keys=True).encode()).hexdigest()
    return D.load(spark, f"{folder}/model.json", mae, receipt["artifact_sha256"], adapter=("reference-projection", "1", aligner), endpoint_warning="cell-based potency estimate", validation_warning="out-of-fold errors of development rows")


def _requests(spark, d) -> DataFrame:
    """External rows as requests: two of three are raw, and cut by up to four residues at the end."""
    p = T.panel(spark, d).filter("doc_id % 8 <> 0")
    bare = F.replace("aligned", F.lit(S.GAP), F.lit(""))
    raw = F.col("doc_id") % 3 != 0
    cut_off = F.expr("substring(bare, 1, greatest(length(bare) - cast(doc_id % 5 as int), 0))")
    p = p.withColumn("bare", bare)
    return p.select((F.col("doc_id") + 1).alias("input_row"), F.col("peptide_id").alias("candidate_id"), F.when(raw, cut_off).otherwise(F.col("aligned")).alias("sequence"), F.when(raw, "raw_sequence").otherwise("aligned_sequence").alias("input_mode"))


@query()
def artifact_predictions(spark, d) -> DataFrame:
    """All fields of the flat prediction of every external row, raw or aligned, by an artifact that was written and read again."""
    found = _artifact(spark, d).predictions(_requests(spark, d), "candidate_id")
    return found.select(*(F.round(f.name, 9).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in found.schema.fields))


@query()
def artifact_screening(spark, d) -> DataFrame:
    """External rows, raw or aligned, through alignment, prediction and screening by an artifact that was written and read again."""
    return _artifact(spark, d).screened(_requests(spark, d), "dual")


PREDICTION = f"""with {P.BEST} {P.PREDICTED} select p.peptide_id, round(gcgr, 6) as gcgr, round(glp1r, 6) as glp1r, round(gcgr - glp1r, 6) as selectivity, {P.DIRECTION.format(s='round(gcgr - glp1r, 9)')} as direction, round(identity, 9) as identity, ties, nearest,
 {P.TIER.format(x='identity')} as tier, {P.EVIDENCE.format(x='identity')} as evidence, identity >= 0.85 and length(replace(p.aligned, '-', '')) >= 26 as ranking_eligible,
 concat_ws('; ', case when identity < 0.85 then 'identity_below_0.85' end, case when length(replace(p.aligned, '-', '')) < 26 then 'fewer_than_26_residues' end) as exclusion_reasons
 from panel p join app using (aligned) join lin using (aligned) where p.doc_id % 8 <> 0"""


@query(PREDICTION)
def prediction_rows(spark, d) -> DataFrame:
    """The flat prediction of each query: scores, applicability and why it isn't ranked. Distinct sequences are scored once."""
    scored = P._applicability(spark, d)
    a = F.col("aligned")
    x, y, best, few = S.linear(a, 0), S.linear(a, 1), F.col("identity"), S.residues(a) < 26
    document = F.struct(F.round(x, 6).alias("gcgr"), F.round(y, 6).alias("glp1r"), F.round(x - y, 6).alias("selectivity"), S.direction(F.round(x - y, 9)).alias("direction"), F.round(best, 9).alias("identity"), "ties", F.col("first_id").alias("nearest"), S.tier(best).alias("tier"), S.evidence(best).alias("evidence"), ((best >= SAME) & ~few).alias("ranking_eligible"), F.concat_ws("; ", F.when(best < SAME, "identity_below_0.85"), F.when(few, "fewer_than_26_residues")).alias("exclusion_reasons"))
    rows = P._valid(spark, d).filter("doc_id % 8 <> 0").select("peptide_id", "aligned").join(scored.select("aligned", document.alias("p")), "aligned")
    return rows.select("peptide_id", "p.*")


@query(f"with s as ({P._screen_sql('dual')}), n as (select count(*) as rows_in, count(*) filter (status = 'ranked') as ranked, count(*) filter (status = 'not_ranked_out_of_scope') as out_of_scope, count(*) filter (status = 'input_error') as input_errors, count(distinct rank) as ranks from s) select *, case when ranked = 0 then 'no_rankable_rows' when input_errors > 0 then 'completed_with_row_errors' else 'completed' end as status, case when ranked = 0 then 3 when input_errors > 0 then 1 else 0 end as exit_code from n")
def screen_receipt(spark, d) -> DataFrame:
    return sinks.receipt(P.screen(spark, d, "dual"))


@query(f"with {PANEL}, r as (select * from panel where doc_id % 8 = 0 and aligned <> repeat('-', 30)) select 30 as aligned_length, '-ACDEFGHIKLMNPQRSTVWY' as alphabet, 630 as features, count(*) as reference_rows, count(distinct aligned) as reference_sequences, count(distinct source) as components from r")
def model_info(spark, d) -> DataFrame:
    r = P._valid(spark, d).filter("doc_id % 8 = 0")
    n = r.agg(F.count("*").alias("reference_rows"), F.countDistinct("aligned").alias("reference_sequences"), F.countDistinct("source").alias("components"))
    return n.select(F.lit(S.LENGTH).alias("aligned_length"), F.lit(S.ALPHABET).alias("alphabet"), F.lit(R.FEATURES).alias("features"), "*")


@query("select event_type, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), -1) % 10 as k, count(*) as n, count(*) filter (json_extract_string(props, '$.absent.field') is null) as defaults from events group by all")
def json_access(spark, d) -> DataFrame:
    """Nested fields with defaults for what a document lacks."""
    e = T.table(spark, d, "events").select("event_type", F.from_json("props", "k long, absent struct<field:string>").alias("p"))
    return e.groupBy("event_type", (F.coalesce("p.k", F.lit(-1).cast("long")) % 10).alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("p.absent.field").isNull()).alias("defaults"))
