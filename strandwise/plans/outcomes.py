"""Queries over measured targets and replicate outcomes: baselines, metrics, censored losses, resampling, ridge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions import sequences as S
from strandwise.operators import graph as G
from strandwise.operators import identity as I
from strandwise.operators import metrics as M
from strandwise.operators import ridge as R
from strandwise.operators.resample import intervals, resampled
from strandwise.operators.selection import exact_quantiles
from strandwise.plans.base import IDENTITY, MEASURED, query
from strandwise.sources import tables as T

# ------------------------------------------------------------------ baselines over measured rows

NN = MEASURED + f""",
cl as materialized (select aligned, gaps, fold, count(*) as n, sum(y1) as s1, sum(y2) as s2, min(peptide_id) as first_id from m group by all),
sc as materialized (select q.aligned, q.fold, x.n, x.s1, x.s2, x.first_id, {IDENTITY.format(a='q', b='x')} as identity from cl q join cl x on q.fold <> x.fold),
top as (select aligned, fold, max(identity) as best from sc group by all),
nn as materialized (select top.aligned, top.fold, best, cast(sum(n) as bigint) as ties, sum(s1) / sum(n) as nn1, sum(s2) / sum(n) as nn2, min(first_id) as first_id, string_agg(first_id, ';' order by first_id) as donors from top join sc on top.aligned = sc.aligned and top.fold = sc.fold and sc.identity >= best - 1e-12 group by all),
oof as materialized (select m.*, best, ties, nn1, nn2, first_id, donors from m join nn on m.aligned = nn.aligned and m.fold = nn.fold)"""


def _oof(spark, d) -> DataFrame:
    m = G.cut(T.measured(spark, d))
    donors = m.groupBy("aligned", "fold").agg(F.min("peptide_id").alias("first_id"), F.count("*").alias("n"), F.sum("y1").alias("s1"), F.sum("y2").alias("s2"))
    best = I.nearest(m, donors).select("aligned", "fold", F.col("identity").alias("best"), "ties", (F.col("s1") / F.col("ties")).alias("nn1"), (F.col("s2") / F.col("ties")).alias("nn2"), "first_id", F.array_join("ids", ";").alias("donors"))
    return m.join(best, ["aligned", "fold"])


@query(f"with {NN} select peptide_id, fold, round(best, 9) as identity, ties, first_id, donors, round(nn1, 6) as nn_gcgr, round(nn2, 6) as nn_glp1r, round(nn1 - nn2, 6) as nn_selectivity from oof")
def tied_nn_oof(spark, d) -> DataFrame:
    return _oof(spark, d).select("peptide_id", "fold", F.round("best", 9).alias("identity"), "ties", "first_id", "donors", F.round("nn1", 6).alias("nn_gcgr"), F.round("nn2", 6).alias("nn_glp1r"), F.round(F.col("nn1") - F.col("nn2"), 6).alias("nn_selectivity"))


@query(f"with {NN} select fold, count(*) as n, round(min(best), 9) as least_identity, round(max(best), 9) as greatest_identity, count(*) filter (ties > 1) as tied from oof group by fold")
def nearest_summary(spark, d) -> DataFrame:
    return _oof(spark, d).groupBy("fold").agg(F.count("*").alias("n"), F.round(F.min("best"), 9).alias("least_identity"), F.round(F.max("best"), 9).alias("greatest_identity"), F.count_if(F.col("ties") > 1).alias("tied"))


@query(f"with {MEASURED} select f.fold, round(median(m.y1), 6) as median_gcgr, round(median(m.y2), 6) as median_glp1r, round(median(m.sel), 6) as median_selectivity from (select distinct fold from m) f join m on m.fold <> f.fold group by f.fold")
def fold_median_oof(spark, d) -> DataFrame:
    """Exact medians of each fold's complement, by order statistics of the other folds' counts."""
    found = exact_quantiles(T.measured(spark, d), ["y1", "y2", "sel"], [0.5], by="fold", complements=True)
    rows = [(int(fold), *(x[0] for x in lines)) for fold, lines in found.items() if lines[0][0] is not None]
    medians = spark.createDataFrame(rows, "fold int, y1 double, y2 double, sel double")  # a row for each fold
    return medians.select("fold", *(F.round(c, 6).alias(f"median_{n}") for c, n in (("y1", "gcgr"), ("y2", "glp1r"), ("sel", "selectivity"))))


LONG = NN + """,
long as materialized (select 'nn' as model, 'gcgr' as endpoint, fold, source, y1 as actual, nn1 as guess from oof union all select 'nn', 'glp1r', fold, source, y2, nn2 from oof union all select 'nn', 'selectivity', fold, source, sel, nn1 - nn2 from oof
  union all select 'constant', 'gcgr', fold, source, y1, 5.0 from oof union all select 'constant', 'glp1r', fold, source, y2, 4.5 from oof union all select 'constant', 'selectivity', fold, source, sel, 0.5 from oof)"""


def _long(spark, d) -> DataFrame:
    cols = "stack(6, 'nn', 'gcgr', y1, nn1, 'nn', 'glp1r', y2, nn2, 'nn', 'selectivity', sel, nn1 - nn2, 'constant', 'gcgr', y1, 5.0D, 'constant', 'glp1r', y2, 4.5D, 'constant', 'selectivity', sel, 0.5D) as (model, endpoint, actual, guess)"
    return _oof(spark, d).selectExpr("fold", "source", cols)


def _metric_sql(by: str) -> str:
    return f"""with {LONG} select {by}, count(*) as n, round(avg(abs(guess - actual)), 6) as mae, round(sqrt(avg((guess - actual) ** 2)), 6) as rmse, round(pow(10.0, avg(abs(guess - actual))), 3) as fold_error,
round(case when min(actual) <> max(actual) then 1 - sum((guess - actual) ** 2) / (sum(actual * actual) - sum(actual) * sum(actual) / count(*)) end, 5) as r2, round(case when min(actual) <> max(actual) and min(guess) <> max(guess) then corr(actual, guess) end, 6) as pearson from long group by {by}"""


def _metrics(spark, d, by: list[str]) -> DataFrame:
    m = M.point_metrics(_long(spark, d), by)
    return m.select(*by, "n", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), F.round("fold_error", 3).alias("fold_error"), F.round("r2", 5).alias("r2"), F.round("pearson", 6).alias("pearson"))


@query(_metric_sql("model, endpoint"))
def point_metrics(spark, d) -> DataFrame:
    return _metrics(spark, d, ["model", "endpoint"])


@query(_metric_sql("model, endpoint, fold"))
def fold_metrics(spark, d) -> DataFrame:
    return _metrics(spark, d, ["model", "endpoint", "fold"])


@query(f"""with {LONG}, r as (select model, endpoint, rank() over (partition by model, endpoint order by actual) + (count(*) over (partition by model, endpoint, actual) - 1) / 2.0 as ra, rank() over (partition by model, endpoint order by guess) + (count(*) over (partition by model, endpoint, guess) - 1) / 2.0 as rg from long)
select model, endpoint, round(case when min(rg) <> max(rg) then corr(ra, rg) end, 6) as spearman from r group by all""")
def spearman_avg_rank(spark, d) -> DataFrame:
    return M.spearman(_long(spark, d), ["model", "endpoint"]).withColumn("spearman", F.round("spearman", 6))


@query(f"with {MEASURED}, c as (select source, count(*) as rows_in from m group by source) select source, rows_in, round((select sum(rows_in) from c) / (select count(*) from c) / rows_in, 9) as weight from c")
def component_weights(spark, d) -> DataFrame:
    return M.component_weights(T.measured(spark, d), "source").withColumn("weight", F.round("weight", 9))


@query(f"with {MEASURED}, c as (select source, avg(y1) as a, avg(y2) as b from m group by source) select round(avg(a), 6) as y1, round(avg(b), 6) as y2 from c")
def component_balanced_mean(spark, d) -> DataFrame:
    return M.balanced_mean(T.measured(spark, d), "source", ["y1", "y2"]).select(F.round("y1", 6).alias("y1"), F.round("y2", 6).alias("y2"))


@query(f"with {LONG}, c as (select model, endpoint, source, avg(abs(guess - actual)) as e from long group by all) select model, endpoint, count(*) as components, round(avg(e), 6) as macro_mae from c group by all")
def component_macro_mae(spark, d) -> DataFrame:
    return M.macro_mae(_long(spark, d), ["model", "endpoint"], "source", F.col("guess") - F.col("actual")).withColumn("macro_mae", F.round("macro_mae", 6))


# ------------------------------------------------------------------ replicates and censored outcomes

REPS = """li as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as rn, count(*) over (partition by l_orderkey) as n from lineitem),
rep as (select l_orderkey as id, case when rn <= 3 then 'gcgr' else 'glp1r' end as receptor, cast((rn - 1) % 3 + 1 as integer) as replicate, case when l_returnflag = 'R' then 'right_censored' else 'observed' end as status, cast(cast(l_extendedprice as decimal(18,2)) as double) as v from li where rn <= 3 and n >= 3 or rn between 4 and 6 and n >= 6),
agg as (select id, receptor, case when count(*) filter (status = 'right_censored') > 0 then 'lower_bound' else 'exact' end as status, log10(avg(v)) as value, count(*) filter (status = 'observed') as observed, count(*) filter (status = 'right_censored') as censored from rep group by all),
wide as (select g.id, g.status as gs, g.value as gv, h.status as hs, h.value as hv from (select * from agg where receptor = 'gcgr') g left join (select * from agg where receptor = 'glp1r') h on g.id = h.id),
ep as (select id, 'gcgr' as endpoint, gs as status, gv as value from wide union all select id, 'glp1r', hs, hv from wide where hs is not null
  union all select id, 'selectivity', case when gs = 'exact' and hs = 'exact' then 'exact' when gs = 'lower_bound' and hs = 'exact' then 'lower_bound' when gs = 'exact' then 'upper_bound' else 'uninformative' end, case when gs = 'exact' or hs = 'exact' then gv - hv end from wide where hs is not null)"""
_MODELS = " union all ".join(f"select id, '{m}' as model, {b} + (id * {f} % {mod}) / cast({div} as double) as gcgr from ids" for m, (b, f, mod, div) in T.MODELS.items())
LOSSES = REPS + f""",
ids as (select distinct id from wide), pm as ({_MODELS}), p2 as (select *, gcgr + 0.3 + (id % 4) / 10.0 as glp1r from pm),
pred as (select id, model, 'gcgr' as endpoint, gcgr as guess from p2 union all select id, model, 'glp1r', glp1r from p2 union all select id, model, 'selectivity', gcgr - glp1r from p2),
loss as materialized (select ep.id, ep.id % 7 as component, case ep.id % 3 when 0 then 'dual' when 1 then 'gcgr_selective' else 'glp1r_selective' end as design_group, model, ep.endpoint, status, value, guess,
  case status when 'exact' then abs(guess - value) when 'lower_bound' then greatest(0.0, value - guess) when 'upper_bound' then greatest(0.0, guess - value) end as loss from ep join pred on ep.id = pred.id and ep.endpoint = pred.endpoint)"""


def _parsed(spark, d) -> DataFrame:
    r = T.replicates(spark, d)
    status, value, threshold = S.parse_replicate(F.col("cell"), F.col("is_text"))
    return r.select("id", "receptor", "replicate", status.alias("status"), value.alias("value_pm"), threshold.alias("threshold_pm"))


@query(f"with {REPS} select id, receptor, replicate, status, case when status = 'observed' then v end as value_pm, case when status = 'right_censored' then v end as threshold_pm from rep")
def parse_replicates(spark, d) -> DataFrame:
    return _parsed(spark, d)


def _aggregated(spark, d) -> DataFrame:
    censored = F.count_if(F.col("status") == "right_censored")
    return _parsed(spark, d).groupBy("id", "receptor").agg(F.when(censored > 0, "lower_bound").otherwise("exact").alias("status"), F.log10(F.avg(F.coalesce("value_pm", "threshold_pm"))).alias("value"), F.count_if(F.col("status") == "observed").alias("observed"), censored.alias("censored"))


@query(f"with {REPS} select id, receptor, status, round(value, 6) as value, observed, censored from agg")
def aggregate_replicates(spark, d) -> DataFrame:
    return _aggregated(spark, d).withColumn("value", F.round("value", 6))


@query(f"with {REPS} select id, receptor, case when bool_and(status = 'observed') then round(avg(v), 4) end as exact_mean from rep group by all")
def exact_mean(spark, d) -> DataFrame:
    return _parsed(spark, d).groupBy("id", "receptor").agg(F.when(F.bool_and(F.col("status") == "observed"), F.round(F.avg("value_pm"), 4)).alias("exact_mean"))


def _endpoints(spark, d) -> DataFrame:
    """id, endpoint, status and value: the receptors it has and the difference of two, in one pass over the aggregate."""
    a = _aggregated(spark, d)
    of = lambda r, c: F.max(F.when(F.col("receptor") == r, F.col(c)))
    w = a.groupBy("id").agg(of("gcgr", "status").alias("gs"), of("gcgr", "value").alias("gv"), of("glp1r", "status").alias("hs"), of("glp1r", "value").alias("hv"))
    ge, he = F.col("gs") == "exact", F.col("hs") == "exact"
    w = w.withColumns({"ss": F.when(ge & he, "exact").when(he, "lower_bound").when(ge, "upper_bound").otherwise("uninformative"), "sv": F.when(ge | he, F.col("gv") - F.col("hv"))})
    w = w.withColumn("ss", F.when(F.col("hs").isNotNull(), F.col("ss")))
    return w.selectExpr("id", "stack(3, 'gcgr', gs, gv, 'glp1r', hs, hv, 'selectivity', ss, sv) as (endpoint, status, value)").filter("status is not null")


@query(f"with {REPS} select id, status, round(value, 6) as value from ep where endpoint = 'selectivity'")
def selectivity_interval(spark, d) -> DataFrame:
    return _endpoints(spark, d).filter("endpoint = 'selectivity'").select("id", "status", F.round("value", 6).alias("value"))


def _losses(spark, d) -> DataFrame:
    """A row for each id, endpoint and model; null losses where nothing was learned."""
    e = _endpoints(spark, d)
    p = T.predictions(e.select("id").distinct()).selectExpr("id", "model", "stack(3, 'gcgr', gcgr, 'glp1r', glp1r, 'selectivity', gcgr - glp1r) as (endpoint, guess)")
    group = F.when(F.col("id") % 3 == 0, "dual").when(F.col("id") % 3 == 1, "gcgr_selective").otherwise("glp1r_selective")
    return e.join(p, ["id", "endpoint"]).select("id", (F.col("id") % 7).alias("component"), group.alias("design_group"), "model", "endpoint", "status", "value", "guess", S.constraint_loss(F.col("status"), F.col("value"), F.col("guess")).alias("loss"))


@query(f"with {LOSSES} select id, model, endpoint, status, round(loss, 6) as loss from loss")
def constraint_loss(spark, d) -> DataFrame:
    return _losses(spark, d).select("id", "model", "endpoint", "status", F.round("loss", 6).alias("loss"))


@query(f"with {LOSSES} select rep.id, rep.receptor, rep.replicate, p2.model, round(case when status = 'observed' then abs(g - log10(v)) else greatest(0.0, log10(v) - g) end, 6) as loss from rep join (select id, model, 'gcgr' as receptor, gcgr as g from p2 union all select id, model, 'glp1r', glp1r from p2) p2 on rep.id = p2.id and rep.receptor = p2.receptor")
def replicate_sensitivity(spark, d) -> DataFrame:
    r = _parsed(spark, d)
    p = T.predictions(r.select("id").distinct()).selectExpr("id", "model", "stack(2, 'gcgr', gcgr, 'glp1r', glp1r) as (receptor, g)")
    return r.join(p, ["id", "receptor"]).select("id", "receptor", "replicate", "model", F.round(S.censor_loss(F.col("status"), F.log10(F.coalesce("value_pm", "threshold_pm")), F.col("g")), 6).alias("loss"))


@query(f"with {LOSSES} select model, endpoint, count(loss) as informative, count(*) as n, round(avg(loss), 6) as mean_loss from loss group by all")
def endpoint_loss_summary(spark, d) -> DataFrame:
    return _losses(spark, d).groupBy("model", "endpoint").agg(F.count("loss").alias("informative"), F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("mean_loss"))


@query(f"with {LOSSES}, x as (select model, endpoint, count(*) as n_exact, round(avg(abs(guess - value)), 6) as mae from loss where status = 'exact' group by all) select l.model, l.endpoint, coalesce(n_exact, 0) as n_exact, mae from (select distinct model, endpoint from loss) l left join x on l.model = x.model and l.endpoint = x.endpoint")
def complete_case_metrics(spark, d) -> DataFrame:
    exact = F.col("status") == "exact"
    return _losses(spark, d).groupBy("model", "endpoint").agg(F.count_if(exact).alias("n_exact"), F.round(F.avg(F.when(exact, F.abs(F.col("guess") - F.col("value")))), 6).alias("mae"))


@query(f"with {LOSSES} select model, endpoint, count(*) filter (status in ('lower_bound', 'upper_bound')) as bounds, round(avg(case when status in ('lower_bound', 'upper_bound') then cast(loss = 0 as integer) end), 6) as satisfied from loss group by all")
def bound_satisfaction(spark, d) -> DataFrame:
    bound = F.col("status").isin("lower_bound", "upper_bound")
    return _losses(spark, d).groupBy("model", "endpoint").agg(F.count_if(bound).alias("bounds"), F.round(F.avg(F.when(bound, (F.col("loss") == 0).cast("int"))), 6).alias("satisfied"))


@query(f"with {LOSSES} select model, endpoint, design_group, count(loss) as n, round(avg(loss), 6) as mean_loss from loss group by all")
def group_loss_summary(spark, d) -> DataFrame:
    return _losses(spark, d).groupBy("model", "endpoint", "design_group").agg(F.count("loss").alias("n"), F.round(F.avg("loss"), 6).alias("mean_loss"))


@query(f"with {LOSSES} select endpoint || ':' || status as status, count(*) // 4 as n from loss group by 1")
def status_histogram(spark, d) -> DataFrame:
    return _endpoints(spark, d).groupBy(F.concat_ws(":", "endpoint", "status").alias("status")).agg(F.count("*").alias("n"))


DELTAS = LOSSES + """,
delta as materialized (select a.id, a.component, a.design_group, a.endpoint, b.model as baseline, a.loss - b.loss as delta from loss a join loss b on a.id = b.id and a.endpoint = b.endpoint and a.model = 'ridge' and b.model <> 'ridge' where a.loss is not null)"""


def _deltas(spark, d) -> DataFrame:
    """Paired differences ridge - baseline: one aggregate instead of a self-join."""
    w = _losses(spark, d).filter("loss is not null").groupBy("id", "component", "design_group", "endpoint").agg(F.max(F.when(F.col("model") == "ridge", F.col("loss"))).alias("mine"), F.collect_list(F.struct("model", "loss")).alias("all"))  # four models each
    x = w.select("id", "component", "design_group", "endpoint", "mine", F.explode("all").alias("x")).filter("x.model <> 'ridge'")
    return x.select("id", "component", "design_group", "endpoint", F.col("x.model").alias("baseline"), (F.col("mine") - F.col("x.loss")).alias("delta"))


@query(f"with {DELTAS}, g as (select endpoint, baseline, component, avg(delta) as d from delta group by all) select endpoint, baseline, count(*) as groups, round(avg(d), 6) as macro_delta from g group by all")
def group_macro_delta(spark, d) -> DataFrame:
    g = _deltas(spark, d).groupBy("endpoint", "baseline", "component").agg(F.avg("delta").alias("d"))
    return g.groupBy("endpoint", "baseline").agg(F.count("*").alias("groups"), F.round(F.avg("d"), 6).alias("macro_delta"))


@query(f"with {DELTAS}, k as (select distinct endpoint, baseline, component from delta) select k.endpoint, k.baseline, k.component, count(*) filter (x.component = k.component) as n, round(avg(x.delta) filter (x.component <> k.component), 6) as others_mean from k join delta x on k.endpoint = x.endpoint and k.baseline = x.baseline group by all")
def leave_one_group_out(spark, d) -> DataFrame:
    return M.leave_one_out(_deltas(spark, d), ["endpoint", "baseline"], "component", "delta").withColumn("others_mean", F.round("others_mean", 6))


@query(f"with {DELTAS}, g as (select endpoint, baseline, component, avg(delta) as d from delta group by all), m as (select endpoint, baseline, sign(round(avg(d), 9)) as s from g group by all) select endpoint, count(distinct s) = 1 as stable, list_sort(list_distinct(list(cast(s as integer)))) as signs from m group by endpoint")
def direction_stability(spark, d) -> DataFrame:
    g = _deltas(spark, d).groupBy("endpoint", "baseline", "component").agg(F.avg("delta").alias("d"))
    m = g.groupBy("endpoint", "baseline").agg(F.signum(F.round(F.avg("d"), 9)).cast("int").alias("s"))
    return m.groupBy("endpoint").agg((F.countDistinct("s") == 1).alias("stable"), F.sort_array(F.collect_set("s")).alias("signs"))


# ------------------------------------------------------------------ resampling

RESAMPLES = 10_000


def _intervals(means: DataFrame) -> DataFrame:
    found = intervals(means, ["endpoint", "baseline"], "delta")
    return found.select("endpoint", "baseline", *(F.round(c, 6).alias(n) for c, n in (("mean", "mean_delta"), ("low", "low"), ("high", "high"))))


@query()
def component_bootstrap(spark, d) -> DataFrame:
    """Paired bootstrap of whole components, as many draws as there are: sums and sizes first, then the mean of each resample's rows."""
    by = ["endpoint", "baseline"]
    g = _deltas(spark, d).groupBy(*by, "component").agg(F.sum("delta").alias("s"), F.count("*").alias("n"))
    drawn = resampled(g, by, "component", ["s", "n"], RESAMPLES)
    return _intervals(drawn.withColumn("delta", F.col("s") / F.col("n")))


@query()
def stratified_bootstrap(spark, d) -> DataFrame:
    """Rows are resampled within each design group, as many as it has; the mean is over all of an endpoint's rows."""
    others = [m for m in T.MODELS if m != "ridge"]
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("loss")))
    w = _losses(spark, d).filter("loss is not null").groupBy("id", "design_group", "endpoint").agg(*(of(m).alias(m) for m in T.MODELS))
    # an endpoint's baselines share the draws of its rows
    delta = {m: F.col("ridge") - F.col(m) for m in others}
    w = w.select("id", "design_group", "endpoint", *(x.alias(f"delta_{m}") for m, x in delta.items()), *(x.isNotNull().cast("double").alias(f"n_{m}") for m, x in delta.items()))
    values = [f"{c}_{m}" for c in ("delta", "n") for m in others]
    drawn = resampled(w, ["endpoint", "design_group"], "id", values, RESAMPLES).groupBy("endpoint", "resample").agg(*(F.sum(v).alias(v) for v in values))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("baseline"), F.col(f"delta_{m}").alias("s"), F.col(f"n_{m}").alias("n")) for m in others)))
    pooled = drawn.select("endpoint", "resample", each.alias("x")).select("endpoint", "resample", "x.*").filter("n > 0").withColumn("delta", F.col("s") / F.col("n"))
    return _intervals(pooled)


@query(f"with {LOSSES}, a as (select 'metric' as kind, model, cast(null as varchar) as baseline, endpoint, round(avg(loss), 6) as value from loss group by model, endpoint), {DELTAS[len(LOSSES) + 2:]} select * from a union all select 'delta', 'ridge', baseline, endpoint, round(avg(delta), 6) from delta group by baseline, endpoint")
def figure_source_union(spark, d) -> DataFrame:
    """Metrics and differences in one ragged table."""
    a = _losses(spark, d).groupBy("model", "endpoint").agg(F.round(F.avg("loss"), 6).alias("value")).withColumn("kind", F.lit("metric"))
    b = _deltas(spark, d).groupBy("baseline", "endpoint").agg(F.round(F.avg("delta"), 6).alias("value")).withColumns({"kind": F.lit("delta"), "model": F.lit("ridge")})
    return a.unionByName(b, allowMissingColumns=True).select("kind", "model", "baseline", "endpoint", "value")


# ------------------------------------------------------------------ dependency groups



@query("""with recursive p as materialized (select distinct l_orderkey as id, l_suppkey as donor from lineitem),
e as materialized (select distinct a.donor as x, b.donor as y from p a join p b using (id)),
reach as (select distinct donor as x, donor as y from p union select r.x, e.y from reach r join e on r.y = e.x),
least as materialized (select x as donor, min(id) as parent from reach join (select donor, min(id) as id from p group by donor) f on y = f.donor group by x)
select id, min(parent) as parent from p join least using (donor) group by id""")
def parent_clusters(spark, d) -> DataFrame:
    """Rows that share a donor, directly or over others: donors link to their smallest row, never pairwise."""
    p = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("donor")).distinct()
    hub = p.groupBy(F.col("donor").alias("of")).agg(F.min("id").alias("hub"))
    links = p.join(hub, F.col("donor") == F.col("of")).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    return G.rooted(p.select("id").distinct(), links, "id").select("id", F.col("root").alias("parent"))


@query(f"""with {LOSSES}, c as (select rep.id, rep.receptor, p2.model, status, case when status = 'observed' then abs(g - log10(v)) else greatest(0.0, log10(v) - g) end as loss from rep join (select id, model, 'gcgr' as receptor, gcgr as g from p2 union all select id, model, 'glp1r', glp1r from p2) p2 on rep.id = p2.id and rep.receptor = p2.receptor)
select model, receptor, count(*) as cells, count(*) filter (status = 'observed') as observed, count(*) filter (status = 'right_censored') as censored, round(avg(loss), 6) as mean_loss, count(*) filter (status = 'right_censored' and loss = 0) as bounds_met from c group by all""")
def replicate_cell_summary(spark, d) -> DataFrame:
    """Cells, their kinds and mean losses of each model and receptor."""
    r = _parsed(spark, d)
    p = T.predictions(r.select("id").distinct()).selectExpr("id", "model", "stack(2, 'gcgr', gcgr, 'glp1r', glp1r) as (receptor, g)")
    loss = S.censor_loss(F.col("status"), F.log10(F.coalesce("value_pm", "threshold_pm")), F.col("g"))
    c = r.join(p, ["id", "receptor"]).select("model", "receptor", "status", loss.alias("loss"))
    censored = F.col("status") == "right_censored"
    return c.groupBy("model", "receptor").agg(F.count("*").alias("cells"), F.count_if(F.col("status") == "observed").alias("observed"), F.count_if(censored).alias("censored"), F.round(F.avg("loss"), 6).alias("mean_loss"), F.count_if(censored & (F.col("loss") == 0)).alias("bounds_met"))


# ------------------------------------------------------------------ ridge


@query()
def ridge_coefficients(spark, d) -> DataFrame:
    """Weights by position and symbol of the final model: component-weighted ridge over all rows, at the alpha with the least left-out error."""
    fits = R.Fits(T.measured(spark, d), "source", outer=False)
    w = fits.models(fits.selected()).select("alpha", F.posexplode(F.arrays_zip("w1", "w2")).alias("feature", "w"))
    return w.select((F.floor(F.col("feature") / 21) + 1).cast("int").alias("position"), F.substring(F.lit(S.ALPHABET), F.col("feature") % 21 + 1, F.lit(1)).alias("symbol"), "alpha", F.round("w.w1", 6).alias("w_gcgr"), F.round("w.w2", 6).alias("w_glp1r"))


@query()
def loco_alpha(spark, d) -> DataFrame:
    """Held-out error of each alpha, leaving one component out at a time, over all rows and for each outer fold's training rows (outer_fold null: all)."""
    s = R.Fits(T.measured(spark, d), "source").scores()
    return s.select(F.nullif("held", F.lit(R.ALL)).alias("outer_fold"), "alpha", "components", F.round("score", 6).alias("score"))


def _nested(spark, d) -> DataFrame:
    """Each row predicted by the model of the other folds, whose alpha was selected within these."""
    m = T.measured(spark, d)
    fits = R.Fits(m, "source")
    return R.predicted(m, fits.models(fits.selected()), F.col("fold") == F.col("held"))


@query()
def nested_ridge_oof(spark, d) -> DataFrame:
    return _nested(spark, d).select("peptide_id", "fold", F.col("alpha").alias("selected_alpha"), F.round("gcgr", 6).alias("ridge_gcgr"), F.round("glp1r", 6).alias("ridge_glp1r"))


@query()
def ridge_beside_nn(spark, d) -> DataFrame:
    """Both models' out-of-fold predictions of each row."""
    nn = tied_nn_oof(spark, d).select("peptide_id", "nn_gcgr", "nn_glp1r", "nn_selectivity", F.col("identity").alias("nearest_identity"), F.col("ties").alias("nearest_ties"), F.col("donors").alias("nearest_donors"))
    ridge = _nested(spark, d).select("peptide_id", "source", "fold", F.col("alpha").alias("selected_alpha"), F.round("y1", 6).alias("actual_gcgr"), F.round("y2", 6).alias("actual_glp1r"), F.round("gcgr", 6).alias("ridge_gcgr"), F.round("glp1r", 6).alias("ridge_glp1r"))
    return ridge.join(nn, "peptide_id")


@query()
def seeded_component_bootstrap(spark, d) -> DataFrame:
    """Intervals of ridge's over the nearest neighbours' mean absolute error, by 10 000 seeded draws of whole components."""
    both = ridge_beside_nn(spark, d)
    error = lambda m, y: F.abs(F.col(f"{m}_{y}") - F.col(f"actual_{y}"))
    long = both.select("source", F.explode(F.array(*(F.struct(F.lit(y).alias("endpoint"), (error("ridge", y) - error("nn", y)).alias("delta")) for y in ("gcgr", "glp1r")))).alias("x")).select("source", "x.*")
    found = M.seeded_bootstrap(long, ["endpoint"], "source", "delta")
    return found.withColumns({c: F.round(c, 6) for c in ("mean_delta", "low", "high")})
