"""Tables and the domain views over them.

`panel` derives 30-column aligned sequences from documents, `measured` joins them with two activity
targets, `replicates` reads line items as replicate measurements of two receptors, some of them
right-censored. All are declared over whole tables; Catalyst prunes what a query doesn't use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.functions import sequences as S

#: Fixed values of the four competing models' stand-in predictions: offset, factor, modulus, divisor.
MODELS = {"ridge": (4.0, 37, 100, 50.0), "nn": (4.0, 53, 100, 50.0), "median": (5.0, 0, 1, 1.0), "component_mean": (4.5, 1, 5, 10.0)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, peptide_id, source, fold, aligned. Sequences that are all gap stay, as invalid ones."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("seq_pep"), "doc_id").alias("peptide_id"), "source", (F.col("doc_id") % 3 + 1).cast("int").alias("fold"), S.aligned_from_text(F.col("text")).alias("aligned"))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """panel rows with y1, y2 (log10 targets) and their difference, sel."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("k1")).agg(F.max("o_totalprice").alias("ec1"))
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k2")).agg(F.round(F.sum("l_extendedprice"), 2).alias("ec2"))
    p = panel(spark, sf_dir)
    y = p.join(o, p["doc_id"] == o["k1"]).join(li, p["doc_id"] == li["k2"], "left").filter((F.col("ec1") > 0) & (F.col("aligned") != S.ALL_GAP))
    y = y.select("doc_id", "peptide_id", "source", "fold", "aligned", "ec1", F.coalesce("ec2", F.lit(1.0)).alias("ec2"))
    return y.withColumns({"y1": F.log10("ec1"), "y2": F.log10("ec2")}).withColumn("sel", F.col("y1") - F.col("y2"))


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, receptor, replicate 1 to 3, cell and is_text: items 1 to 3 of an order are gcgr, 4 to 6 glp1r. A receptor has a full set or none: orders of under three items have no row, of under six no glp1r."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    w = Window.partitionBy("l_orderkey")
    li = li.withColumns({"rn": F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")), "n": F.count("*").over(w)}).filter("rn <= 3 and n >= 3 or rn between 4 and 6 and n >= 6")
    censored = F.col("l_returnflag") == "R"
    return li.select(F.col("l_orderkey").alias("id"), F.when(F.col("rn") <= 3, "gcgr").otherwise("glp1r").alias("receptor"), ((F.col("rn") - 1) % 3 + 1).cast("int").alias("replicate"), F.concat(F.when(censored, ">").otherwise(""), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("cell"), censored.alias("is_text"))


def predictions(ids: DataFrame) -> DataFrame:
    """id, model, gcgr and glp1r predictions for every id."""
    rows = [f"'{m}', {base}D + (id * {f} % {mod}) / {div}D" for m, (base, f, mod, div) in MODELS.items()]
    return ids.selectExpr("id", f"stack({len(rows)}, {', '.join(rows)}) as (model, gcgr)").withColumn("glp1r", F.col("gcgr") + 0.3 + (F.col("id") % 4) / 10)
