"""Results on their way out: flat rows, CSV, receipts, and pairs of outputs that appear together or not at all."""

from __future__ import annotations

import hashlib
import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.functions import sequences as S
from strandwise.sources import files

#: References of a file beside an artifact.
PART = 50_000


@F.pandas_udf(T.StringType())
def general(values: pd.Series) -> pd.Series:
    """Doubles with up to 15 significant digits and no trailing zeros: text that doesn't depend on the platform."""
    return values.map(lambda x: None if pd.isna(x) else format(x, ".15g"))


def number(x: float) -> str:
    """For readers: four places without trailing zeros, or an exponent where it is very large or small."""
    if x == 0:
        return "0"
    return f"{x:.4e}" if abs(x) >= 10000 or abs(x) < 0.001 else f"{x:.4f}".rstrip("0").rstrip(".")


@F.pandas_udf(T.StringType())
def shown(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if pd.isna(x) else number(x))


def comparison_status(evidence: Column, ranked: Column) -> Column:
    """Fixed wordings."""
    return F.when(evidence == "training_reference_match", "In-sample reference · not an independent prediction").when(ranked, "Eligible for exploratory comparison").otherwise("Do not use for candidate ranking")


def validation_evidence(evidence: Column) -> Column:
    """Fixed wordings."""
    return F.when(evidence == "training_reference_match", "In-sample evidence only").when(evidence == "local_analogue_mixed_evidence", "Mixed retrospective transfer").otherwise("No supported transfer evidence")


def fold_comparison(ratio: Column, receptor: str) -> Column:
    """Fixed wordings: a query's predicted EC50 against that of the closest development sequence."""
    said = lambda x, way: F.concat(F.lit(f"Query {receptor} EC50 is predicted "), shown(x), F.lit(f"× {way} than the closest development sequence."))
    return F.when(F.abs(ratio - 1) <= 1e-12, f"{receptor} EC50 is unchanged from the closest development sequence.").when(ratio > 1, said(ratio, "higher")).otherwise(said(1 / ratio, "lower"))


def markdown(df: DataFrame, title: str, rows: int = 1000) -> str:
    """A small result as a Markdown table, in the order of its first columns; more rows than that are an error."""
    found = df.orderBy(*df.columns).limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more than {rows} rows")
    text = lambda x: "" if x is None else number(x) if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *([text(x) for x in r] for r in found)]
    return f"# {title}\n\n" + "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"


def prediction_text(predictions: DataFrame) -> DataFrame:
    """id and a text for readers of each prediction row (peptide_id, gcgr, glp1r, identity, tier, evidence, ranking_eligible, exclusion_reasons)."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), c, F.lit("\n"))
    body = F.concat(line("Peptide", F.col("peptide_id")), line("GCGR log10(EC50 / 1 pM)", shown("gcgr")), line("GLP-1R log10(EC50 / 1 pM)", shown("glp1r")), line("Closest development identity", shown("identity")), line("Applicability", F.col("tier")), line("Evidence", validation_evidence(F.col("evidence"))), line("Comparison", comparison_status(F.col("evidence"), F.col("ranking_eligible"))), F.when(F.col("exclusion_reasons") != "", line("Not ranked", F.col("exclusion_reasons"))).otherwise(""))
    return predictions.select("peptide_id", body.alias("report"))


def _rename_over(spark: SparkSession, fs, staged, to) -> None:
    """Puts a file in another's place by one rename, so that there is no moment with neither."""
    jvm = spark._jvm
    if fs.getScheme() == "file":
        for p in (to, staged):  # checksums beside local files; one without is just not checked
            jvm.java.nio.file.Files.deleteIfExists(jvm.java.io.File(f"{p.getParent().toUri().getPath()}/.{p.getName()}.crc").toPath())
        option = spark.sparkContext._gateway.new_array(jvm.java.nio.file.CopyOption, 1)
        option[0] = jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE
        at = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (staged, to)]
        jvm.java.nio.file.Files.move(*at, option)
    else:
        over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration()).rename(staged, to, over)


def write_file(spark: SparkSession, path: str, content: bytes, overwrite: bool = False) -> str:
    """One file, whole or not at all; its SHA-256. The folder must be there, and a file only if it may be overwritten."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, staged = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.staged-{uuid.uuid4().hex}"))
    fs = to.getFileSystem(conf)
    if not fs.exists(to.getParent()):
        raise FileNotFoundError(str(to.getParent()))
    if fs.exists(to) and (not overwrite or not fs.getFileStatus(to).isFile()):
        raise FileExistsError(path)
    try:
        out = fs.create(staged, False)
        out.write(content)
        out.close()
        _rename_over(spark, fs, staged, to)
    finally:
        fs.delete(staged, False)
    return hashlib.sha256(content).hexdigest()


def write_artifact(spark: SparkSession, folder: str, model: dict, references: DataFrame, artifact_id: str, version: str, sources: dict[str, str], most: int = 200_000, beside: int | None = None) -> dict:
    """model.json and receipt.json of a fitted model (alpha, w1, w2, mx, my) and its references (peptide_id, aligned); the receipt.

    More than `most` distinct references are an error, as the artifact is one file, unless `beside` is given: then
    more than that many lie in files beside it, which tasks write, and the artifact has their checksums.
    """
    distinct, inside = references.groupBy("aligned").agg(F.min("peptide_id").alias("peptide_id")), most if beside is None else beside
    rows = distinct.orderBy("peptide_id").limit(inside + 1).collect()
    if len(rows) <= inside:
        listed, number = {"sequences": [{"peptide_id": r.peptide_id, "aligned_sequence": r.aligned} for r in rows]}, len(rows)
    elif beside is None:
        raise ValueError(f"more than {most} references")
    else:
        number = distinct.count()
        listed = {"rows": number, "sha256": _write_references(distinct, f"{folder}/{files.REFERENCES}", number)}
    document = {
        "artifact_id": artifact_id,
        "artifact_version": version,
        "input_contract": {"aligned_length": S.LENGTH, "alphabet": S.ALPHABET},
        "model": {"selected_alpha": model["alpha"], "feature_mean": list(model["mx"]), "target_mean": list(model["my"]), "coefficients": [list(x) for x in zip(model["w1"], model["w2"], strict=True)]},
        "applicability_reference": listed,
        "provenance": sources,
    }
    dump = lambda x: (json.dumps(x, indent=2, sort_keys=True, allow_nan=False) + "\n").encode()
    digest = write_file(spark, f"{folder}/model.json", dump(document))
    receipt = {"schema_version": 1, "artifact": f"{folder}/model.json", "artifact_sha256": digest, "artifact_id": artifact_id, "artifact_version": version, "source_sha256": sources, "selected_alpha": model["alpha"], "references": number}
    write_file(spark, f"{folder}/receipt.json", dump(receipt))
    return receipt


def _write_references(distinct: DataFrame, place: str, number: int) -> list[str]:
    """JSON lines of references, dealt by their ids into files of about PART rows; the files' checksums, sorted."""
    dealt = distinct.select("peptide_id", F.col("aligned").alias("aligned_sequence")).repartition(-(-number // PART), "peptide_id")
    dealt.sortWithinPartitions("peptide_id").write.json(place)
    return files.sums(distinct.sparkSession, place)


def write_screening(screened: DataFrame, folder: str, overwrite: bool = False) -> dict:
    """candidates.csv, in display order, and receipt.csv, together or not at all; the receipt's fields."""
    from strandwise.operators.screening import COLUMNS

    found = receipt(screened)
    write_together({f"{folder}/candidates.csv": safe(screened.orderBy("display_order").select(*COLUMNS)), f"{folder}/receipt.csv": found}, overwrite)
    return found.first().asDict()


def flat(df: DataFrame) -> DataFrame:
    """Fields of structs as columns (outer_inner), arrays joined by semicolons."""

    def columns(kind: T.StructType, path: str, name: str):
        for f in kind.fields:
            at, label = f"{path}`{f.name}`", f"{name}{f.name}"
            if isinstance(f.dataType, T.StructType):
                yield from columns(f.dataType, at + ".", label + "_")
            elif isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StructType, T.ArrayType)):
                yield F.array_join(F.col(at).cast("array<string>"), ";").alias(label)
            else:
                yield F.col(at).alias(label)

    return df.select(*columns(df.schema, "", ""))


def safe(df: DataFrame) -> DataFrame:
    """df with its texts safe for spreadsheets and its doubles in stable text."""
    shown: dict[str, Column] = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            shown[f.name] = S.spreadsheet_safe(F.col(f.name))
        elif isinstance(f.dataType, T.DoubleType):
            shown[f.name] = general(F.col(f.name))
    return df.withColumns(shown)


def write_csv(df: DataFrame, path: str, single: bool = False, overwrite: bool = False) -> None:
    """CSV parts with a header; `single` is for results known to be small."""
    (df.coalesce(1) if single else df).write.mode("overwrite" if overwrite else "errorifexists").options(header=True, lineSep="\n", emptyValue="").csv(path)


def documents(df: DataFrame) -> DataFrame:
    """A JSON document for each row, its fields in order of their names."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("document"))


def receipt(screened: DataFrame) -> DataFrame:
    """Counts, status and exit code of a screening, from one aggregate over its rows (status, rank)."""
    of = lambda s: F.count_if(F.col("status") == s)
    n = screened.agg(F.count("*").alias("rows_in"), of("ranked").alias("ranked"), of("not_ranked_out_of_scope").alias("out_of_scope"), of("input_error").alias("input_errors"), F.countDistinct("rank").alias("ranks"))
    none, some = F.col("ranked") == 0, F.col("input_errors") > 0
    status = F.when(none, "no_rankable_rows").when(some, "completed_with_row_errors").otherwise("completed")
    return n.select("*", status.alias("status"), F.when(none, 3).when(some, 1).otherwise(0).alias("exit_code"))


def write_together(outputs: dict[str, DataFrame], overwrite: bool = False) -> None:
    """Writes each table as CSV beside its path, then moves all in place: all are the new ones or all the old ones, whatever fails.

    The commit is one file, a journal of the moves, that appears once everything is written. Before it nothing that was there has
    been touched; after it the moves can be made again until they are done, which recover() does, as does the next call for these paths.
    """
    spark, tag = SparkSession.active(), uuid.uuid4().hex
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    places = {p: path(p) for p in outputs}
    for p, to in places.items():
        if not to.getFileSystem(conf).exists(to.getParent()):
            raise FileNotFoundError(str(to.getParent()))
        recover(spark, str(to.getParent()))
    for p, to in places.items():
        if to.getFileSystem(conf).exists(to) and not overwrite:
            raise FileExistsError(p)
    journal = f"{next(iter(places.values())).getParent()}/{JOURNAL}{tag}"
    try:
        for p, df in outputs.items():
            write_csv(df, f"{p}.staged-{tag}", overwrite=True)
        write_file(spark, journal, json.dumps({"tag": tag, "paths": list(outputs)}).encode())
    except BaseException:
        for p in outputs:
            staged = path(f"{p}.staged-{tag}")
            staged.getFileSystem(conf).delete(staged, True)
        raise
    _finish(spark, journal)


#: How the names of journals begin.
JOURNAL = ".moves-"


def recover(spark: SparkSession, folder: str) -> int:
    """Makes the moves of all journals in a folder that were not finished; how many there were."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = [str(s.getPath()) for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if s.getPath().getName().startswith(JOURNAL) and ".staged-" not in s.getPath().getName()]
    for journal in found:
        _finish(spark, journal)
    return len(found)


def _finish(spark: SparkSession, journal: str) -> None:
    """The moves of a journal, each of which may have been made already; the journal goes last."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    at = path(journal)
    fs = at.getFileSystem(conf)
    stream = fs.open(at)
    content = json.loads(bytes(stream.readAllBytes()))
    stream.close()
    for p in content["paths"]:
        to, staged, before = path(p), path(f"{p}.staged-{content['tag']}"), path(f"{p}.before-{content['tag']}")
        own = to.getFileSystem(conf)
        if own.exists(staged):
            if own.exists(to):
                _move(own, to, before)
            _move(own, staged, to)
    for p in content["paths"]:
        before = path(f"{p}.before-{content['tag']}")
        before.getFileSystem(conf).delete(before, True)
    fs.delete(at, False)


def _move(fs, a, b) -> None:
    if not fs.rename(a, b):
        raise OSError(f"{a} can't be moved to {b}")
