"""Files at the edge: candidate tables, FASTA texts, folds, locked predictions, manifests and model artifacts.

Tables are read by Spark's readers with a declared schema, checked by aggregates and never collected.
Single documents (artifacts, manifests, policies) are read on the driver, after a check of their size.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions import sequences as S
from strandwise.operators.graph import cut

SMALL = 65_536
DOCUMENT = 64 << 20
#: The folder beside an artifact that has the references which aren't in it.
REFERENCES = "references"
#: Fixed columns of the structure seeds.
SEED_COLUMNS = ["pdb_id", "receptor", "receptor_match", "ligand", "ligand_match", "benchmark_role", "study_doi", "modification_note"]


class InputError(ValueError):
    """A file that breaks its contract."""


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns alone; a missing one is an error."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise InputError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def unique(df: DataFrame, key: str) -> DataFrame:
    """df, if no value of key that isn't blank stands in two rows; the error names five at most."""
    twice = df.filter(F.trim(F.col(key).cast("string")) != "").groupBy(key).count().filter("count > 1")
    found = [str(r[0]) for r in twice.orderBy(key).limit(5).collect()]
    if found:
        raise InputError(f"duplicate {key}: {', '.join(found)}")
    return df


def capped(df: DataFrame, most: int | None) -> DataFrame:
    """df, if it has rows and no more than a stated limit; more is an error, never a cut."""
    n = df.limit((most or 0) + 1).count()
    if not n:
        raise InputError("no rows")
    if most is not None and n > most:
        raise InputError(f"more than {most} rows")
    return df


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The inner join of two tables, which must hold the same ids."""
    sides = a.select(key, F.lit(1).alias("s")).unionByName(b.select(key, F.lit(2).alias("s"))).groupBy(key).agg(F.bit_or("s").alias("s")).agg(F.count_if(F.col("s") == 1), F.count_if(F.col("s") == 2)).first()
    if any(sides):
        raise InputError(f"{key}: {sides[0]} only left, {sides[1]} only right")
    return a.join(b, key)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """record (from 1) and text of the CSV records of one file, in any number of tasks; blank lines are none.

    A line ends a record if the quotes up to it are even. Tasks read ranges of the file and count quotes and records under both
    guesses of the state that these begin in; the counts of the ranges, one row each, say which guess is right and how
    many records were before. Only records of several lines are put together by a shuffle.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.input_file_block_start().alias("part"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None  # a range of the file, named by its first byte
        for batch in batches:
            places = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(places[1:] != places[:-1]) + 1).tolist(), len(places)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if places[i] != part:
                    part, row, odd, upto = places[i], 0, 0, np.zeros(2, np.int64)
                text, n = batch.column(0).slice(i, j - i), j - i
                quotes = pc.count_substring(text, '"').to_numpy(zero_copy_only=False).astype(np.int64)
                state = (odd + np.cumsum(quotes) - quotes) % 2  # before each line, from the range's first
                blank = pc.is_in(text, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
                seen = upto[:, None] + np.cumsum([(state == g) & ~blank for g in (0, 1)], axis=1)  # under the guess g, a record starts where nothing is open
                yield pa.RecordBatch.from_arrays([text, pa.array(np.full(n, part)), pa.array(np.arange(row, row + n)), pa.array(state), pa.array(quotes % 2), pa.array(seen[0]), pa.array(seen[1])], [x.split()[0] for x in LINES.split(", ")])
                row, odd, upto = row + n, (odd + int(quotes.sum())) % 2, seen[:, -1]

    found = cut(lines.mapInArrow(count, LINES))
    ends = found.groupBy("part").agg((F.sum("turns") % 2).alias("odd"), F.max("seen_0").alias("n0"), F.max("seen_1").alias("n1")).orderBy("part").collect()  # a row for each range
    guesses, guess, before = [], 0, 0
    for p in ends:
        guesses.append((p.part, guess, before))
        before += p.n1 if guess else p.n0
        guess = (guess + p.odd) % 2
    if guess:
        raise InputError("a quote is never closed")
    known = spark.createDataFrame(guesses, "of long, guess int, before long")
    placed = found.join(F.broadcast(known), F.col("part") == F.col("of"))
    opened = (F.col("state") + F.col("guess")) % 2 == 1  # a record goes on from the line before
    placed = placed.select("text", "part", "row", (F.col("before") + F.when(F.col("guess") == 0, F.col("seen_0")).otherwise(F.col("seen_1"))).alias("record"), opened.alias("opened"), ((F.col("turns") == 1) != opened).alias("goes_on"))
    bare = F.regexp_replace("text", "\r$", "")
    single = placed.filter("not opened and not goes_on").filter(bare != "").select("record", bare.alias("text"))
    several = placed.filter("opened or goes_on").groupBy("record").agg(F.array_sort(F.collect_list(F.struct("part", "row", "text"))).alias("lines"))  # the lines of one record
    return single.unionByName(several.select("record", F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), "\r$", "").alias("text")))


LINES = "text string, part long, row long, state long, turns long, seen_0 long, seen_1 long"
#: A field in quotes, in which a quote is doubled, or a bare one; as one group.
_CELL = r'("[^"]*+(?:""[^"]*+)*+"|[^",\r\n]*+)'


def candidates(spark: SparkSession, path: str, most_rows: int | None = None) -> DataFrame:
    """input_row (from 1), candidate_id and sequence or aligned_sequence of CSV with a header.

    Quoted fields may hold line ends. The header is trimmed and may start with a byte order mark; a field
    too many, or a quote where none can be, is an error, a field too few is an empty one; ids are trimmed, sequences
    aren't, and ids that aren't blank are unique.
    """
    records = cut(csv_records(spark, path))
    head = records.filter("record = 1").first()
    header = [c.strip().strip('"').strip() for c in (head.text if head else "").lstrip("\ufeff").split(",")]
    if header not in (["candidate_id", "sequence"], ["candidate_id", "aligned_sequence"]):
        raise InputError(f"columns are {header}")
    shape = f"(?s)^{_CELL}(?:,{_CELL})?$"
    rows = records.filter("record > 1").withColumns({f"c{k}": F.regexp_extract("text", shape, k) for k in (1, 2)})
    cell = lambda c: F.when(F.col(c).startswith('"'), F.replace(F.expr(f"substring({c}, 2, length({c}) - 2)"), F.lit('""'), F.lit('"'))).otherwise(F.col(c))
    wrong = rows.filter(~F.col("text").rlike(shape)).select("record", F.col("text").rlike(f"(?s)^{_CELL}(?:,{_CELL}){{2,}}$").alias("wide")).orderBy("record").first()
    if wrong:
        raise InputError(f"row {wrong.record - 1}: {'too many fields' if wrong.wide else 'a quote or line end where none can be'}")
    named = rows.select((F.col("record") - 1).alias("input_row"), F.trim(cell("c1")).alias("candidate_id"), cell("c2").alias(header[1]))
    return unique(capped(named, most_rows), "candidate_id")


#: A field in quotes, in which a quote is doubled, or a bare one.
_FIELD = re.compile(r'"((?:[^"]|"")*)"|([^",\r\n]*)')
_LINE_END = re.compile(r"\r\n|\r|\n")


def strict_csv(text: str, most_rows: int | None = None) -> list[list[str]]:
    """Rows of CSV that leaves nothing to guess: quotes stand around whole fields and are closed, any line end counts, blank lines don't."""
    rows, row, at = [], [], 0
    while at < len(text) or row:
        field = _FIELD.match(text, at)
        quoted, at = field.group(1) is not None, field.end()
        row.append(field.group(1).replace('""', '"') if quoted else field.group(2))
        end = _LINE_END.match(text, at)
        if text.startswith(",", at):
            at += 1
            if at == len(text):
                row.append("")
            else:
                continue
        elif at < len(text) and not end:
            what = "unterminated quoted field" if not quoted and field.group(2) == "" and text[at] == '"' else "quote inside a field" if not quoted else "text after a closing quote"
            raise InputError(f"malformed CSV: {what} at {at}")
        if row != [""] or quoted or not rows:
            rows.append(row)
            if most_rows is not None and len(rows) > most_rows + 1:
                raise InputError(f"more than {most_rows} rows")
        row, at = [], end.end() if end else len(text)
    return rows


def regular(spark: SparkSession, path: str, most_bytes: int) -> bytes:
    """The content of one regular file (no folder, no link) of limited size."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(to):
        raise InputError(f"{path}: no such file")
    status = fs.getFileLinkStatus(to)
    linked = status.isSymlink() or fs.getScheme() == "file" and os.path.islink(to.toUri().getPath())
    if linked or not status.isFile() or status.getLen() > most_bytes:
        raise InputError(f"{path}: not one regular file of at most {most_bytes} bytes")
    if not status.getLen():  # the reader passes over empty files
        return b""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first().content)


def strict_candidates(spark: SparkSession, path: str, most_rows: int = 500, most_raw: int = 200, most_bytes: int = 2 << 20) -> DataFrame:
    """As candidates(), by strict_csv() from one small file, with input_mode: columns in either order, a field too many is an error."""
    try:
        rows = strict_csv(regular(spark, path, most_bytes).decode("utf-8-sig"), most_rows)
    except UnicodeDecodeError as e:
        raise InputError(f"{path}: not UTF-8") from e
    header = [c.strip() for c in rows[0]] if rows else []
    name = next((c for c in ("sequence", "aligned_sequence") if sorted(header) == sorted(["candidate_id", c])), None)
    if name is None:
        raise InputError(f"columns are {header}")
    raw = name == "sequence"
    if len(rows) < 2:
        raise InputError("no rows")
    if raw and len(rows) - 1 > most_raw:
        raise InputError(f"more than {most_raw} rows")
    if wide := next((k for k, r in enumerate(rows[1:], 1) if len(r) > 2), None):
        raise InputError(f"row {wide} has too many fields")
    i, j = header.index("candidate_id"), header.index(name)
    full = [[*r, ""][:2] for r in rows[1:]]
    made = [(k, r[i].strip(), r[j], "raw_sequence" if raw else "provided_alignment") for k, r in enumerate(full, 1)]
    return unique(spark.createDataFrame(made, f"input_row long, candidate_id string, {name} string, input_mode string"), "candidate_id")


def fasta(spark: SparkSession, path: str, most_bytes: int = SMALL, header_required: bool = False) -> DataFrame:
    """path, header, sequence and error of each text: at most one header line, the rest joined. Texts above the limit aren't read."""
    files = spark.read.format("binaryFile").load(path)
    large = files.filter(F.col("length") > most_bytes).select("path", F.lit(None).cast("string").alias("header"), F.lit(None).cast("string").alias("sequence"), F.lit("too_large").alias("error"))
    small = files.filter(F.col("length") <= most_bytes).select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("t"))
    lines = F.split(F.regexp_replace(F.regexp_replace("t", "^﻿", ""), "\r\n?", "\n"), "\n")
    lines = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    heads = F.filter("l", lambda x: x.startswith(">"))
    parts = small.withColumn("l", lines).withColumns({"headed": F.coalesce(F.get("l", F.lit(0)).startswith(">"), F.lit(False)), "heads": F.size(heads)})
    parts = parts.select("path", "t", "l", "headed", "heads", F.when(F.col("headed"), F.trim(F.substr(F.get("l", F.lit(0)), F.lit(2)))).alias("header"), F.array_join(F.filter("l", lambda x: ~x.startswith(">")), "").alias("sequence"))
    error = F.when(F.col("t").isNull(), "not_utf8").when(F.size("l") == 0, "empty").when((F.col("heads") > 1) | (F.col("heads") > F.col("headed").cast("int")), "several_headers").when(F.col("header") == "", "empty_header").when(F.col("sequence") == "", "no_sequence")
    if header_required:
        error = error.when(~F.col("headed"), "no_header")
    return parts.select("path", "header", "sequence", error.alias("error")).unionByName(large)


def folds(spark: SparkSession, path: str) -> DataFrame:
    """peptide_id, cluster_id and outer_fold, each peptide once."""
    df = spark.read.options(header=True, mode="FAILFAST").csv(path)
    df = project(df, ["peptide_id", "cluster_id", "outer_fold"]).withColumn("outer_fold", F.col("outer_fold").cast("int"))
    return unique(df, "peptide_id")


def locked_predictions(spark: SparkSession, path: str, columns: list[str], forbidden: tuple[str, ...] = ("observed", "actual", "outcome")) -> DataFrame:
    """Predictions with exactly these columns, in order of the number in the id; names that speak of outcomes are an error."""
    df = spark.read.options(header=True, mode="FAILFAST").csv(path)
    if df.columns != columns:
        raise InputError(f"columns are {df.columns}")
    if told := [c for c in columns if any(f in c for f in forbidden)]:
        raise InputError(f"columns that tell outcomes: {told}")
    typed = df.select("peptide_id", *(F.col(c).cast("double").alias(c) if c.endswith(("_log10_pm", "_ratio", "_identity")) else F.col(c) for c in columns if c != "peptide_id"))
    number = F.regexp_replace(F.regexp_extract("peptide_id", "([0-9]+)$", 1), "^0+(?=.)", "")  # of any length: more digits are more
    return unique(typed, "peptide_id").orderBy(F.length(number), number, "peptide_id")


def structure_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed seeds; PDB ids are upper-cased, of four characters and unique."""
    df = project(spark.read.options(header=True, mode="FAILFAST").csv(path), SEED_COLUMNS)
    df = df.select(*(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in SEED_COLUMNS)).withColumn("pdb_id", F.upper("pdb_id"))
    if df.filter(F.length("pdb_id") != 4).limit(1).count():
        raise InputError("a PDB id hasn't four characters")
    return unique(df, "pdb_id")


def document(spark: SparkSession, path: str, sha256: str | None = None, most_bytes: int = DOCUMENT) -> dict:
    """A JSON object from one file of limited size, held against its checksum if one is given."""
    content = regular(spark, path, most_bytes)
    found_sum = hashlib.sha256(content).hexdigest()
    if sha256 and found_sum != sha256.lower():
        raise InputError(f"{path}: checksum {found_sum}")
    try:
        found = json.loads(content.decode("utf-8-sig"))
    except ValueError as e:
        raise InputError(f"{path}: no JSON") from e
    if not isinstance(found, dict):
        raise InputError(f"{path}: no JSON object")
    return found


def gated(found: dict, expected: dict) -> dict:
    """A configuration or policy, if these fields have these values."""
    if wrong := sorted(k for k, v in expected.items() if found.get(k) != v):
        raise InputError(f"unexpected {', '.join(wrong)}")
    return found


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """id and JSON document of each source of a version 1 manifest."""
    sources = gated(document(spark, path), {"manifest_version": 1}).get("sources")
    if not isinstance(sources, list) or not sources or not all(isinstance(s, dict) and s.get("id") for s in sources):
        raise InputError("sources must be a list of objects with ids")
    return unique(spark.createDataFrame([(str(s["id"]), json.dumps(s)) for s in sources], "id string, document string"), "id")


def checksums(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """name, sha256 and whether it is as expected (name, sha256), for every file of a folder and every expected one."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    return expected.select("name", F.lower("sha256").alias("sha256")).join(found, "name", "full_outer").select("name", "found", F.coalesce(F.col("found") == F.col("sha256"), F.lit(False)).alias("verified"))


def sums(spark: SparkSession, place: str) -> list[str]:
    """The checksums of a folder's files, sorted."""
    return sorted(r.sum for r in spark.read.format("binaryFile").load(place).select(F.sha2("content", 256).alias("sum")).collect())


def _beside(path: str) -> str:
    return f"{path.rpartition('/')[0] or '.'}/{REFERENCES}"


def artifact_references(spark: SparkSession, artifact: dict, path: str) -> DataFrame:
    """peptide_id and aligned of the references of model_artifact(path), which are in it or in files beside it."""
    listed = artifact["applicability_reference"]
    if "sequences" in listed:
        return spark.createDataFrame([(r["peptide_id"], r["aligned_sequence"]) for r in listed["sequences"]], "peptide_id string, aligned string")
    return spark.read.schema("peptide_id string, aligned_sequence string").json(_beside(path)).select("peptide_id", F.col("aligned_sequence").alias("aligned"))


def _whole_beside(spark: SparkSession, artifact: dict, path: str) -> bool:
    """Whether the files beside an artifact are those of its checksums, and their references unique and of full length; nothing of them is collected."""
    listed = artifact["applicability_reference"]
    try:
        there = sums(spark, _beside(path))
    except AnalysisException as e:
        raise InputError(f"{path}: no files of references beside it") from e
    if not there or there != listed["sha256"]:
        raise InputError(f"{path}: other files of references than its checksums say")
    found = artifact_references(spark, artifact, path)
    n, ids, aligned, full = found.agg(F.count("*"), F.countDistinct("peptide_id"), F.countDistinct("aligned"), F.count_if(F.length("aligned") == S.LENGTH)).first()
    return n == ids == aligned == full == listed.get("rows")


def model_artifact(spark: SparkSession, path: str, sha256: str | None = None) -> dict:
    """A frozen model whose shapes, numbers and references are whole."""
    a = document(spark, path, sha256)
    wide = S.LENGTH * len(S.ALPHABET)
    try:
        contract, model, listed = a["input_contract"], a["model"], a["applicability_reference"]
        beside = "sequences" not in listed and "sha256" in listed
        references = [] if beside else listed["sequences"]
        shapes = len(model["feature_mean"]) == wide and len(model["target_mean"]) == 2 and len(model["coefficients"]) == wide and all(len(r) == 2 for r in model["coefficients"])
        numbers = [model["selected_alpha"], *model["feature_mean"], *model["target_mean"], *(x for r in model["coefficients"] for x in r)]
        ids, aligned = [r["peptide_id"] for r in references], [r["aligned_sequence"] for r in references]
    except (KeyError, TypeError) as e:
        raise InputError(f"{path}: {e} is missing") from e
    if contract.get("aligned_length") != S.LENGTH or set(contract.get("alphabet", "")) != set(S.ALPHABET):
        raise InputError("another input contract")
    if not shapes or not all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in numbers) or model["selected_alpha"] <= 0:
        raise InputError("coefficients of another shape, or not finite")
    if not (_whole_beside(spark, a, path) if beside else ids and len(set(ids)) == len(ids) and len(set(aligned)) == len(aligned) and all(len(s) == S.LENGTH for s in aligned)):
        raise InputError("references must be unique and of full length")
    return a
