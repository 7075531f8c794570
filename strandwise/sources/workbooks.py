"""Spreadsheets (Office Open XML) as cells, and the tables that are read from them.

Every workbook below a path is parsed by one task, its sheets as streams, into a row for each cell with
a value; formulas have the value that was stored with them. All that follows is DataFrame work over
cells. Workbooks above a size, packed or unpacked, are an error, never cut.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions import sequences as S
from strandwise.sources.files import InputError, same_ids, unique

CELLS = "path string, sheet string, row int, col int, kind string, value string"
PACKED, UNPACKED = 64 << 20, 512 << 20
#: Fixed sheet names of the receptors' measurements, their first columns, and the designs' ids.
RECEPTOR_SHEETS = {"GCGR": "data_GCGR", "GLP-1R": "data_GLP-1R"}
REPLICATE_COLUMNS = ["peptide", "n=1", "n=2", "n=3"]
DESIGNS = [f"P{k}" for k in range(1, 16)]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(item: ElementTree.Element) -> str:
    """The runs of a string item; phonetic hints are no part of it."""
    return "".join(t.text or "" for part in item if _local(part.tag) in ("t", "r") for t in part.iter() if _local(t.tag) == "t")


def _column(reference: str) -> int:
    n = 0
    for c in reference.upper():
        if not "A" <= c <= "Z":
            break
        n = 26 * n + ord(c) - 64
    return n


def parse(content: bytes, only: set[str] | None = None, unpacked: int = UNPACKED) -> Iterator[tuple[str, int, int, str, str | None]]:
    """(sheet, row, column, kind, value), both from 1, of every cell with a value; before them (sheet, 0, 0, "sheet", None).

    Kinds: number, text, bool (TRUE or FALSE) and error.
    """
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise InputError("no workbook") from e
    with book:
        if sum(i.file_size for i in book.infolist()) > unpacked:
            raise InputError(f"a workbook of more than {unpacked} bytes")
        if "xl/workbook.xml" not in book.namelist():
            raise InputError("no workbook")
        targets, shared = _targets(book), _shared(book)
        for name, target in targets:
            yield name, 0, 0, "sheet", None
            if target and (only is None or name in only):
                with book.open(target) as part:
                    for cell in _cells(part, shared):
                        yield name, *cell


def _targets(book: zipfile.ZipFile) -> list[tuple[str, str | None]]:
    """Names of the sheets and the parts that hold them."""
    names, targets, out = set(book.namelist()), {}, []
    if "xl/_rels/workbook.xml.rels" in names:
        for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
            target = r.get("Target", "")
            targets[r.get("Id")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _local(sheet.tag) == "sheet":
            target = targets.get(next((v for k, v in sheet.attrib.items() if _local(k) == "id"), None))
            out.append((sheet.get("name", ""), target if target in names else None))
    return out


def _shared(book: zipfile.ZipFile) -> list[str]:
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as part:
            for _, e in ElementTree.iterparse(part):
                if _local(e.tag) == "si":
                    shared.append(_text(e))
                    e.clear()
    return shared


def sheet_cells(book: zipfile.ZipFile, name: str, last_row: float) -> Iterator[tuple[int, int, str, str | None]]:
    """(0, 0, "sheet", None), then row, column, kind and value of one sheet's cells up to a row; what is behind it isn't parsed."""
    yield 0, 0, "sheet", None
    target = dict(_targets(book)).get(name)
    if target and last_row > 0:
        shared = _shared(book)
        with book.open(target) as part:
            for cell in _cells(part, shared):
                if cell[0] > last_row:
                    return
                yield cell


def _cells(part, shared: list[str]) -> Iterator[tuple[int, int, str, str]]:
    row = 0
    for _, e in ElementTree.iterparse(part):
        if _local(e.tag) != "row":
            continue
        row, col = int(e.get("r") or row + 1), 0
        for c in e:
            col = _column(c.get("r") or "") or col + 1
            kind = c.get("t", "n")
            value = next((v for v in c if _local(v.tag) == "v"), None)
            if kind == "inlineStr":
                text = "".join(_text(x) for x in c if _local(x.tag) == "is")
            elif value is None or value.text is None:
                continue
            else:
                text = shared[int(value.text)] if kind == "s" else value.text
            if kind == "b":
                text = "TRUE" if text == "1" else "FALSE"
            yield row, col, {"n": "number", "b": "bool", "e": "error"}.get(kind, "text"), text
        e.clear()


def cells(spark: SparkSession, path: str, sheets: list[str] | None = None, packed: int = PACKED, unpacked: int = UNPACKED) -> DataFrame:
    """The cells of all workbooks of a path, or of their named sheets; every sheet has a row of its own (row 0)."""
    only = None if sheets is None else set(sheets)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("kind", pa.string()), ("value", pa.string())])
        for batch in batches:
            for at, size, content in zip(*(batch.column(k) for k in range(3)), strict=True):
                if size.as_py() > packed:
                    raise InputError(f"{at.as_py()}: more than {packed} bytes")
                held: list[tuple] = []
                for cell in parse(content.as_py(), only, unpacked):
                    held.append((at.as_py(), *cell))
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "length", "content").mapInArrow(read, CELLS)


def require_sheets(found: DataFrame, sheets: list[str]) -> None:
    """An error if a workbook lacks one of the sheets."""
    have = found.filter("kind = 'sheet'").groupBy("path").agg(F.collect_set("sheet").alias("s"))  # a workbook's few sheets
    bad = have.select("path", F.array_except(F.array(*map(F.lit, sheets)), "s").alias("missing")).filter(F.size("missing") > 0).first()
    if bad or not have.limit(1).count():
        raise InputError(f"missing sheets: {', '.join(bad.missing) if bad else 'all'}")


def records(found: DataFrame, sheet: str, columns: list[str]) -> DataFrame:
    """path, row and, for each named column of the header, its value as text and its kind (name with _kind); rows without any value are left out.

    The header is row 1; of columns of one name the last counts; columns without a name are left out.
    """
    here = found.filter((F.col("sheet") == sheet) & (F.col("row") > 0))
    heads = here.filter("row = 1").groupBy("path", F.col("value").alias("name")).agg(F.max("col").alias("at"))
    have = heads.groupBy("path").agg(F.collect_set("name").alias("names")).select(F.array_except(F.array(*map(F.lit, columns)), "names").alias("missing"))
    bad = have.filter(F.size("missing") > 0).first()
    if bad or not have.limit(1).count():
        raise InputError(f"{sheet} is missing columns: {', '.join(bad.missing) if bad else ', '.join(columns)}")
    named = here.filter("row > 1").join(heads.select(F.col("path").alias("p"), "name", "at"), (F.col("path") == F.col("p")) & (F.col("col") == F.col("at")), "left")
    of = lambda c, what: F.max(F.when(F.col("name") == c, F.col(what)))
    return named.groupBy("path", "row").agg(*(x for c in columns for x in (of(c, "value").alias(c), of(c, "kind").alias(f"{c}_kind"))))


def _check(df: DataFrame, rules: list[tuple[Column, str]], key: str) -> DataFrame:
    """df, if no row breaks a rule; the error names the first rule that a row breaks and the least of such rows' keys."""
    broken = reduce(lambda c, r: c.when(r[0], r[1]), rules[1:], F.when(*rules[0]))
    bad = df.select(broken.alias("rule"), F.col(key).alias("k")).filter("rule is not null").orderBy("k", "rule").first()
    if bad:
        raise InputError(f"{bad.k}: {bad.rule}")
    return df


def _trimmed(name: str) -> Column:
    return F.trim(F.coalesce(F.col(f"`{name}`"), F.lit("")))


def _alignments(found: DataFrame) -> DataFrame:
    rows = records(found, "alignment", ["pep_ID", "sequence"])
    return rows.select(_trimmed("pep_ID").alias("peptide_id"), F.upper(_trimmed("sequence")).alias("aligned_sequence")).filter("peptide_id <> ''")


def training(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """peptide_id, raw_sequence, aligned_sequence, both EC50 and their logs, in order of ids: the sheets dataset and alignment, which hold the same ids."""
    found = cells(spark, path, ["dataset", "alignment"])
    require_sheets(found, ["dataset", "alignment"])
    rows = records(found, "dataset", ["pep_ID", "sequence", "EC50_T1", "EC50_T2"])
    number = lambda c: F.when(F.col(f"{c}_kind") != "bool", F.col(c).try_cast("double"))
    data = rows.select(_trimmed("pep_ID").alias("peptide_id"), F.upper(_trimmed("sequence")).alias("raw_sequence"), number("EC50_T1").alias("gcgr_ec50_pm"), number("EC50_T2").alias("glp1r_ec50_pm")).filter("peptide_id <> ''")
    wrong = lambda c: ~F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")), F.lit(False))
    letters = S.ALPHABET[1:]
    _check(data, [(~F.col("raw_sequence").rlike(f"^[{letters}]+$"), "the sequence isn't of natural amino acids"), (wrong("gcgr_ec50_pm"), "the GCGR EC50 isn't positive and finite"), (wrong("glp1r_ec50_pm"), "the GLP-1R EC50 isn't positive and finite")], "peptide_id")
    aligned = _alignments(found)
    _check(aligned, [(~F.col("aligned_sequence").rlike(f"^[{letters}-]+$"), "the aligned sequence has other symbols")], "peptide_id")
    both = same_ids(unique(data, "peptide_id"), unique(aligned, "peptide_id"), "peptide_id")
    n, widths = both.agg(F.count("*"), F.countDistinct(F.length("aligned_sequence"))).first()
    if widths != 1:
        raise InputError(f"aligned sequences of {widths} lengths")
    if expected is not None and n != expected:
        raise InputError(f"{n} records, not {expected}")
    logs = {f"{r}_log10_ec50_pm": F.log10(f"{r}_ec50_pm") for r in ("gcgr", "glp1r")}
    out = both.select("peptide_id", "raw_sequence", "aligned_sequence", "gcgr_ec50_pm", "glp1r_ec50_pm").withColumns(logs)
    return out.withColumn("selectivity_log10_ratio", F.col("gcgr_log10_ec50_pm") - F.col("glp1r_log10_ec50_pm")).orderBy("peptide_id")


def alignments(spark: SparkSession, path: str, expected: int | None = 125, length: int = S.LENGTH) -> DataFrame:
    """peptide_id and aligned_sequence of the sheet alignment alone; rows that lack one are skipped."""
    found = cells(spark, path, ["alignment"])
    require_sheets(found, ["alignment"])
    rows = unique(_check(_alignments(found).filter("aligned_sequence <> ''"), [(F.length("aligned_sequence") != length, f"not of length {length}")], "peptide_id"), "peptide_id")
    n = rows.count()
    if expected is not None and n != expected:
        raise InputError(f"{n} alignments, not {expected}")
    return rows


def designs(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """design_id and its aligned sequence: row 2 of the sheet of that name, the id first, then 30 cells of a symbol each."""
    ids = DESIGNS if ids is None else ids
    found = cells(spark, path, ids)
    require_sheets(found, ids)
    first = found.filter((F.col("row") == 2) & (F.col("col") <= S.LENGTH + 1) & F.col("sheet").isin(ids))
    symbols = F.array_sort(F.collect_list(F.when(F.col("col") > 1, F.struct("col", F.upper(F.trim("value")).alias("s")))))  # at most 30
    rows = first.groupBy("path", F.col("sheet").alias("design_id")).agg(F.max(F.when(F.col("col") == 1, F.trim("value"))).alias("id"), F.array_join(F.transform(symbols, lambda x: x["s"]), "").alias("aligned_sequence"))
    _check(rows, [(~F.coalesce(F.col("id") == F.col("design_id"), F.lit(False)), "row 2 doesn't hold the design's id"), (~F.col("aligned_sequence").rlike(f"^[{S.ALPHABET[1:]}-]{{{S.LENGTH}}}$"), f"not {S.LENGTH} symbols of natural amino acids")], "design_id")
    n, kinds = rows.agg(F.countDistinct("design_id"), F.countDistinct("aligned_sequence")).first()
    if n != len(ids) or rows.count() != n:
        raise InputError(f"{n} designs, not {len(ids)}")
    if kinds != n:
        raise InputError("designs aren't unique")
    return rows.select("design_id", "aligned_sequence")


def replicates(spark: SparkSession, path: str, receptor: str, ids: list[str] | None = None) -> DataFrame:
    """peptide, receptor, replicate (1 to 3), status, value_pm and threshold_pm of the designs; other peptides are left out."""
    if receptor not in RECEPTOR_SHEETS:
        raise InputError(f"unknown receptor {receptor}")
    ids, sheet = DESIGNS if ids is None else ids, RECEPTOR_SHEETS[receptor]
    found = cells(spark, path, [sheet])
    require_sheets(found, [sheet])
    heads = [r.value for r in found.filter(f"row = 1 and col <= {len(REPLICATE_COLUMNS)}").orderBy("path", "col").select("value").limit(len(REPLICATE_COLUMNS)).collect()]
    if heads != REPLICATE_COLUMNS:
        raise InputError(f"columns of {sheet} are {heads}")
    at = lambda k, what: F.max(F.when(F.col("col") == k, F.col(what)))
    rows = found.filter("row > 1").groupBy("path", "row").agg(F.trim(at(1, "value")).alias("peptide"), *(x for k in (2, 3, 4) for x in (at(k, "value").alias(f"v{k}"), at(k, "kind").alias(f"k{k}"))))
    rows = unique(rows.filter(F.col("peptide").isin(ids)), "peptide")
    have = {r.peptide for r in rows.select("peptide").collect()}  # no more than ids
    if missing := [i for i in ids if i not in have]:
        raise InputError(f"missing {receptor} rows: {', '.join(missing)}")
    long = rows.selectExpr("peptide", "stack(3, 1, v2, k2, 2, v3, k3, 3, v4, k4) as (replicate, cell, kind)")
    status, value, threshold = S.parse_replicate(F.col("cell"), ~F.coalesce(F.col("kind") == "number", F.lit(False)))
    out = long.select("peptide", F.lit(receptor).alias("receptor"), "replicate", status.alias("status"), value.alias("value_pm"), threshold.alias("threshold_pm"))
    return _check(out, [(F.col("status") == "error", "a replicate is neither a positive number nor a bound")], "peptide")
