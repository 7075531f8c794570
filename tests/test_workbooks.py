"""Workbooks that are written here, cell by cell."""

import zipfile
from xml.sax.saxutils import escape

import pytest

from strandwise.sources import workbooks as W
from strandwise.sources.files import InputError

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _name(col):
    out = ""
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def book(path, sheets):
    """Texts are shared strings, but for those that start with a tilde, which are inline."""
    shared = []
    with zipfile.ZipFile(path, "w") as z:
        for k, rows in enumerate(sheets.values(), 1):
            lines = []
            for r, row in enumerate(rows, 1):
                cells = []
                for c, v in enumerate(row, 1):
                    at = f"{_name(c)}{r}"
                    if isinstance(v, bool):
                        cells.append(f'<c r="{at}" t="b"><v>{int(v)}</v></c>')
                    elif isinstance(v, str) and v.startswith("~"):
                        cells.append(f'<c r="{at}" t="inlineStr"><is><t>{escape(v[1:])}</t></is></c>')
                    elif isinstance(v, str):
                        shared.append(v)
                        cells.append(f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>')
                    elif v is not None:
                        cells.append(f'<c r="{at}"><f>1+1</f><v>{v!r}</v></c>')
                lines.append(f'<row r="{r}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet {MAIN}><sheetData>{"".join(lines)}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst {MAIN}>{"".join(f"<si><r><t>{escape(s[:1])}</t></r><r><t>{escape(s[1:])}</t></r><rPh><t>no</t></rPh></si>" for s in shared)}</sst>')
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{RELS}"><sheets>{"".join(f"<sheet name=\"{escape(n)}\" sheetId=\"{k}\" r:id=\"rId{k}\"/>" for k, n in enumerate(sheets, 1))}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships>{"".join(f"<Relationship Id=\"rId{k}\" Target=\"{"/xl/" if k % 2 else ""}worksheets/sheet{k}.xml\"/>" for k in range(1, len(sheets) + 1))}</Relationships>')
    return str(path)


HEAD = ["pep_ID", "alias", None, "sequence", "EC50_T1", "EC50_T2"]
DATA = [HEAD, ["b", None, None, " acd ", 10, 1000.0], [None] * 6, ["a", "x", "y", "~ACE", 1, 2]]
ALIGNED = [["pep_ID", "sequence"], ["a", "AC-E"], ["b", "acd-"]]


def test_cells(spark, tmp_path):
    path = book(tmp_path / "t.xlsx", {"s": [["a&b", 1.5, True], [], [None] * 27 + ["~in"]], "empty": []})
    got = [tuple(r)[1:] for r in W.cells(spark, path).orderBy("sheet", "row", "col").collect()]
    assert got == [("empty", 0, 0, "sheet", None), ("s", 0, 0, "sheet", None), ("s", 1, 1, "text", "a&b"), ("s", 1, 2, "number", "1.5"), ("s", 1, 3, "bool", "TRUE"), ("s", 3, 28, "text", "in")]


def test_training(spark, tmp_path):
    got = W.training(spark, book(tmp_path / "t.xlsx", {"dataset": DATA, "alignment": ALIGNED}), 2).collect()
    assert [(r.peptide_id, r.raw_sequence, r.aligned_sequence, r.gcgr_ec50_pm) for r in got] == [("a", "ACE", "AC-E", 1.0), ("b", "ACD", "ACD-", 10.0)]
    assert got[1].selectivity_log10_ratio == pytest.approx(-2)
    assert [r.peptide_id for r in W.alignments(spark, str(tmp_path / "t.xlsx"), 2, 4).collect()] and pytest.raises(InputError, W.alignments, spark, str(tmp_path / "t.xlsx"))


@pytest.mark.parametrize(
    "data, aligned, message",
    [
        (DATA, None, "missing sheets: alignment"),
        ([HEAD[:-1], *DATA[1:]], ALIGNED, "missing columns: EC50_T2"),
        ([*DATA, DATA[1]], ALIGNED, "duplicate peptide_id: b"),
        ([*DATA, ["c", None, None, "AXZ", 1, 1]], ALIGNED, "c: the sequence"),
        ([*DATA, ["c", None, None, "AC", True, 1]], ALIGNED, "c: the GCGR"),
        ([*DATA, ["c", None, None, "AC", 1, 0]], ALIGNED, "c: the GLP-1R"),
        ([*DATA, ["c", None, None, "AC", 1, 1]], ALIGNED, "1 only left, 0 only right"),
        (DATA, [*ALIGNED[:-1], ["b", "AC"]], "2 lengths"),
        (DATA, [*ALIGNED[:-1], ["b", "AC*-"]], "b: the aligned"),
    ],
)
def test_training_that_breaks_its_contract(spark, tmp_path, data, aligned, message):
    path = book(tmp_path / "t.xlsx", {"dataset": data} | ({"alignment": aligned} if aligned else {}))
    with pytest.raises(InputError, match=message):
        W.training(spark, path)


def test_designs(spark, tmp_path):
    sheets = {f"P{k}": [["id"], [f"P{k}", *("ACDEFGHIKLMNPQRSTVWY"[(k + j) % 20] for j in range(29)), "~-", "beyond"]] for k in range(1, 16)}
    got = {r.design_id: r.aligned_sequence for r in W.designs(spark, book(tmp_path / "d.xlsx", sheets)).collect()}
    assert len(got) == 15 and got["P1"] == "CDEFGHIKLMNPQRSTVWYACDEFGHIKL-"
    for name, change, message in (("same", {"P2": [["id"], ["P2", *sheets["P1"][1][1:]]]}, "unique"), ("short", {"P2": [["id"], ["P2", "A"]]}, "P2: not 30"), ("other", {"P2": [["id"], ["P3", *sheets["P2"][1][1:]]]}, "row 2")):
        with pytest.raises(InputError, match=message):
            W.designs(spark, book(tmp_path / f"{name}.xlsx", sheets | change))
    with pytest.raises(InputError, match="missing sheets: P15"):
        W.designs(spark, book(tmp_path / "few.xlsx", {k: v for k, v in sheets.items() if k != "P15"}))


def test_replicates(spark, tmp_path):
    rows = [["peptide", "n=1", "n=2", "n=3", "note"]] + [[f"P{k}", 5 * k, "~>280,000", None, "x"] for k in range(1, 16)] + [["other", "junk", None, None]]
    got = W.replicates(spark, book(tmp_path / "r.xlsx", {"data_GCGR": rows}), "GCGR").filter("peptide = 'P3'").orderBy("replicate").collect()
    assert [(r.status, r.value_pm, r.threshold_pm) for r in got] == [("observed", 15.0, None), ("right_censored", None, 280000.0), ("missing", None, None)]
    for name, changed, message in (("twice", [*rows, rows[1]], "duplicate peptide: P1"), ("few", rows[:-2], "missing GCGR rows: P15"), ("odd", [*rows[:-2], ["P15", "inactive", 1, 1]], "P15: a replicate"), ("plain", [*rows[:-2], ["P15", "12", 1, 1]], "P15: a replicate"), ("head", [["peptide", "n=2"], *rows[1:]], "columns of data_GCGR")):
        with pytest.raises(InputError, match=message):
            W.replicates(spark, book(tmp_path / f"{name}.xlsx", {"data_GCGR": changed}), "GCGR").count()
    with pytest.raises(InputError, match="unknown receptor"):
        W.replicates(spark, str(tmp_path / "r.xlsx"), "other")


def test_what_is_no_workbook(spark, tmp_path):
    (tmp_path / "t.xlsx").write_bytes(b"text")
    with pytest.raises(Exception, match="no workbook"):
        W.cells(spark, str(tmp_path / "t.xlsx")).count()
    with pytest.raises(InputError, match="more than"):
        list(W.parse(open(book(tmp_path / "b.xlsx", {"s": [["a"]]}), "rb").read(), unpacked=10))


def test_workbooks_as_a_source(spark, tmp_path):
    """Sheets are partitions; filters on sheet, row and column leave other sheets closed and end a sheet's stream."""
    from strandwise.sources import workbook_source as B

    rows = [[f"r{k}c{c}" for c in range(4)] for k in range(200)]
    for k in range(2):
        book(tmp_path / f"b{k}.xlsx", {"P1": rows, "P2": rows, "other": [["x", 1.5]]})
    (tmp_path / "notes.txt").write_text("no workbook")
    B.register(spark)
    read = lambda: spark.read.format("workbook").load(str(tmp_path))
    plain = W.cells(spark, str(tmp_path / "*.xlsx"))
    bare = lambda df: sorted((r.path.rpartition("/")[2], *r[1:]) for r in df.collect())
    where = "sheet = 'P1' and row = 2 and col <= 3"
    for condition in ("true", where, "sheet in ('P2', 'other') and row > 198 and value is not null", "row < 1", "sheet = 'none'", "kind = 'number'"):
        assert bare(read().filter(condition)) == bare(plain.filter(condition)), condition
    assert read().rdd.getNumPartitions() == 6 and read().filter(where).rdd.getNumPartitions() == 2
    reader = B.WorkbookReader(str(tmp_path / "b0.xlsx"))
    kept = list(reader.pushFilters([B.DS.EqualTo(("sheet",), "P1"), B.DS.EqualTo(("row",), 2), B.DS.StringContains(("value",), "c")]))
    (part,) = reader.partitions()
    assert len(kept) == 1 and len(list(reader.read(part))) == 4 and reader.parsed == 8  # rows 1 and 2 of one sheet
    with pytest.raises(InputError, match="no such file"):
        B.WorkbookReader(str(tmp_path / "none")).partitions()
    with pytest.raises(InputError, match="no workbook"):
        B.WorkbookReader(str(tmp_path / "notes.txt")).partitions()
