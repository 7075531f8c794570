"""Files in and out, structure records, and held-out errors against fits on rows."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.operators import ridge as R
from strandwise.operators import structures
from strandwise.sources import files as I
from strandwise.sources import sinks as O

SEQ = "HSQGTFTSDYSKYLDSRAASEFVQWLISHA"


def _file(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(p)


def test_candidates(spark, tmp_path):
    p = _file(tmp_path, "a.csv", f'﻿candidate_id , sequence\n" a ", {SEQ}\nb,"x\ny"\nonly\n')
    rows = I.candidates(spark, p, 10).orderBy("input_row").collect()
    assert [(r.candidate_id, r.sequence) for r in rows] == [("a", " " + SEQ), ("b", "x\ny"), ("only", "")]
    with pytest.raises(I.InputError, match="more than 2"):
        I.candidates(spark, p, 2)


@pytest.mark.parametrize(
    ("text", "error"),
    [("candidate_id,sequence\na,A\na,C\n", "duplicate"), ("candidate_id,sequence\na,A,C\n", "too many"), ("candidate_id,other\na,A\n", "columns"), ("candidate_id,sequence\n", "no rows")],
)
def test_candidate_errors(spark, tmp_path, text, error):
    with pytest.raises(I.InputError, match=error):
        I.candidates(spark, _file(tmp_path, "a.csv", text))


def test_blank_ids_may_repeat(spark, tmp_path):
    assert I.candidates(spark, _file(tmp_path, "a.csv", "candidate_id,aligned_sequence\n ,A\n,C\n")).count() == 2


def test_fasta(spark, tmp_path):
    for name, text in {"a": f"\n>one\r\n{SEQ[:10]}\r{SEQ[10:]}\n\n", "b": SEQ, "c": " \n", "d": ">\nA", "e": ">x\nA\n>y\nC", "f": ">x\n", "g": b"\xff\xfe", "h": "A" * 200, "i": "A\n>x\nC", "j": "﻿>z\nAC"}.items():
        _file(tmp_path, name, text)
    got = {r.path[-1]: r for r in I.fasta(spark, str(tmp_path), 100).collect()}
    assert (got["a"].header, got["a"].sequence, got["a"].error) == ("one", SEQ, None)
    assert (got["b"].header, got["b"].sequence, got["b"].error) == (None, SEQ, None)
    assert (got["j"].header, got["j"].sequence, got["j"].error) == ("z", "AC", None)
    assert {k: got[k].error for k in "cdefghi"} == {"c": "empty", "d": "empty_header", "e": "several_headers", "f": "no_sequence", "g": "not_utf8", "h": "too_large", "i": "several_headers"}
    assert {r.path[-1]: r.error for r in I.fasta(spark, str(tmp_path), 100, header_required=True).collect()}["b"] == "no_header"


def test_folds_seeds_and_locked_predictions(spark, tmp_path):
    p = _file(tmp_path, "f.csv", "peptide_id,cluster_id,outer_fold\np1,c,1\np2,c,1\n")
    assert [r.outer_fold for r in I.folds(spark, p).collect()] == [1, 1]
    with pytest.raises(I.InputError, match="duplicate"):
        I.folds(spark, _file(tmp_path, "g.csv", "peptide_id,cluster_id,outer_fold\np1,c,1\np1,c,2\n"))
    with pytest.raises(I.InputError, match="four characters"):
        I.structure_seeds(spark, _file(tmp_path, "s.csv", ",".join(I.SEED_COLUMNS) + "\nabc,r,m,l,m,b,d,n\n"))
    with pytest.raises(I.InputError, match="missing"):
        I.structure_seeds(spark, p)
    q = _file(tmp_path, "q.csv", "peptide_id,ridge_gcgr_log10_pm\nP10,1.5\nP2,2\n")
    assert [tuple(r) for r in I.locked_predictions(spark, q, ["peptide_id", "ridge_gcgr_log10_pm"]).collect()] == [("P2", 2.0), ("P10", 1.5)]
    with pytest.raises(I.InputError, match="columns"):
        I.locked_predictions(spark, q, ["peptide_id"])


def test_same_ids(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, l string"), spark.createDataFrame([(1, "y")], "id int, r string")
    assert I.same_ids(a, b, "id").collect() == [(1, "x", "y")]
    with pytest.raises(I.InputError, match="1 only left, 1 only right"):
        I.same_ids(a, spark.createDataFrame([(2, "y")], "id int, r string"), "id")


def _artifact():
    return {
        "input_contract": {"alphabet": "-ACDEFGHIKLMNPQRSTVWY", "aligned_length": 30},
        "model": {"selected_alpha": 10.0, "feature_mean": [0.0] * 630, "target_mean": [1.0, 2.0], "coefficients": [[0.1, 0.2]] * 630},
        "applicability_reference": {"sequences": [{"peptide_id": "p", "component_id": "c", "aligned_sequence": SEQ}]},
    }


def test_documents(spark, tmp_path):
    text = json.dumps(_artifact())
    p = _file(tmp_path, "m.json", text)
    assert I.model_artifact(spark, p, hashlib.sha256(text.encode()).hexdigest())["model"]["selected_alpha"] == 10
    with pytest.raises(I.InputError, match="checksum"):
        I.model_artifact(spark, p, "0" * 64)
    with pytest.raises(I.InputError, match="at most"):
        I.document(spark, p, most_bytes=10)
    bad = _artifact()
    bad["model"]["coefficients"][0] = [float("nan"), 0.0]
    with pytest.raises(I.InputError, match="finite"):
        I.model_artifact(spark, _file(tmp_path, "n.json", json.dumps(bad)))
    with pytest.raises(I.InputError, match="unexpected version"):
        I.gated({"version": 2}, {"version": 1})


def test_manifest_and_checksums(spark, tmp_path):
    p = _file(tmp_path, "m.json", json.dumps({"manifest_version": 1, "sources": [{"id": "a", "url": "u"}]}))
    assert I.manifest(spark, p).filter("id = 'a'").count() == 1
    for sources in ([], [{"id": "a"}, {"id": "a"}], [{"url": "u"}]):
        with pytest.raises(I.InputError):
            I.manifest(spark, _file(tmp_path, "x.json", json.dumps({"manifest_version": 1, "sources": sources})))
    (tmp_path / "data").mkdir()
    _file(tmp_path / "data", "one", "1")
    expected = spark.createDataFrame([("one", hashlib.sha256(b"1").hexdigest().upper()), ("two", "00")], "name string, sha256 string")
    assert {r.name: r.verified for r in I.checksums(spark, str(tmp_path / "data"), expected).collect()} == {"one": True, "two": False}


def test_flat_safe_and_documents(spark):
    df = spark.sql("select '=x' as id, named_struct('a', 0.1D + 0.2D, 'b', array('p', 'q'), 'c', named_struct('d', 1e22D)) as s")
    flat = O.flat(df)
    assert flat.columns == ["id", "s_a", "s_b", "s_c_d"]
    assert list(O.safe(flat).first()) == ["'=x", "0.3", "p;q", "1e+22"]
    assert list(json.loads(O.documents(spark.sql("select 1 as b, cast(null as int) as a")).first()[0]).items()) == [("a", None), ("b", 1)]


@pytest.mark.parametrize(("status", "want"), [(["ranked"], ("completed", 0)), (["ranked", "input_error"], ("completed_with_row_errors", 1)), (["input_error"], ("no_rankable_rows", 3)), ([], ("no_rankable_rows", 3))])
def test_receipt(spark, status, want):
    r = O.receipt(spark.createDataFrame([(s, 1 if s == "ranked" else None) for s in status], "status string, rank long")).first()
    assert (r.status, r.exit_code) == want and r.rows_in == len(status)


def test_pairs_appear_together(spark, tmp_path):
    a, b = str(tmp_path / "rows"), str(tmp_path / "receipt")
    one, two = spark.sql("select 1 as x"), spark.sql("select 2 as x")
    O.write_together({a: one, b: one})
    with pytest.raises(FileExistsError):
        O.write_together({a: two, b: two})
    with pytest.raises(Exception, match="[Dd]ivi"):
        O.write_together({a: two, b: spark.sql("select 1 div (id - id) as x from range(1)")}, overwrite=True)
    assert spark.read.csv(a, header=True).first().x == "1"
    O.write_together({a: two, b: two}, overwrite=True)
    assert {spark.read.csv(p, header=True).first().x for p in (a, b)} == {"2"}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["receipt", "rows"]
    with pytest.raises(FileNotFoundError):
        O.write_together({str(tmp_path / "no" / "rows"): one})


def test_structures(spark):
    entry = {"rcsb_entry_container_identifiers": {"polymer_entity_ids": ["1", "2", "3"]}, "rcsb_entry_info": {"resolution_combined": [3.1]}, "exptl": [{"method": "EM"}], "struct": {"title": "T"}, "citation": [{}, {"pdbx_database_id_doi": "10.1/x"}]}
    texts = {"1": "Glucagon-like  peptide 1 receptor", "2": "Glucagon", "3": "G protein"}
    seeds = spark.createDataFrame([(p, "R", r, "L", m, "b", "seed", "") for p, r, m in (("1ABC", "glucagon like peptide 1 receptor", "glucagon"), ("2ABC", "g", "x"), ("3ABC", "glucagon", "zzz"), ("4ABC", "a", "b"))], ", ".join(f"{c} string" for c in I.SEED_COLUMNS))
    entries = spark.createDataFrame([(p, json.dumps(entry if p == "1ABC" else {"rcsb_entry_container_identifiers": {"polymer_entity_ids": ["1", "2", "3"]}})) for p in ("1ABC", "2ABC", "3ABC")], "pdb_id string, document string")
    entities = spark.createDataFrame([(p, k, json.dumps({"rcsb_polymer_entity": {"pdbx_description": t}, "rcsb_polymer_entity_container_identifiers": {"auth_asym_ids": ["A", "B"]}})) for p in ("1ABC", "2ABC", "3ABC") for k, t in texts.items()], "pdb_id string, entity_id string, document string")
    got = {r.pdb_id: r for r in structures.resolve(seeds, entries, entities).collect()}
    one = got["1ABC"]
    assert (one.receptor_entity_id, one.ligand_entity_id, one.receptor_auth_chains, one.resolution_angstrom, one.study_doi, one.query_status) == ("1", "2", "A;B", "3.1", "10.1/x", "resolved")
    assert [got[p].query_status for p in ("2ABC", "3ABC", "4ABC")] == ["error: 3 entities match the receptor", "error: 0 entities match the ligand", "error: no entry"]
    assert got["3ABC"].study_doi == "seed" and len(got["3ABC"]) == 17


def test_strict_csv():
    assert I.strict_csv('a,b\r\n"x, ""y""\nz",2\r\r\n,\n1') == [["a", "b"], ['x, "y"\nz', "2"], ["", ""], ["1"]]
    assert I.strict_csv("") == [] and I.strict_csv("a,") == [["a", ""]] and I.strict_csv("\n\na\n") == [[""], ["a"]] and I.strict_csv('a\n""\n\n') == [["a"], [""]]
    for bad in ('a"b', '"a"b', '"a', 'x,"a""', '"a" ,b'):
        with pytest.raises(I.InputError, match="malformed"):
            I.strict_csv(bad)
    with pytest.raises(I.InputError, match="more than 2"):
        I.strict_csv("h\n1\n2\n3\n", 2)


def test_strict_candidates(spark, tmp_path):
    path = _file(tmp_path, "s.csv", "sequence,candidate_id\n\nACD, a \n\"A\nC\",b\nX")
    assert [tuple(r) for r in I.strict_candidates(spark, path).orderBy("input_row").collect()] == [(1, "a", "ACD", "raw_sequence"), (2, "b", "A\nC", "raw_sequence"), (3, "", "X", "raw_sequence")]
    for text in ("candidate_id,other\n1,2", "candidate_id,sequence\n", "candidate_id,sequence\na,b,c", "candidate_id,sequence\na,b\na,c", ""):
        with pytest.raises(I.InputError):
            I.strict_candidates(spark, _file(tmp_path, "t.csv", text))
    with pytest.raises(I.InputError, match="more than 1"):
        I.strict_candidates(spark, path, most_raw=1)
    with pytest.raises(I.InputError, match="regular"):
        I.strict_candidates(spark, path, most_bytes=3)


def test_only_regular_files_are_read(spark, tmp_path):
    path = _file(tmp_path, "r.json", "{}")
    assert I.document(spark, path) == {}
    (tmp_path / "link.json").symlink_to(tmp_path / "r.json")
    for bad in (f"file://{tmp_path}/link.json", f"file://{tmp_path}", f"file://{tmp_path}/none.json"):
        with pytest.raises(I.InputError):
            I.regular(spark, bad, 100)


def test_candidates_over_many_tasks(spark, tmp_path):
    """Fields with line ends, commas and doubled quotes, across the borders of tasks; rows are numbered from 1, blank lines aren't counted."""
    import csv
    import random

    draw = random.Random(5)
    rows = [(f"c{k}", "".join(draw.choice(["A", "C", "\n", ",", '"', " ", "é", "\r\n"]) for _ in range(draw.randrange(0, 9)))) for k in range(4000)]
    path = tmp_path / "many.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(["candidate_id", "sequence"])
        for k, r in enumerate(rows):
            out.writerow(r)
            if k % 50 == 0:
                f.write("\r\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 20
        got = {r.input_row: (r.candidate_id, r.sequence) for r in I.candidates(spark, str(path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {k: r for k, r in enumerate(rows, 1)}


@pytest.mark.parametrize("text, said", [("a,A\nb,C,D\n", "row 2: too many"), ('a,A\nb,C"D"\nc,"E"\n', "row 2"), ('a,"A"x\n', "row 1"), ('a,"A\n', "never closed")])
def test_malformed_candidates_name_their_row(spark, tmp_path, text, said):
    with pytest.raises(I.InputError, match=said):
        I.candidates(spark, _file(tmp_path, "a.csv", "candidate_id,sequence\n" + text))


def test_locked_predictions_go_by_numbers_of_any_length(spark, tmp_path):
    ids = ["p10", "p9", "p123456789012345", "p0011", "p"]
    path = _file(tmp_path, "a.csv", "peptide_id,tier\n" + "".join(f"{i},x\n" for i in ids))
    assert [r.peptide_id for r in I.locked_predictions(spark, path, ["peptide_id", "tier"]).collect()] == ["p", "p9", "p10", "p0011", "p123456789012345"]


@pytest.mark.parametrize("step", range(6))
def test_a_crash_leaves_old_or_new(spark, tmp_path, monkeypatch, step):
    """The process ends before any of the moves; the next call, or recover(), leaves all old or all new, and nothing else."""
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    one, two = spark.range(1).withColumn("x", F.lit("old")), spark.range(1).withColumn("x", F.lit("new"))
    O.write_together({a: one, b: one})
    moves, move, finish = [], O._move, O._finish

    class Ended(BaseException):
        pass

    def counted(fs, x, y):
        if len(moves) == step:
            raise Ended
        moves.append(1)
        move(fs, x, y)

    def ended(*_):
        raise Ended

    if step == 5:  # before the journal is read at all
        monkeypatch.setattr(O, "_finish", ended)
    else:
        monkeypatch.setattr(O, "_move", counted)
    if step == 4:
        O.write_together({a: two, b: two}, overwrite=True)
    else:
        with pytest.raises(Ended):
            O.write_together({a: two, b: two}, overwrite=True)
    monkeypatch.setattr(O, "_move", move)
    monkeypatch.setattr(O, "_finish", finish)
    assert O.recover(spark, str(tmp_path)) == (0 if step == 4 else 1)
    assert [spark.read.csv(p, header=True).first().x for p in (a, b)] == ["new", "new"]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["a", "b"]


def test_one_file_is_replaced_by_one_rename(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "f")
    O.write_file(spark, path, b"old")

    def ended(*_):
        raise OSError("ended")

    monkeypatch.setattr(O, "_rename_over", ended)
    with pytest.raises(OSError, match="ended"):
        O.write_file(spark, path, b"new", overwrite=True)
    assert (tmp_path / "f").read_bytes() == b"old" and not [p for p in tmp_path.iterdir() if "staged" in p.name]
    monkeypatch.undo()
    O.write_file(spark, path, b"new", overwrite=True)
    assert (tmp_path / "f").read_bytes() == b"new"
