"""Screening, its outputs, and the fitted model behind it."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.operators import ridge as R
from strandwise.operators import screening as C
from strandwise.plans.catalogue import QUERIES
from strandwise.sources import files, sinks
from strandwise.sources import tables as T

SMALL = "/root/testdata/sf0.001"


def test_ranks_are_anchored_at_the_first_score_of_a_group(spark):
    def brute(scores):
        rank, anchor, out = 0, None, {}
        for s in sorted(set(scores)):
            if anchor is None or abs(s - anchor) > 1e-12:
                rank, anchor = rank + 1, s
            out[s] = rank
        return out

    chain = [1 + k * 6e-13 for k in range(9)]  # each is near the one before, but not all near the first
    for scores in (chain + [0.5, 2.0, 2.0, 3.0, 3.0 + 4e-13], [1.0, 2.0, 1.0], [], [7.0], list(np.random.default_rng(1).normal(size=60)) + chain):
        df = spark.createDataFrame([(float(s),) for s in scores], "score double")
        assert {r.score: r["rank"] for r in C.tolerance_ranks(df).collect()} == brute(scores)


def _model(**k):
    return C.Model("m", "1", "0" * 64, {"glp1r": 1.0, "gcgr": 0.5}, **k)


def _records(spark, rows):
    return spark.createDataFrame(rows, "input_row long, candidate_id string, sequence string, input_mode string, aligned string, alignment_method string, alignment_status string")


def test_screened_rows(spark):
    full, short = "A" * 30, "A" * 20 + "-" * 10
    rows = [(1, "c1", full, "provided_alignment", full, "p", "provided"), (2, "=2", full, "provided_alignment", full, "p", "provided"), (3, "c3", "??", "raw_sequence", None, "r", "x"), (4, "c4", short, "provided_alignment", short, "p", "provided"), (5, "c5", " " + full, "raw_sequence", full, "r", "mapped_unambiguously"), (6, None, full, "provided_alignment", full, "p", "provided")]
    scored = spark.createDataFrame([(full, 0.9, ["r1", "r2"], 2.0, 3.0), (short, 0.6, ["r1"], 1.0, 1.0)], "aligned string, identity double, ids array<string>, gcgr double, glp1r double")
    got = {r.input_row: r for r in C.screen(_records(spark, rows), scored, _model(adapter=("a", "v", "s")), "dual").collect()}
    assert list(next(iter(got.values())).asDict()) == [*C.COLUMNS, "display_order"] and len(C.COLUMNS) == 44
    assert [got[k].status for k in range(1, 7)] == ["ranked", "input_error", "input_error", "not_ranked_out_of_scope", "ranked", "input_error"]
    assert [got[k].display_order for k in (1, 5, 2, 3, 4, 6)] == [1, 2, 3, 4, 5, 6]
    assert got[1]["rank"] == got[5]["rank"] == 1 and got[1].score_fold_ratio_from_first == 1 and got[1].development_mae_context_log10 == 1.0
    assert (got[2].error_code, got[2].candidate_id, got[3].error_code) == ("invalid_candidate_id", "'=2", "invalid_raw_sequence")
    assert got[4].ranking_exclusion_reason == "applicability_tier=outside_reference_neighborhood; standard_residue_count=20 is below 26"
    assert got[1].duplicate_sequence_count == 2 and got[5].alignment_reference_ids == "r1;r2" and got[5].alignment_adapter_id == "a" and got[1].alignment_adapter_id == ""
    none = C.screen(_records(spark, rows[1:3]), scored, _model(), "gcgr").collect()
    assert {r.status for r in none} == {"input_error"}
    assert C.screen(_records(spark, []), scored, _model(), "gcgr").count() == 0
    with pytest.raises(ValueError):
        C.screen(_records(spark, rows), scored, _model(), "other")


def test_screening_files(spark, tmp_path):
    full = "A" * 30
    scored = spark.createDataFrame([(full, 0.9, ["r1"], 2.0, 3.0)], "aligned string, identity double, ids array<string>, gcgr double, glp1r double")
    screened = C.screen(_records(spark, [(1, "c1", full, "provided_alignment", full, "p", "provided"), (2, "", full, "provided_alignment", full, "p", "provided")]), scored, _model(), "glp1r")
    said = sinks.write_screening(screened, f"file://{tmp_path}")
    assert (said["status"], said["exit_code"], said["rows_in"]) == ("completed_with_row_errors", 1, 2)
    back = spark.read.csv(f"file://{tmp_path}/candidates.csv", header=True)
    assert back.columns == C.COLUMNS and back.count() == 2
    with pytest.raises(FileExistsError):
        sinks.write_screening(screened, f"file://{tmp_path}")


def test_one_file_whole_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/x.json"
    assert len(sinks.write_file(spark, path, b"one")) == 64
    with pytest.raises(FileExistsError):
        sinks.write_file(spark, path, b"two")
    sinks.write_file(spark, path, b"two", overwrite=True)
    assert (tmp_path / "x.json").read_bytes() == b"two"
    with pytest.raises(FileNotFoundError):
        sinks.write_file(spark, f"file://{tmp_path}/no/x.json", b"")
    (tmp_path / "folder").mkdir()
    with pytest.raises(FileExistsError):
        sinks.write_file(spark, f"file://{tmp_path}/folder", b"", overwrite=True)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["folder", "x.json"]


def test_numbers_and_wordings(spark):
    assert [sinks.number(x) for x in (0, 1.5, 0.25, 12345.678, 0.0001, -3.0, 9999.99994)] == ["0", "1.5", "0.25", "1.2346e+04", "1.0000e-04", "-3", "9999.9999"]
    df = spark.createDataFrame([(1, "training_reference_match", True, 1.0), (2, "local_analogue_mixed_evidence", True, 4.0), (3, "outside_ranking_scope", False, 0.25)], "k int, e string, r boolean, x double")
    got = df.select(sinks.comparison_status(F.col("e"), F.col("r")), sinks.validation_evidence(F.col("e")), sinks.fold_comparison(F.col("x"), "GCGR")).collect()
    assert [r[0][:9] for r in got] == ["In-sample", "Eligible ", "Do not us"] and [r[1][:5] for r in got] == ["In-sa", "Mixed", "No su"]
    assert [r[2] for r in got] == ["GCGR EC50 is unchanged from the closest development sequence.", "Query GCGR EC50 is predicted 4× higher than the closest development sequence.", "Query GCGR EC50 is predicted 4× lower than the closest development sequence."]
    assert sinks.markdown(df.select("k", "x"), "T") == "# T\n\n| k | x |\n| --- | --- |\n| 1 | 1 |\n| 2 | 4 |\n| 3 | 0.25 |\n"
    with pytest.raises(ValueError):
        sinks.markdown(df, "T", rows=2)
    text = sinks.prediction_text(spark.createDataFrame([("p", 1.0, 2.5, 0.9, "close_analogue", "outside_ranking_scope", False, "few")], "peptide_id string, gcgr double, glp1r double, identity double, tier string, evidence string, ranking_eligible boolean, exclusion_reasons string")).first().report
    assert "GLP-1R log10(EC50 / 1 pM): 2.5\n" in text and text.endswith("Not ranked: few\n")


def test_nested_selection_is_that_of_single_fits(spark, tmp_path):
    rng = np.random.default_rng(4)
    motif = ["".join(rng.choice(list("ACDE-"), 30)) for _ in range(3)]
    rows = []
    for i in range(36):
        s = list(motif[i % 3])
        for p in rng.integers(0, 30, 4):
            s[p] = rng.choice(list("ACDEF"))
        y = s.count("A") * 0.2 - s.count("F") * 0.3
        rows.append((f"p{i:02d}", f"c{i % 6}", i % 3 + 1, "".join(s), y + rng.normal(0, 0.05), -y + rng.normal(0, 0.05)))
    df = spark.createDataFrame(rows, "peptide_id string, source string, fold int, aligned string, y1 double, y2 double")
    alphas = [0.01, 1.0, 100.0]
    fits = R.Fits(df, "source", alphas)
    scores = {(r.held, r.alpha): r.score for r in fits.scores().collect()}
    chosen = {r.held: r.alpha for r in fits.selected().collect()}
    models = {r.held: r for r in fits.models(fits.selected()).collect()}
    x, y = R.encode([r[3] for r in rows]), np.array([r[4:] for r in rows])
    component, fold = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def weights(c):
        _, inverse, n = np.unique(c, return_inverse=True, return_counts=True)
        w = 1 / n[inverse]
        return w / w.mean()

    for held in (R.ALL, 1, 2, 3):
        train = fold != held
        for a in alphas:
            errors = []
            for c in np.unique(component[train]):
                rest, out = train & (component != c), train & (component == c)
                b, i = R.fit_rows(x[rest], y[rest], weights(component[rest]), a)
                errors.append(np.abs(x[out] @ b + i - y[out]).mean())
            assert scores[held, a] == pytest.approx(np.mean(errors), rel=1e-7)
        best = min(alphas, key=lambda a: (scores[held, a], a))
        assert chosen[held] == best
        b, i = R.fit_rows(x[train], y[train], weights(component[train]), best)
        assert np.allclose(models[held].w1, b[:, 0], atol=1e-7) and np.allclose([models[held].c1, models[held].c2], i, atol=1e-7)
    one = models[R.ALL].asDict()
    receipt = sinks.write_artifact(spark, f"file://{tmp_path}", one, df, "ridge", "1", {"rows": "0"})
    back = files.model_artifact(spark, f"file://{tmp_path}/model.json", receipt["artifact_sha256"])
    m = back["model"]
    again = np.array(m["target_mean"]) + (x - np.array(m["feature_mean"])) @ np.array(m["coefficients"])
    assert np.allclose(again, x @ np.stack([one["w1"], one["w2"]], 1) + [one["c1"], one["c2"]], atol=1e-9)
    assert json.loads((tmp_path / "receipt.json").read_text())["references"] == len({r[3] for r in rows})
    with pytest.raises(ValueError):
        sinks.write_artifact(spark, f"file://{tmp_path}", one, df, "ridge", "1", {}, most=1)


def test_fitted_screening_and_split(spark):
    rows = QUERIES["screen_fitted"](spark, SMALL).collect()
    assert len(rows) == T.panel(spark, SMALL).filter("doc_id % 8 <> 0").count()
    assert all(r.artifact_id == "fitted-ridge" and len(r.artifact_sha256) == 64 for r in rows)
    split = QUERIES["split_pipeline"](spark, SMALL)
    t = split.first().threshold
    assert split.groupBy("cluster_id").agg(F.countDistinct("outer_fold").alias("n")).filter("n > 1").count() == 0
    assert 0.7 <= t <= 0.95 and split.select("outer_fold").distinct().count() == 3


def test_rules_name_every_issue_and_its_place(spark):
    from strandwise.operators import rules

    inf, nan = float("inf"), float("nan")
    dataset = spark.createDataFrame(
        [(2, "a", "ACD", 3, 1.0, -12.0), (3, "a", "acd", 3, 0.0, None), (4, None, "", 9, None, 1.0), (5, "", None, None, inf, 1.0), (6, "a", "AZB", 4, 1.0, nan), (7, "b", "AC", None, 10.0, -10.9)],
        "row long, peptide_id string, sequence string, declared int, v double, l double",
    )
    alignment = spark.createDataFrame([(2, "a", "A-C", 3), (3, "c", "A*", 3), (4, "c", "", 3), (5, "d", "ACD", None)], "row long, peptide_id string, sequence string, declared int")
    got = sorted((r.sheet, -1 if r.row is None else r.row, r.code, r.first_row) for r in rules.dataset_issues(dataset, alignment, [("x", "v", "l")], 6, length=3).collect())
    assert got == sorted([
        ("dataset", 3, "duplicate_id", 2), ("dataset", 3, "invalid_ec50", None), ("dataset", 4, "missing_id", None), ("dataset", 4, "invalid_sequence", None), ("dataset", 4, "invalid_ec50", None),
        ("dataset", 5, "missing_id", None), ("dataset", 5, "invalid_sequence", None), ("dataset", 5, "invalid_ec50", None), ("dataset", 6, "duplicate_id", 2), ("dataset", 6, "invalid_residue", None),
        ("dataset", 6, "length_mismatch", None), ("dataset", 6, "invalid_log_ec50", None), ("dataset", 7, "length_mismatch", None), ("dataset", 7, "log_ec50_mismatch", None),
        ("alignment", 3, "invalid_residue", None), ("alignment", 3, "aligned_length_mismatch", None), ("alignment", 4, "duplicate_id", 3), ("alignment", 4, "invalid_sequence", None),
        ("alignment", 5, "aligned_length_mismatch", None), ("alignment", -1, "record_count", None), ("alignment", -1, "id_set_mismatch", None),
    ])
    clean = spark.createDataFrame([(2, "a", "ACD", 3, 1.0, -12.0)], "row long, peptide_id string, sequence string, declared int, v double, l double")
    assert rules.dataset_issues(clean, clean.select("row", "peptide_id", "sequence", "declared"), [("x", "v", "l")], 1, length=3).count() == 0
    none = clean.limit(0)
    assert [r.code for r in rules.dataset_issues(none, none.select("row", "peptide_id", "sequence", "declared"), [("x", "v", "l")], 1).collect()] == ["record_count"] * 2
