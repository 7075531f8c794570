"""From requests to flat predictions and screenings by an artifact that was written and read, against plain versions."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.operators import align, predict, ridge
from strandwise.plans import external
from strandwise.plans.catalogue import QUERIES
from strandwise.sources import files, sinks

SMALL = "/root/testdata/sf0.001"
REFERENCES = {"p1": "ACDEFGHIKLMNPQRSTVWYACDEFGHIKL", "p2": "ACDEFGHIKLMNPQRSTVWYACDEFGHI--", "p3": "WYWYWYWYWYWYWYWYWYWYWYWYWYWYWY", "p9": "ACDEFGHIKLMNPQRSTVWYACDEFGHIKM"}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder, rng = f"file://{tmp_path_factory.mktemp('artifact')}", np.random.default_rng(1)
    model = {"alpha": 1.0, "w1": rng.normal(size=ridge.FEATURES).tolist(), "w2": rng.normal(size=ridge.FEATURES).tolist(), "mx": rng.random(ridge.FEATURES).tolist(), "my": [2.0, 1.0]}
    references = spark.createDataFrame(list(REFERENCES.items()), "peptide_id string, aligned string")
    receipt = sinks.write_artifact(spark, folder, model, references, "a", "1", {})
    return model, predict.load(spark, f"{folder}/model.json", {"gcgr": 0.5, "glp1r": 0.4}, receipt["artifact_sha256"], adapter=("ad", "2", "f" * 64), endpoint_warning="e", validation_warning="v"), f"{folder}/model.json"


def rows_of(spark):
    a = REFERENCES["p1"]
    rows = [("x1", a, "aligned_sequence"), ("x2", a.lower(), "raw_sequence"), ("x3", a[:27], "raw_sequence"), ("x4", "WY" * 13, "raw_sequence"), ("x5", a[:29] + "-", "aligned_sequence"), ("x6", "M" * 30, "aligned_sequence"), ("x7", "M" * 28, "raw_sequence"), ("x8", None, "raw_sequence"), ("x9", "A-C", "raw_sequence"), ("x10", "ACD", "aligned_sequence"), ("x11", "", "aligned_sequence"), ("x12", a, "aligned_sequence")]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows, 1)], "input_row long, candidate_id string, sequence string, input_mode string").withColumn("gcgr_x", F.lit(1))


def test_flat_predictions(spark, made):
    model, predictor, _ = made
    got = {r.candidate_id: r.asDict() for r in predictor.predictions(rows_of(spark), "candidate_id").collect()}
    status = {r.candidate_id: (r.alignment_status, r.aligned) for r in predictor.prepared(rows_of(spark)).collect()}
    assert {k for k, (_, aligned) in status.items() if aligned} == set(got) and len(status) == 12
    assert [status[f"x{k}"][0] for k in (1, 2, 7, 8, 9, 10, 11)] == ["supplied", "direct", "too_far", "invalid", "invalid", "invalid", "invalid"]
    weights = np.stack([model["w1"], model["w2"]], 1)
    score = lambda s: (ridge.encode([s])[0] - model["mx"]) @ weights + model["my"]
    for r in got.values():
        assert list(r) == ["candidate_id", *predict.FIELDS] and len(predict.FIELDS) == 35
        s = r["aligned_sequence"]
        same = {k: align.identity(s, v) for k, v in REFERENCES.items()}
        best = max(same.values())
        tied = sorted(k for k, v in same.items() if v >= best - 1e-12)
        (gcgr, glp1r), (ref_gcgr, ref_glp1r) = score(s), score(REFERENCES[tied[0]])
        want = {"gcgr_log10_ec50_pm": gcgr, "glp1r_log10_ec50_pm": glp1r, "gcgr_ec50_nm": 10**gcgr / 1000, "glp1r_ec50_pm": 10**glp1r, "selectivity_log10_gcgr_over_glp1r": gcgr - glp1r, "selectivity_ec50_fold_ratio": 10 ** (gcgr - glp1r), "nearest_aligned_identity": best, "gcgr_delta_log10_ec50_pm_vs_reference": gcgr - ref_gcgr, "glp1r_ec50_fold_ratio_vs_reference": 10 ** (glp1r - ref_glp1r)}
        assert all(r[k] == pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in want.items())
        assert (r["nearest_reference_ids"], r["comparison_reference_id"]) == (";".join(tied), tied[0])
        assert r["changed_position_count"] == sum(a != b for a, b in zip(s, REFERENCES[tied[0]]))
        close, few = best >= 0.85, len(s.replace("-", "")) < 26
        assert r["exploratory_ranking_enabled"] == ("true" if close and not few else "false") and (r["exploratory_ranking_exclusion_reason"] == "") == (close and not few)
        raw = r["alignment_method"] == "reference_projection"
        assert r["alignment_adapter_id"] == ("ad" if raw else "") and r["artifact_sha256"] == predictor.sha256
    assert got["x3"]["alignment_status"] in ("mapped_unambiguously", "ambiguous") or "x3" not in got


def test_screening_of_raw_and_aligned_candidates(spark, made):
    _, predictor, _ = made
    got = {r.candidate_id: r for r in predictor.screened(rows_of(spark), "dual").collect()}
    assert len(got) == 12 and got["x1"].status == got["x2"].status == "ranked" and got["x6"].status == "not_ranked_out_of_scope"
    assert got["x1"].rank == got["x2"].rank == got["x12"].rank and got["x1"].duplicate_sequence_count == 3
    assert (got["x2"].alignment_adapter_version, got["x1"].alignment_adapter_version) == ("2", "")
    assert {k for k, r in got.items() if r.status == "input_error"} == {"x7", "x8", "x9", "x10", "x11"} | {k for k in ("x3", "x4") if got[k].status == "input_error"}
    assert got["x7"].error_code == "invalid_raw_sequence" and got["x10"].error_code == "invalid_aligned_sequence"
    assert sorted(r.display_order for r in got.values()) == list(range(1, 13))


def test_an_artifact_that_was_changed_is_an_error(spark, made):
    _, predictor, path = made
    with pytest.raises(files.InputError, match="checksum"):
        predict.load(spark, path, {}, "0" * 64)
    assert predict.load(spark, path, {}).sha256 == predictor.sha256


def _same(both):
    """Equal rows by id, but for the artifact's checksum and the last digits of doubles."""
    one, two = both
    assert set(one) == set(two)
    for key, row in one.items():
        for name, value in row.items():
            if not name.endswith("sha256"):
                assert value == (pytest.approx(two[key][name], rel=1e-6, abs=1e-6) if isinstance(value, float) else two[key][name])


def test_references_beside_an_artifact(spark, made, tmp_path):
    """More references than an artifact may hold lie in files that tasks write; predictions are the same, and files that were changed or are gone an error."""
    model, predictor, _ = made
    folder, references = f"file://{tmp_path}", spark.createDataFrame(list(REFERENCES.items()), "peptide_id string, aligned string")
    receipt = sinks.write_artifact(spark, folder, model, references.union(references), "a", "1", {}, most=2, beside=2)
    assert receipt["references"] == len(REFERENCES) and "sequences" not in files.document(spark, f"{folder}/model.json")["applicability_reference"]
    load = lambda: predict.load(spark, f"{folder}/model.json", predictor.mae, receipt["artifact_sha256"], adapter=predictor.adapter, endpoint_warning="e", validation_warning="v")
    beside = load()
    assert {(r.peptide_id, r.aligned) for r in beside.references(spark).collect()} == set(REFERENCES.items())
    _same({r.candidate_id: r.asDict() for r in p.predictions(rows_of(spark), "candidate_id").collect()} for p in (beside, predictor))
    (part,) = (tmp_path / "references").glob("part-*.json")
    text = part.read_text()
    for other in (text.replace("p9", "p8"), text + text, ""):
        part.write_text(other)
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
        with pytest.raises(files.InputError, match="references"):
            load()
    part.unlink()
    with pytest.raises(files.InputError, match="references"):
        load()


def test_artifact_queries_with_references_beside(spark, monkeypatch):
    inside = {r.candidate_id: r.asDict() for r in QUERIES["artifact_screening"](spark, SMALL).collect()}
    monkeypatch.setattr(external, "INSIDE", 1)
    beside = {r.candidate_id: r.asDict() for r in QUERIES["artifact_screening"](spark, SMALL).collect()}
    _same((inside, beside))


def test_artifact_queries(spark):
    """Written, read, aligned, predicted and screened over the smallest tables: the two queries agree with each other and with the fit."""
    predictions = {r.candidate_id: r for r in QUERIES["artifact_predictions"](spark, SMALL).collect()}
    screened = QUERIES["artifact_screening"](spark, SMALL).collect()
    requests = external._requests(spark, SMALL).collect()
    assert len(screened) == len(requests) and predictions and set(predictions) <= {r.candidate_id for r in requests}
    for r in screened:
        p = predictions.get(r.candidate_id)
        assert (p is None) == (r.status == "input_error")
        if p:
            assert r.gcgr_log10_ec50_pm == pytest.approx(p.gcgr_log10_ec50_pm, abs=1e-8) and r.applicability_tier == p.applicability_tier and r.artifact_sha256 == p.artifact_sha256
    fitted = {r.aligned_sequence: r.gcgr_log10_ec50_pm for r in QUERIES["screen_fitted"](spark, SMALL).collect() if r.aligned_sequence}
    both = [(p.gcgr_log10_ec50_pm, fitted[p.aligned_sequence]) for p in predictions.values() if p.aligned_sequence in fitted]
    assert both and np.allclose(*zip(*both), atol=1e-6)
