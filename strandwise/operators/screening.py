"""Guarded screening: candidates are checked, predicted, held against gates, ranked, and given back whole, errors included."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions import sequences as S
from strandwise.operators import graph as G

#: What each objective minimises.
OBJECTIVES = {
    "glp1r": "minimize predicted GLP-1R log10(EC50 / 1 pM)",
    "gcgr": "minimize predicted GCGR log10(EC50 / 1 pM)",
    "dual": "minimize the larger of predicted GLP-1R and GCGR log10(EC50 / 1 pM) values",
}
#: The columns of a screened row, in their order.
COLUMNS = """input_row candidate_id input_sequence input_mode aligned_sequence alignment_method alignment_status alignment_reference_ids
alignment_adapter_id alignment_adapter_version alignment_adapter_sha256 status error_code error_message ranking_objective
ranking_objective_definition ranking_eligible ranking_exclusion_reason rank ranking_score score_delta_from_first_log10
score_fold_ratio_from_first development_mae_context_log10 within_one_development_mae_of_first ranking_context glp1r_log10_ec50_pm
glp1r_ec50_pm gcgr_log10_ec50_pm gcgr_ec50_pm selectivity_log10_gcgr_over_glp1r applicability_tier applicability_evidence_state
exact_reference_match nearest_aligned_identity nearest_reference_ids standard_residue_count duplicate_sequence_count software_version
artifact_id artifact_version artifact_sha256 endpoint_warning validation_warning ranking_warning""".split()
TIE, CLOSE, RESIDUES = 1e-12, 0.85, 26


@dataclass(frozen=True)
class Model:
    """What a screening says of the model that scored it."""

    artifact_id: str
    artifact_version: str
    artifact_sha256: str
    mae: dict[str, float]  # of development rows out of fold, by receptor
    software_version: str = "0.2"
    warnings: dict[str, str] = field(default_factory=dict)  # endpoint, validation, ranking
    adapter: tuple[str, str, str] = ("", "", "")  # id, version and checksum of the aligner of raw sequences

    def mae_of(self, objective: str) -> float:
        """A receptor's own; of both the larger one."""
        return max(self.mae[r] for r in ("glp1r", "gcgr")) if objective == "dual" else self.mae[objective]


def tolerance_ranks(scores: DataFrame, tolerance: float = TIE) -> DataFrame:
    """score and rank of distinct scores: a rank's scores lie within the tolerance of its first one.

    Ranks come from range partitions. Only scores within the tolerance of the one before are looked at one
    after the other, a run of such at a time; runs are as long as doubles lie that near to each other.
    """
    ordered = G.cut(G.global_rank(scores.select("score").distinct(), [F.asc("score")], "k"))
    before = ordered.select((F.col("k") + 1).alias("k"), F.col("score").alias("before"))
    near = G.cut(ordered.join(before, "k").filter(F.col("score") - F.col("before") <= tolerance).select("k", "score", "before"))
    if near.limit(1).count() == 0:
        return ordered.select("score", F.col("k").alias("rank"))
    run = F.col("k") - F.col("place")

    def anchors(rows: pa.Table) -> pa.Table:
        found = sorted(zip(rows["score"].to_pylist(), rows["before"].to_pylist(), strict=True))
        anchor, out = found[0][1], []
        for score, _ in found:
            if abs(score - anchor) > tolerance:
                anchor = score
            out.append(anchor)
        return pa.table({"own": [s for s, _ in found], "anchor": out})

    joined = G.global_rank(near, [F.asc("k")], "place").withColumn("run", run).groupBy("run").applyInArrow(anchors, "own double, anchor double")
    of = ordered.join(joined, F.col("score") == F.col("own"), "left").select("score", F.coalesce("anchor", "score").alias("anchor"))
    first = G.global_rank(of.select(F.col("anchor").alias("at")).distinct(), [F.asc("at")])
    return of.join(first, F.col("anchor") == F.col("at")).select("score", "rank")


def screen(records: DataFrame, scored: DataFrame, model: Model, objective: str) -> DataFrame:
    """COLUMNS and display_order for every record.

    records: input_row, candidate_id, sequence, input_mode, aligned (null or all gap: invalid), alignment_method,
    alignment_status. scored: aligned, identity, ids (the nearest references), gcgr and glp1r of distinct sequences.
    Ranked rows come first by score and row, then the others by row.
    """
    if objective not in OBJECTIVES:
        raise ValueError(f"unknown objective: {objective}")
    score = {"glp1r": F.col("glp1r"), "gcgr": F.col("gcgr"), "dual": F.greatest("gcgr", "glp1r")}[objective]
    rows = records.join(scored, "aligned", "left")
    id_error, lost = S.candidate_id_error(F.col("candidate_id")), F.col("identity").isNull()
    few, tier = S.residues(F.col("aligned")), S.tier(F.col("identity"))
    bad = id_error.isNotNull() | lost
    reasons = F.concat_ws("; ", F.when(tier != "close_analogue", F.concat(F.lit("applicability_tier="), tier)), F.when(few < RESIDUES, F.format_string(f"standard_residue_count=%d is below {RESIDUES}", few)))
    rows = rows.withColumns({
        "status": F.when(bad, "input_error").when(reasons != "", "not_ranked_out_of_scope").otherwise("ranked"),
        "error_code": F.when(id_error.isNotNull(), "invalid_candidate_id").when(lost, F.when(F.col("input_mode") == "raw_sequence", "invalid_raw_sequence").otherwise("invalid_aligned_sequence")),
        "error_message": F.when(id_error.isNotNull(), id_error).when(lost, "no_valid_sequence"),
        "reasons": reasons,
        "score": score,
    })
    rows = G.cut(rows)
    ok, ranked = F.col("status") != "input_error", F.col("status") == "ranked"
    copies = rows.filter(ok).groupBy(F.col("aligned").alias("of")).agg(F.count("*").alias("copies"))
    ranks = tolerance_ranks(rows.filter(ranked)).select(F.col("score").alias("at"), "rank")
    least = rows.filter(ranked).agg(F.min("score").alias("least"))
    full = rows.join(copies, F.col("aligned") == F.col("of"), "left").join(ranks, ranked & (F.col("score") == F.col("at")), "left").join(F.broadcast(least))  # least is one row
    full = G.global_rank(full, [F.asc(F.when(ranked, 0).otherwise(1)), F.asc(F.when(ranked, F.col("score"))), F.asc("input_row")], "display_order")
    delta, mae = F.col("score") - F.col("least"), model.mae_of(objective)
    within = delta <= mae + TIE
    nine = lambda c: F.round(c, 9)
    pm = lambda c: F.round(F.pow(F.lit(10.0), c), 6)
    said: dict[str, Column] = {
        "input_row": F.col("input_row"),
        "candidate_id": S.spreadsheet_safe(F.col("candidate_id")),
        "input_sequence": S.spreadsheet_safe(F.trim("sequence")),
        "input_mode": F.col("input_mode"),
        "status": F.col("status"),
        "error_code": F.col("error_code"),
        "error_message": F.col("error_message"),
        "ranking_objective": F.lit(objective),
        "ranking_objective_definition": F.lit(OBJECTIVES[objective]),
        "software_version": F.lit(model.software_version),
        "artifact_id": F.lit(model.artifact_id),
        "artifact_version": F.lit(model.artifact_version),
        "artifact_sha256": F.lit(model.artifact_sha256),
        **{f"{w}_warning": F.lit(model.warnings.get(w, "")) for w in ("endpoint", "validation", "ranking")},
    }
    raw = F.col("input_mode") == "raw_sequence"
    valid: dict[str, Column] = {
        "aligned_sequence": S.spreadsheet_safe(F.col("aligned")),
        "alignment_method": F.col("alignment_method"),
        "alignment_status": F.col("alignment_status"),
        "alignment_reference_ids": F.when(raw & (F.col("alignment_status") == "mapped_unambiguously"), F.array_join("ids", ";")).otherwise(""),
        **{f"alignment_adapter_{k}": F.when(raw, v).otherwise("") for k, v in zip(("id", "version", "sha256"), model.adapter, strict=True)},
        "ranking_eligible": ranked,
        "ranking_exclusion_reason": F.col("reasons"),
        "glp1r_log10_ec50_pm": nine("glp1r"),
        "glp1r_ec50_pm": pm(F.col("glp1r")),
        "gcgr_log10_ec50_pm": nine("gcgr"),
        "gcgr_ec50_pm": pm(F.col("gcgr")),
        "selectivity_log10_gcgr_over_glp1r": nine(F.col("gcgr") - F.col("glp1r")),
        "applicability_tier": tier,
        "applicability_evidence_state": S.evidence(F.col("identity")),
        "exact_reference_match": F.col("identity") >= 1 - TIE,
        "nearest_aligned_identity": nine("identity"),
        "nearest_reference_ids": F.array_join("ids", ";"),
        "standard_residue_count": few,
        "duplicate_sequence_count": F.col("copies"),
    }
    placed: dict[str, Column] = {
        "rank": F.col("rank"),
        "ranking_score": nine("score"),
        "score_delta_from_first_log10": nine(delta),
        "score_fold_ratio_from_first": F.round(F.pow(F.lit(10.0), delta), 6),
        "development_mae_context_log10": F.lit(mae),
        "within_one_development_mae_of_first": within,
        "ranking_context": F.when(within, "within_one_development_mae_of_first").otherwise("more_than_one_development_mae_from_first"),
    }
    made = said | {k: F.when(ok, c) for k, c in valid.items()} | {k: F.when(ranked, c) for k, c in placed.items()}
    return full.select(*(made[c].alias(c) for c in COLUMNS), "display_order")
