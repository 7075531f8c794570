"""Predictions by a loaded artifact: raw or aligned sequences in, flat rows and screenings out.

Distinct sequences are normalised, projected onto the artifact's references where they are raw, scored by its
coefficients and held against the references once; rows join what their sequence has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions import sequences as S
from strandwise.operators import align as A
from strandwise.operators import identity as I
from strandwise.operators import screening as C
from strandwise.operators.graph import cut
from strandwise.operators.ridge import encode

#: The fields of a flat prediction, in their order.
FIELDS = """original_sequence aligned_sequence alignment_method alignment_status alignment_reference_ids
alignment_adapter_id alignment_adapter_version alignment_adapter_sha256
glp1r_log10_ec50_pm glp1r_ec50_pm glp1r_ec50_nm gcgr_log10_ec50_pm gcgr_ec50_pm gcgr_ec50_nm
selectivity_log10_gcgr_over_glp1r selectivity_ec50_fold_ratio selectivity_interpretation
applicability_tier nearest_aligned_identity nearest_reference_ids standard_residue_count
exploratory_ranking_enabled exploratory_ranking_exclusion_reason comparison_reference_id changed_position_count
glp1r_delta_log10_ec50_pm_vs_reference gcgr_delta_log10_ec50_pm_vs_reference
glp1r_ec50_fold_ratio_vs_reference gcgr_ec50_fold_ratio_vs_reference
software_version artifact_id artifact_version artifact_sha256 endpoint_warning validation_warning""".split()


@dataclass(frozen=True)
class Predictor:
    """A validated artifact with its checksum, and what is said of its errors and of the aligner of raw sequences."""

    artifact: dict
    sha256: str
    mae: dict[str, float]
    adapter: tuple[str, str, str] = ("", "", "")
    software_version: str = "0.2"
    endpoint_warning: str = ""
    validation_warning: str = ""
    path: str = ""  # of the artifact, whose references may lie in files beside it

    def said(self) -> C.Model:
        return C.Model(self.artifact["artifact_id"], self.artifact["artifact_version"], self.sha256, self.mae, self.software_version, {"endpoint": self.endpoint_warning, "validation": self.validation_warning}, self.adapter)

    def references(self, spark: SparkSession) -> DataFrame:
        """peptide_id and aligned."""
        from strandwise.sources import files

        return files.artifact_references(spark, self.artifact, self.path)

    def scored(self, distinct: DataFrame) -> DataFrame:
        """aligned, gcgr and glp1r."""
        model = self.artifact["model"]
        mean, target, weights = (np.array(model[k], float) for k in ("feature_mean", "target_mean", "coefficients"))

        def score(batches):
            for batch in batches:
                y = (encode(batch.column(0).to_pylist()) - mean) @ weights + target
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y[:, 0]), pa.array(y[:, 1])], ["aligned", "gcgr", "glp1r"])

        return distinct.select("aligned").mapInArrow(score, "aligned string, gcgr double, glp1r double")

    def prepared(self, rows: DataFrame, near: bool = False) -> DataFrame:
        """rows (sequence, input_mode) with aligned (null if there is none), alignment_method and alignment_status.

        input_mode is raw_sequence or aligned_sequence; the status of a row that has no aligned sequence says why: with near,
        which costs less, that of one that no reference comes near to is too_far, ambiguous or not.
        """
        raw = F.col("input_mode") == "raw_sequence"
        (plain, plain_error), (fixed, fixed_error) = S.normalise(F.col("sequence"), aligned=False), S.normalise(F.col("sequence"))
        checked = rows.withColumns({"__raw": F.when(raw, plain), "__fixed": F.when(~raw, fixed), "__error": F.when(raw, plain_error).otherwise(fixed_error)})
        bare = F.replace("__raw", F.lit(S.GAP), F.lit(""))
        checked = cut(checked.withColumn("__raw", F.when(F.col("__raw") == bare, bare)))  # a gap is no residue of a raw sequence
        placed = A.prepared(checked.filter("__raw is not null").select(F.col("__raw").alias("raw")).distinct(), self.references(rows.sparkSession).select("aligned"), near)
        placed = placed.select(F.col("raw").alias("__of"), F.col("aligned").alias("__placed"), F.col("status").alias("__fate"))
        both = checked.join(placed, F.col("__raw") == F.col("__of"), "left")
        fate = F.when(raw, F.coalesce("__fate", F.lit("invalid"))).otherwise(F.when(F.col("__error").isNull(), "supplied").otherwise("invalid"))
        made = both.withColumns({"aligned": F.coalesce("__placed", "__fixed"), "alignment_method": F.when(raw, "reference_projection").otherwise("supplied_alignment"), "alignment_status": fate})
        return made.drop("__raw", "__fixed", "__error", "__of", "__placed", "__fate")

    def assessed(self, distinct: DataFrame) -> DataFrame:
        """aligned, gcgr, glp1r, identity, ids of the nearest references, and of the first of them its id (first_id), sequence (ref) and scores (ref_gcgr, ref_glp1r)."""
        references = cut(self.references(distinct.sparkSession))
        donors = references.select("aligned", F.lit(None).cast("int").alias("fold"), F.col("peptide_id").alias("first_id"), F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"))
        near = I.nearest(distinct.select("aligned", F.lit(None).cast("int").alias("fold")), donors).select("aligned", "identity", "ids", "first_id")
        own = self.scored(references.select("aligned")).select(F.col("aligned").alias("ref"), F.col("gcgr").alias("ref_gcgr"), F.col("glp1r").alias("ref_glp1r"))
        of = references.select(F.col("peptide_id").alias("__id"), F.col("aligned").alias("ref")).join(own, "ref")
        return near.join(self.scored(distinct.distinct()), "aligned").join(of, F.col("first_id") == F.col("__id")).drop("__id")

    def predictions(self, rows: DataFrame, key: str) -> DataFrame:
        """key and FIELDS of every row (sequence, input_mode) that has an aligned sequence; rows of others aren't there, prepared() says why."""
        ready = cut(self.prepared(rows, near=True).filter(F.col("aligned").isNotNull()))
        found = ready.join(self.assessed(ready.select("aligned").distinct()), "aligned")
        return found.select(key, *(c.alias(f) for f, c in self._fields().items()))

    def _fields(self) -> dict[str, Column]:
        few, tier, raw = S.residues(F.col("aligned")), S.tier(F.col("identity")), F.col("input_mode") == "raw_sequence"
        reasons = F.concat_ws(" ", F.when(tier != "close_analogue", F.concat(F.lit("applicability_tier="), tier)), F.when(few < C.RESIDUES, F.format_string(f"standard_residue_count=%d is below {C.RESIDUES}", few)))
        selectivity, ten = F.col("gcgr") - F.col("glp1r"), lambda x: F.pow(F.lit(10.0), x)
        per_receptor = {}
        for r in ("glp1r", "gcgr"):
            per_receptor |= {f"{r}_log10_ec50_pm": F.col(r), f"{r}_ec50_pm": ten(F.col(r)), f"{r}_ec50_nm": ten(F.col(r)) / 1000}
            delta = F.col(r) - F.col(f"ref_{r}")
            per_receptor |= {f"{r}_delta_log10_ec50_pm_vs_reference": delta, f"{r}_ec50_fold_ratio_vs_reference": ten(delta)}
        made = per_receptor | {
            "original_sequence": S.spreadsheet_safe(F.col("sequence")),
            "aligned_sequence": S.spreadsheet_safe(F.col("aligned")),
            "alignment_method": F.col("alignment_method"),
            "alignment_status": F.col("alignment_status"),
            "alignment_reference_ids": F.when(raw & (F.col("alignment_status") == "mapped_unambiguously"), F.array_join("ids", ";")).otherwise(""),
            **{f"alignment_adapter_{k}": F.when(raw, v).otherwise("") for k, v in zip(("id", "version", "sha256"), self.adapter, strict=True)},
            "selectivity_log10_gcgr_over_glp1r": selectivity,
            "selectivity_ec50_fold_ratio": ten(selectivity),
            "selectivity_interpretation": S.direction(selectivity),
            "applicability_tier": tier,
            "nearest_aligned_identity": F.col("identity"),
            "nearest_reference_ids": F.array_join("ids", ";"),
            "standard_residue_count": few,
            "exploratory_ranking_enabled": F.when(reasons == "", "true").otherwise("false"),
            "exploratory_ranking_exclusion_reason": reasons,
            "comparison_reference_id": F.col("first_id"),
            "changed_position_count": S.hamming(F.col("aligned"), F.col("ref")),
            "software_version": F.lit(self.software_version),
            "artifact_id": F.lit(self.artifact["artifact_id"]),
            "artifact_version": F.lit(self.artifact["artifact_version"]),
            "artifact_sha256": F.lit(self.sha256),
            "endpoint_warning": F.lit(self.endpoint_warning),
            "validation_warning": F.lit(self.validation_warning),
        }
        return {f: made[f] for f in FIELDS}

    def screened(self, records: DataFrame, objective: str) -> DataFrame:
        """A guarded screening of records (input_row, candidate_id, sequence, input_mode), raw ones included."""
        ready = cut(self.prepared(records, near=True))
        assessed = self.assessed(ready.filter(F.col("aligned").isNotNull()).select("aligned").distinct())
        return C.screen(ready, assessed.select("aligned", "identity", "ids", "gcgr", "glp1r"), self.said(), objective)


def load(spark: SparkSession, path: str, mae: dict[str, float], sha256: str | None = None, **said) -> Predictor:
    """The artifact at a path, held against its checksum if one is given and against its contract."""
    import hashlib

    from strandwise.sources import files

    artifact = files.model_artifact(spark, path, sha256)
    found = sha256 or hashlib.sha256(files.regular(spark, path, files.DOCUMENT)).hexdigest()
    return Predictor(artifact, found.lower(), mae, path=path, **said)
