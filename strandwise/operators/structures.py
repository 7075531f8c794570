"""Structure records resolved against their entities, over JSON documents that were fetched before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions import sequences as S

ENTRY = "rcsb_entry_container_identifiers struct<polymer_entity_ids:array<string>>, rcsb_entry_info struct<resolution_combined:array<double>>, rcsb_accession_info struct<initial_release_date:string>, exptl array<struct<method:string>>, struct struct<title:string>, citation array<struct<pdbx_database_id_doi:string>>"
ENTITY = "rcsb_polymer_entity struct<pdbx_description:string>, rcsb_polymer_entity_container_identifiers struct<auth_asym_ids:array<string>>"


def _pick(entities: Column, wanted: Column) -> tuple[Column, Column]:
    """(entity, number of matches): those whose text equals, if there are none those whose text contains what is wanted."""
    exact = F.filter(entities, lambda e: e["text"] == wanted)
    found = F.when(F.size(exact) > 0, exact).otherwise(F.filter(entities, lambda e: F.contains(e["text"], wanted)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))), F.size(found)


def resolve(seeds: DataFrame, entries: DataFrame, entities: DataFrame) -> DataFrame:
    """A row for each seed with its structure's facts and its receptor and ligand entities.

    entries: pdb_id, document; entities: pdb_id, entity_id, document. A seed without an entry, or
    whose receptor or ligand isn't matched by exactly one entity, stays with an error as its status.
    """
    e = entries.select("pdb_id", F.from_json("document", ENTRY).alias("e"))
    p = entities.select("pdb_id", "entity_id", F.from_json("document", ENTITY).alias("p"))
    p = p.select("pdb_id", F.struct("entity_id", S.squeeze(F.coalesce("p.rcsb_polymer_entity.pdbx_description", F.lit(""))).alias("text"), F.array_join("p.rcsb_polymer_entity_container_identifiers.auth_asym_ids", ";").alias("chains")).alias("x"))
    p = p.groupBy("pdb_id").agg(F.sort_array(F.collect_list("x")).alias("all"))  # the few chains of one structure
    rows = seeds.join(e, "pdb_id", "left").join(p, "pdb_id", "left")
    listed = F.filter(F.coalesce("all", F.array().cast("array<struct<entity_id:string,text:string,chains:string>>")), lambda x: F.array_contains(F.col("e.rcsb_entry_container_identifiers.polymer_entity_ids"), x["entity_id"]))
    rows = rows.withColumn("all", F.coalesce(listed, F.array().cast("array<struct<entity_id:string,text:string,chains:string>>")))
    r, nr = _pick(F.col("all"), S.squeeze(F.col("receptor_match")))
    rows = rows.withColumns({"r": r, "nr": nr})
    rest = F.filter("all", lambda x: x["entity_id"] != F.col("r.entity_id"))
    ligand, nl = _pick(rest, S.squeeze(F.col("ligand_match")))
    rows = rows.withColumns({"l": ligand, "nl": nl})
    doi = F.get(F.filter(F.transform("e.citation", lambda c: c["pdbx_database_id_doi"]), lambda d: d.isNotNull() & (d != "")), F.lit(0))
    status = F.when(F.col("e").isNull(), "error: no entry").when(F.col("r").isNull(), F.format_string("error: %d entities match the receptor", "nr")).when(F.col("l").isNull(), F.format_string("error: %d entities match the ligand", "nl")).otherwise("resolved")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "pdb_id", "receptor", "ligand", "benchmark_role",
        blank(F.array_join(F.transform("e.exptl", lambda m: blank(m["method"])), ";")).alias("experimental_method"),
        blank(F.get("e.rcsb_entry_info.resolution_combined", F.lit(0)).cast("string")).alias("resolution_angstrom"),
        blank(F.col("e.struct.title")).alias("title"), blank(F.col("e.rcsb_accession_info.initial_release_date")).alias("initial_release_date"),
        blank(F.col("r.entity_id")).alias("receptor_entity_id"), blank(F.col("r.chains")).alias("receptor_auth_chains"),
        blank(F.col("l.entity_id")).alias("ligand_entity_id"), blank(F.col("l.chains")).alias("ligand_auth_chains"),
        F.coalesce(doi, "study_doi").alias("study_doi"), F.format_string("10.2210/pdb%s/pdb", "pdb_id").alias("pdb_doi"),
        F.format_string("https://files.rcsb.org/download/%s.cif", "pdb_id").alias("coordinate_url"), "modification_note", status.alias("query_status"),
    )
