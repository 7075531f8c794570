"""Remote sources, with openers that read from memory."""

import hashlib
import io
import json

from pyspark.sql import functions as F

from strandwise.operators import structures
from strandwise.sources import remote
from strandwise.sources.files import InputError

BODY = b"peptide,value\n"


def _memory(url):
    if url.endswith("gone"):
        raise OSError("not found")
    if not url.startswith("https://"):
        raise InputError("no https address")
    return io.BytesIO(BODY if url.endswith("b") else b"other")


def test_fetched_files(spark, tmp_path):
    right = hashlib.sha256(BODY).hexdigest()
    manifest = [{"id": "s", "files": [{"path": "a/b.csv", "download_url": "https://x/b", "sha256": f" {right.upper()}", "role": "data"}, {"path": "c.csv", "download_url": "https://x/c", "sha256": right, "role": "other"}]}, {"id": "none"}]
    sources = spark.createDataFrame([(m["id"], json.dumps(m)) for m in manifest], "id string, document string")
    assert [tuple(r) for r in remote.listed_files(sources, "s", ["data"]).collect()] == [("s", "data", "b.csv", "https://x/b", right)]
    assert remote.listed_files(sources).count() == 2 and remote.listed_files(sources, "none").count() == 0
    (tmp_path / "c.csv").write_bytes(b"before")
    more = spark.createDataFrame([("d.csv", "https://x/gone", right), ("e.csv", "http://x/b", right), ("f.csv", None, right), ("g.csv", "https://x/b", right), ("g.csv", "https://x/2b", right), ("b.csv", "https://x/b", right)], "name string, url string, sha256 string")
    files = remote.listed_files(sources).select("name", "url", "sha256").unionByName(more).withColumn("__n", F.lit(1))
    got = remote.fetched(files, str(tmp_path), _memory).collect()
    errors = {r.name: r.error for r in got}
    assert len(got) == 8 and [r["bytes"] for r in got if r.name == "b.csv"] == [len(BODY)] * 2
    assert errors == {"b.csv": None, "c.csv": "another checksum", "d.csv": "error: not found", "e.csv": "error: no https address", "f.csv": "lacks url", "g.csv": "several files have this name"}
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {"b.csv": BODY, "c.csv": b"before"}


def _opened(url):
    if "/entry/" in url:
        if url.endswith("BADX"):
            raise OSError("not found")
        return io.BytesIO(json.dumps({"rcsb_entry_container_identifiers": {"polymer_entity_ids": ["1", "2"]}, "struct": {"title": "T"}}).encode())
    k = url[-1]
    return io.BytesIO(json.dumps({"rcsb_polymer_entity": {"pdbx_description": {"1": "Glucagon receptor", "2": "Peptide-X"}[k]}, "rcsb_polymer_entity_container_identifiers": {"auth_asym_ids": ["R" if k == "1" else "P"]}}).encode())


def test_structures_from_their_documents(spark):
    seeds = spark.createDataFrame([(p, "GCGR", "glucagon receptor", "X", "peptide x", "role", "10.1/x", "") for p in ("1ABC", "BADX")], "pdb_id string, receptor string, receptor_match string, ligand string, ligand_match string, benchmark_role string, study_doi string, modification_note string")
    entries, entities = remote.structure_documents(seeds, _opened)
    assert {r.pdb_id: r.error for r in entries.collect()} == {"1ABC": None, "BADX": "error: not found"} and entities.count() == 2
    got = {r.pdb_id: r for r in structures.resolve(seeds, entries.filter("document is not null"), entities).collect()}
    assert (got["1ABC"].query_status, got["1ABC"].receptor_auth_chains, got["1ABC"].ligand_entity_id) == ("resolved", "R", "2")
    assert got["BADX"].query_status.startswith("error")


def test_bodies_that_are_no_json(spark):
    urls = spark.createDataFrame([("https://a", 1), ("https://a", 2), (None, 3)], "url string, k int")
    got = {r.k: (r.document, r.error) for r in remote.json_documents(urls, lambda url: io.BytesIO(b"<html>")).collect()}
    assert got[1][0] is None and got[1][1].startswith("error") and got[2] == got[1] and got[3] == (None, None)
