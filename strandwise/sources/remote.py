"""Files and JSON documents of remote sources. Whoever calls may pass an opener, a function from a URL to a binary stream; tests pass files."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.request import urlopen

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.sources.files import InputError

Opener = Callable[[str], BinaryIO]
#: Fixed addresses of the structure records.
ENTRY_URL = "https://data.rcsb.org/rest/v1/core/entry/{}"
ENTITY_URL = "https://data.rcsb.org/rest/v1/core/polymer_entity/{}/{}"


def open_url(url: str, seconds: float = 60) -> BinaryIO:
    if not url.startswith("https://"):
        raise InputError(f"no https address: {url}")
    return urlopen(url, timeout=seconds)


def listed_files(sources: DataFrame, source_id: str | None = None, roles: list[str] | None = None) -> DataFrame:
    """source, role, name, url and sha256 of the files in a manifest's documents (id, document)."""
    kind = "struct<files:array<struct<path:string,download_url:string,sha256:string,role:string>>>"
    files = sources.filter(F.lit(True) if source_id is None else F.col("id") == source_id).select("id", F.explode(F.from_json("document", kind)["files"]).alias("f"))
    chosen = files.filter(F.lit(True) if roles is None else F.col("f.role").isin(roles))
    return chosen.select(F.col("id").alias("source"), F.col("f.role").alias("role"), F.element_at(F.split("f.path", "/"), -1).alias("name"), F.col("f.download_url").alias("url"), F.lower(F.trim("f.sha256")).alias("sha256"))


def fetched(files: DataFrame, folder: str, opener: Opener = open_url) -> DataFrame:
    """files (with name, url and sha256) with `bytes`, `found_sha256` and `error`; a file is in the shared folder under its name if it has no error.

    Tasks fetch, some megabytes at a time, into a name of their own beside the file's; only what has the right checksum takes its
    place, by one rename, so a failed or repeated fetch leaves what was there. Rows of one name with other contents are errors,
    as are rows that lack a field.
    """
    from strandwise.operators.graph import cut

    names = ["__name", "__url", "__sha256"]
    asked = files.select(*(F.col(c).alias(f"__{c}") for c in ("name", "url", "sha256"))).distinct()
    taken = asked.groupBy(F.col("__name").alias("__of")).agg(F.count("*").alias("__n"))
    asked = asked.join(taken, F.col("__name").eqNullSafe(F.col("__of"))).select(*names, "__n")

    def one(fs, root: str, name: str, url: str, expected: str) -> tuple[int | None, str | None, str | None]:
        own, digest, size = f"{root}/.{name}.{uuid.uuid4().hex}", hashlib.sha256(), 0
        try:
            with opener(url) as stream, fs.open_output_stream(own) as out:
                while block := stream.read(4 << 20):
                    digest.update(block)
                    out.write(block)
                    size += len(block)
            if digest.hexdigest() != expected:
                return size, digest.hexdigest(), "another checksum"
            fs.move(own, f"{root}/{name}")
            return size, expected, None
        except (OSError, ValueError) as e:
            return None, None, f"error: {e}"
        finally:
            if fs.get_file_info(own).type.name == "File":
                fs.delete_file(own)

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        for batch in batches:
            out = []
            for *row, n in batch.itertuples(index=False):
                lacks = [c[2:] for c, v in zip(names, row, strict=True) if not v]
                error = f"lacks {', '.join(lacks)}" if lacks else "several files have this name" if n > 1 else None
                out.append((*row, *((None, None, error) if error else one(fs, root, *row))))
            yield pd.DataFrame(out, columns=[*names, "bytes", "found_sha256", "error"])

    found = cut(asked.mapInPandas(fetch, "__name string, __url string, __sha256 string, bytes long, found_sha256 string, error string"))
    same = [F.col(c[2:]).eqNullSafe(F.col(c)) for c in names]
    return files.join(found, same).drop(*names)


def json_documents(urls: DataFrame, opener: Opener = open_url, most_bytes: int = 16 << 20) -> DataFrame:
    """urls (with a column url) with `document` and `error`: every distinct address is asked once, by the tasks, and a failure is a row's error."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url in batch["__url"]:
                try:
                    with opener(url) as stream:
                        body = stream.read(most_bytes + 1)
                    if len(body) > most_bytes:
                        raise InputError(f"more than {most_bytes} bytes")
                    json.loads(body)
                    out.append((url, body.decode("utf-8"), None))
                except (OSError, ValueError) as e:
                    out.append((url, None, f"error: {e}"))
            yield pd.DataFrame(out, columns=["__url", "document", "error"])

    asked = urls.select(F.col("url").alias("__url")).filter("__url is not null").distinct().mapInPandas(ask, "__url string, document string, error string")
    return urls.join(asked, F.col("url") == F.col("__url"), "left").drop("__url")


def structure_documents(seeds: DataFrame, opener: Opener = open_url) -> tuple[DataFrame, DataFrame]:
    """(pdb_id, document, error) of the seeds' entries and (pdb_id, entity_id, document, error) of the entities that these list."""
    from strandwise.operators.graph import cut

    at = lambda template, *c: F.format_string(template.replace("{}", "%s"), *c)
    entries = cut(json_documents(seeds.select("pdb_id").distinct().withColumn("url", at(ENTRY_URL, "pdb_id")), opener))
    ids = F.from_json("document", "rcsb_entry_container_identifiers struct<polymer_entity_ids:array<string>>")["rcsb_entry_container_identifiers"]["polymer_entity_ids"]
    listed = entries.select("pdb_id", F.explode(ids).alias("entity_id")).withColumn("url", at(ENTITY_URL, "pdb_id", F.url_encode("entity_id")))
    return entries.drop("url"), cut(json_documents(listed, opener)).drop("url")
