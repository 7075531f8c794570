"""A training corpus from raw documents: filters, near-duplicates, mixture and packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the stages before it kept, and returns
the columns of documents as they came, the last one packed pieces. Rows go to Parquet between
stages. Null and empty texts, repeated rows and empty tables are handled as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import common as C


#: Fingerprints of a text; near copies that one of them misses are found by another.
PRINTS = 12
#: What the mixture is asked for; sources share by their tempered tokens, as do the values that aren't named.
TARGETS = {"lang": {"en": 0.6}, "topic": {"legal": 0.03, "table": 0.04}}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; the model learns from the labelled documents of sf_dir."""
    from strandwise.llm.toxicity import ToxicPassages

    return ToxicPassages.fit(docs, C.table(spark, sf_dir, "labels"), F.lit(True)).keep_clean(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, ambiguous ones and those too far from all languages go.

    A fifth of the texts, by their hash, is held out to measure what is too far.
    """
    from strandwise.llm.langid import OutputCodes

    held_out = F.pmod(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(5)) == 0
    return OutputCodes.fit(docs, ~held_out).measure(docs, held_out).keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; rows that repeat it go too.

    Texts are linked where one of several fingerprints differs by four bits at most.
    """
    from strandwise.llm.simhash import keep_one

    return keep_one(docs, prints=PRINTS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities that are raked to the target weights."""
    from strandwise.llm.mixing import sample

    return sample(docs, targets=TARGETS, strict=False)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary length, with their ids' checksums."""
    from strandwise.llm.packing import pack_pieces

    return pack_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: Learned models and tokenizers aren't SQL: the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written below the shared folder and read again; what a stage has read goes when it has written."""
    docs, before = C.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        folder = C.SharedFolder.create(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(f"{folder.uri}/docs")
        docs = spark.read.parquet(f"{folder.uri}/docs")
        if before:
            before.drop()
        before = folder
    return docs
