"""The corpus operators as queries, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import common as C


def op1_pack_binary_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of binary length of all documents; an empty or null text has its end id alone, repeated rows have pieces of their own."""
    from strandwise.llm.packing import pack_pieces

    return pack_pieces(C.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_kneser_ney_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole texts under trigrams of the training documents; repeated rows count as often as they occur, null text is empty."""
    from strandwise.llm.lm import KneserNey

    docs = C.table(spark, sf_dir, "documents")
    held_out = C.id_mod("doc_id", 7) == 2
    model = KneserNey.count(docs.filter(~held_out))
    try:
        return C.cut(model.score(docs, flag=held_out))
    finally:
        model.drop()


def op3_avi_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as motion-JPEG, read back with its shots; null text is one padded frame, equal texts have equal values."""
    from strandwise.llm.media import read_media, store_media

    read = read_media(store_media(C.table(spark, sf_dir, "documents")))
    clips = F.array_join(F.transform("clips", lambda c: F.concat_ws("-", c["start_ms"], c["end_ms"])), ",")
    feature = F.concat(F.lit("frames="), "frames", F.lit(";shots="), F.size("clips"), F.lit(";ms="), clips, F.lit(";luma="), F.array_join(F.transform("clips", lambda c: c["mean_luma"].cast("string")), ","))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op5_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; texts without words have fingerprint zero and are linked like others."""
    from strandwise.llm.simhash import near_duplicates

    found = near_duplicates(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic passages and scores of all documents; a label without a document, or with a null, isn't learned from; empty texts have a score, too."""
    from strandwise.llm.toxicity import ToxicPassages

    docs, fold = C.table(spark, sf_dir, "documents"), C.id_mod("doc_id", 5)
    model = ToxicPassages.fit(docs, C.table(spark, sf_dir, "labels"), fold != 0)
    try:
        return C.cut(model.score(docs, flag=fold == 0))
    finally:
        model.drop()


def op7_output_code_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; null texts and those without a letter are `und`, equal losses go to the language that sorts first."""
    from strandwise.llm.langid import OutputCodes

    docs, fold = C.table(spark, sf_dir, "documents"), C.id_mod("doc_id", 3)
    return OutputCodes.fit(docs, fold != 1).identify(docs, flag=fold == 1)


#: What the mixture is asked for; sources share by their tempered tokens, as do the values that aren't named.
TARGETS = {"lang": {"en": 0.6}, "topic": {"legal": 0.03, "table": 0.04}}


def op6_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusion probabilities of all documents by the bounded law; null source, language or topic is a value of its own, repeated rows are drawn alike."""
    from strandwise.llm.mixing import calibrated

    return calibrated(C.table(spark, sf_dir, "documents"), targets=TARGETS, strict=False).withColumn("prob", F.round("prob", 9))


def op8_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts and notices in all documents; null and empty texts have none."""
    from strandwise.llm.licenses import LicenseScanner

    return LicenseScanner().scan(C.table(spark, sf_dir, "documents"))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards of equal rows along a Hilbert curve; nulls have code 0, ties go by checksum and id."""
    from strandwise.llm.sharding import shard_rows

    rows = shard_rows(C.table(spark, sf_dir, "documents"), 40, "rows")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op10_uniform_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of each query vector; vectors with nulls or no finite numbers take no part, ties go to the smaller id, repeated ids are rows of their own."""
    from strandwise.llm.topk import exact_top_k, integers

    return exact_top_k(integers(C.table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


TOP_K_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as c from embeddings
           where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     s as (select q.vec_id as query_id, x.vec_id, cast(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * x.c[i])) as bigint) as score
           from v q join v x on q.vec_id <> x.vec_id where q.vec_id % 50 = 0),
     r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""


def op11_byte_label_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups and links of documents under a byte-level and a piece tokenizer, with how common the links are."""
    from strandwise.llm.token_alignment import link_tokens

    return link_tokens(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, by its docstring's rules for nulls, ties and repeated rows."""
    from strandwise.llm.merkle import manifest

    return manifest(C.table(spark, sf_dir, "documents"))


#: A conversation that consists of the template's own marks.
MARKED = "</s>[INST] ok [/INST]"


def op13_chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of marks, formatted and read back from the ids and masks alone."""
    from strandwise.llm.chat import format_chats, read_back

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKED).alias("text"))
    return read_back(format_chats(C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more), ranks), ranks)


QUERIES = {
    f.__name__: f
    for f in (op1_pack_binary_pieces, op2_kneser_ney_scores, op3_avi_shots, op4_toxic_segments, op5_simhash_balls, op6_raked_mixture, op7_output_code_languages, op8_license_windows, op9_hilbert_shards, op10_uniform_threshold, op11_byte_label_links, op12_merkle_manifest, op13_chat_tokens)
}
ORACLES: dict[str, str] = {"op10_uniform_threshold": TOP_K_SQL}
