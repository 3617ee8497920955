"""Registered queries of the numbered operators and their SQL twins."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fansignal.llm.sql import ORACLE  # noqa: F401
from fansignal.sources.tables import table


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fansignal.llm.op1_minhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from fansignal.llm.op2_packing import packed_sequences
    return packed_sequences(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"),
                            public_tokenizers.PATTERN)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fansignal.llm.op3_token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fansignal.llm.op4_embeddings import embedding_links
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fansignal.llm.op5_decontamination import contaminated_words
    return contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids", "version")


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fansignal.llm.op6_passages import repeated_passages
    return repeated_passages(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fansignal.llm.op7_mixing import mix
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fansignal.llm.op8_quality import quality
    d = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "quality_score", (F.col("quality_kept") & ~F.col("quality_toxic")).alias("kept"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fansignal.llm.op9_lm_scoring import lm_scores
    return lm_scores(table(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fansignal.llm.op10_licences import known_licences, licence_scan
    return licence_scan(table(spark, sf_dir, "documents"), known_licences(spark))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fansignal.llm.op11_manifest import verified_documents
    return verified_documents(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from fansignal.llm.op12_warc import archived_pages
    from fansignal.session import shared_dir
    return archived_pages(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fansignal.llm.op13_conversations import damaged, repair_report
    return repair_report(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_minhash, op2_packing, op3_token_counts, op4_embeddings, op5_decontamination, op6_passages, op7_mixing,
                                   op8_quality, op9_lm_scoring, op10_licences, op11_manifest, op12_warc, op13_conversations)}
