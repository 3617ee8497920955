"""Corpus pipeline: documents to packed token rows.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All but the
last return the columns of ``documents``. Each stage works on all rows its predecessor
kept and states in its operator's docstring what nulls, empty texts, repeated rows and
empty tables give.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fansignal.llm.op1_minhash import near_duplicates
from fansignal.llm.op2_packing import packed_sequences
from fansignal.llm.op5_decontamination import without_contaminated
from fansignal.llm.op7_mixing import emitted, mix
from fansignal.llm.op8_quality import quality
from fansignal.sources.tables import staged, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier rejects go (those without words among them), and toxic ones."""
    return quality(docs).filter("quality_kept and not quality_toxic").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id;
    of rows that repeat an id, the one with the smallest text. Rows without id stay."""
    kept = near_duplicates(docs, k=5, percent=80).filter("kept and doc_id is not null").select("doc_id").distinct()
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    one = docs.join(kept, "doc_id", "left_semi").withColumn("nth_row", nth).filter("nth_row = 1")
    return one.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (0 to 2 times)."""
    return emitted(mix(docs), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, packed into rows."""
    import public_tokenizers
    return packed_sequences(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None   # the classifier and the sketches have no SQL form; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
