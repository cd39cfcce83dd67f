"""The training-corpus pipeline: language ID, near-duplicates, decontamination,
secret redaction, packing. Each stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from breathline.llm import decontam, langid, neardup, packing, secret_scan
from breathline.llm.common import discard, materialise, scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those with narrow margins go.

    Null and empty texts and texts without a letter have no language and go. Rows are
    judged alone, those with null or repeated ids too; all columns stay.
    """
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each near-duplicate class.

    Repeated rows stay once; different texts of the id that stays all stay, as do
    rows with a null id and null, empty or wordless texts.
    """
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the contamination limit, without passages of the benchmark.

    Null and wordless texts stay as they are. Rows are judged alone, repeated ones too.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; null and empty texts stay as they are."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their ids, sequence and offset.

    A null or empty text is its end id alone; repeated rows are packed each. The
    sequences are what a training run reads: ids of one sequence_id by offset.
    """
    # Executors still hold what earlier stages took, so workers keep small tables.
    return packing.pack_documents(docs, with_ids=True, max_pieces=250_000)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("packing", pack),
]

#: Compression, MinHash and byte-pair stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one written as Parquet and read again.

    What a stage wrote on its way is deleted once its result is written, and that
    once the next stage's is; the last result stays.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs, path = materialise(stage(spark, docs, sf_dir), name, keep=True)
        discard(spark, *filter(None, [before]))
        before = path
    return docs
