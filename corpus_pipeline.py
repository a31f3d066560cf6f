"""Corpus pipeline: language ID, near duplicates, benchmark decontamination, secret scans, SentencePiece encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from readqc.llm import decontaminate, jaccard_join, language_crf, secret_scan, sentencepiece_rounds
from readqc.llm.common import Workspace, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null and empty texts, those without a letter, and those with less than 0.3
    of their words in one language. Repeated rows and null ids are judged by their texts."""
    return language_crf.keep_identified(docs, language_crf.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; rows with a null id stay, as do texts
    without words. Of rows left that repeat an id the smallest text stays."""
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are mostly such passages go. Null and empty texts stay; an
    empty benchmark changes nothing."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark. All rows stay, null texts as they are."""
    return secret_scan.redact_secrets(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, with their count and digests. A null or empty text has none."""
    return sentencepiece_rounds.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("encoding", encoding)]

#: SQL can't express the language and encoding stages. The tests hold the rows of each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet to the shared folder and read again; what the stage after has
    read is deleted."""
    ws, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.stage(stage(spark, docs, sf_dir), name)
        ws.keep_only(docs)
    return docs
