"""The corpus pipeline: STAGES over documents, each one operator of tidemark.llm.

Every stage but the last returns the columns of documents; its result is written as Parquet and
read again as the next one's docs. Nulls, blank texts, repeated rows, empty tables and further
columns have the results that the operators' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import read, written
from tidemark.llm.decontaminate import without_leaks
from tidemark.llm.language_id import keep_identified
from tidemark.llm.near_dedup import keep_one
from tidemark.llm.secret_scan import redact
from tidemark.llm.sentencepiece_codec import encoded_documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told, for want of a text or of any letter, go; a missing lang is filled in."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays."""
    return keep_one(docs, ngram=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go."""
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; live-looking secrets in its text are replaced by a mark."""
    return redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document's text: doc_id, n_chars, n_pieces, ids, restored."""
    return encoded_documents(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("encode", encode),
]

#: Classifier, alignment and Viterbi can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
