"""From raw documents to packed training sequences, as stages that each call one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver writes it as Parquet and reads
it again as the next stage's ``docs``. All stages but the last return the columns of ``documents``,
others that the table may have included, whatever their names. Null ids and sources, repeated rows and
empty tables pass through every stage as each one's operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import langid, mixing, packing, pii, simhash
from corpusloom.llm.common import cut_lineage, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts are), or unlike every learned language, go; a null lang is filled in."""
    return langid.keep_known(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that of the smallest id (null ids last); of repeated rows one."""
    return simhash.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind in brackets; every row stays, null texts as they are."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target sizes: documents taken not at all, once or twice, one of each source in part; without words not at all."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens; a null text is an end id alone."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]
#: SQL can express neither of the trained models nor the tokenizer; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
