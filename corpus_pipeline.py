"""Corpus pipeline: language ID, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.llm import decontaminate, langid, mixing, near_duplicates, tokens
from kinforge.llm.common import documents, unused, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without any letter go. Learns from all labelled ones."""
    profiles = langid.learn(docs.where(langid.fold(F.col("doc_id"), 4) != 2))
    lang, score = unused("lang_pred", docs), unused("lang_score", docs)
    return langid.predict(docs, profiles, names=(lang, score)).where(F.col(lang) != "und").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word Jaccard similarity of 0.8 or more."""
    return near_duplicates.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of any benchmark item."""
    return decontaminate.clean(docs, documents(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in mix order, as often as the mix takes them (up to twice)."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; what they hold, read back."""
    return tokens.token_table(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]
#: No SQL: the language profiles and the byte-pair ids have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
