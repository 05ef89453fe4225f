"""Queries op1 to op10 and the pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinforge.llm import ann, decontaminate, html, langid, license_scan, lm, mixing, near_duplicates, tokens, warc
from kinforge.llm.common import documents


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.jaccard_join(documents(spark, sf_dir))


def op2_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(documents(spark, sf_dir, "embeddings"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(documents(spark, sf_dir, "pages"))


def op5_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), order=3)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op7_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_table(documents(spark, sf_dir, "pages"))


def op8_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir), details=False)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(documents(spark, sf_dir))


def op10_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard,
        op2_anisotropic_search,
        op3_decontaminate,
        op4_html_text,
        op5_katz_scores,
        op6_language,
        op7_warc_packages,
        op8_license_rules,
        op9_token_files,
        op10_fair_mix,
        pipeline,
    )
}
ORACLE_SQL = {"op1_ngram_jaccard": near_duplicates.JACCARD_SQL, "op3_decontaminate": decontaminate.CONTAMINATION_SQL, "op10_fair_mix": mixing.MIX_SQL}
