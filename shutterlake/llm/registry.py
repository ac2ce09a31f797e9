"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, clustering, decontaminate, html_extract, lm_score, merkle, mixing, near_dup, quality, secret_scan, sql, substring_dedup, url_filter, warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus_pipeline.py imports this package, so it is imported when it is called."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict = {
    "op1_quality_rules": quality.op1,
    "op2_decontamination": decontaminate.op2,
    "op3_url_filter": url_filter.op3,
    "op4_substring_dedup": substring_dedup.op4,
    "op5_source_mixing": mixing.op5,
    "op6_chat_format": chat_format.op6,
    "op7_html_extract": html_extract.op7,
    "op8_secret_scan": secret_scan.op8,
    "op9_near_dedup": near_dup.op9,
    "op10_lm_score": lm_score.op10,
    "op11_warc": warc.op11,
    "op12_merkle_manifest": merkle.op12,
    "op13_centroid_clusters": clustering.op13,
    "pipeline": pipeline,
}

ORACLE: dict = {
    "op1_quality_rules": sql.OP1,
    "op4_substring_dedup": sql.OP4,
    "op8_secret_scan": sql.OP8,
    "op6_chat_format": sql.OP6,
    "op9_near_dedup": sql.OP9,
    "op11_warc": sql.OP11,
    "op12_merkle_manifest": sql.OP12,
    "op13_centroid_clusters": sql.OP13,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
