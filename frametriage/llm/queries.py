"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, tokenizer_file
from .language_id import fit_languages, languages
from .licenses import license_scan
from .line_dedup import dedup_lines, dedup_sql
from .media import document_media
from .packing import pack
from .piece_codec import piece_digests
from .quality_classifier import fit_quality, quality_scores
from .quality_rules import quality_rules
from .simhash import simhash_groups
from .token_counts import token_counts


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_scores(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return languages(docs, fit_languages(docs))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_counts, op2_sentencepiece, op3_line_dedup, op4_license_scan, op5_quality_rules, op6_quality_classifier, op7_media_columns, op8_best_fit_packing, op9_language_id, op10_simhash, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Only line dedup is plain enough for SQL; the others are tested against brute force, a library or held-out labels."""
    return {"op3_line_dedup": dedup_sql()}
