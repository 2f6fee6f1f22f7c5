"""One query for each operator of this package, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    ann, decontaminate, divergence, langid, licenses, lm_scoring, mixing, quality_rules, repeats, simhash, token_files, url_filter, whitening,
)
from tidemark.llm.sql import SQL

#: Where the vocabulary files of public tokenizers lie; None: the installed package of them.
TOKENIZERS: str | None = None
END_ID = 2


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document: documents labelled good against all."""
    docs = lm_scoring.mark_target(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"), "is_target")
    return lm_scoring.lm_score(docs, "is_target")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the url of every page."""
    out = url_filter.judge(_read(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "url", "pattern")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors to each vector whose id is divisible by 20."""
    return ann.search(_read(spark, sf_dir, "embeddings"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in all documents."""
    return decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    return quality_rules.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in Arrow files, read back."""
    return token_files.token_table(_read(spark, sf_dir, "documents"), tokenizer_file(), END_ID).drop("shard")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements in all documents."""
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents."""
    return simhash.simhash_groups(_read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.identify(_read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates for all documents that bring the labelled domains to their target shares of tokens."""
    rates = mixing.mix(_read(spark, sf_dir, "documents"), mixing.domain_of(_read(spark, sf_dir, "labels")))
    return rates.withColumn("copies", mixing.copies_of(rates["rate"], rates["doc_id"])).drop("h")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the spans of 13 words and more that a document with a smaller id has."""
    return repeats.remove_repeats(_read(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the four leading components of their exact covariance, whitened."""
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ in the terms of all documents."""
    return divergence.source_divergence(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline, from documents to token files."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_url_filter": op2_url_filter,
        "op3_nearest": op3_nearest,
        "op4_decontamination": op4_decontamination,
        "op5_quality": op5_quality,
        "op6_token_files": op6_token_files,
        "op7_licenses": op7_licenses,
        "op8_simhash": op8_simhash,
        "op9_language_id": op9_language_id,
        "op10_mixing": op10_mixing,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_whitening": op12_whitening,
        "op13_source_divergence": op13_source_divergence,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in queries()}
