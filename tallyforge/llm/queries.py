"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .backoff_lm import backoff_scores
from .decontaminate import decontaminate
from .fill_in_middle import middle_digests
from .jaccard_join import jaccard_components
from .language_id import identify_languages
from .license_scan import scan_licenses
from .line_dedup import dedupe_lines
from .packing import pack
from .quality_rules import quality_scores
from .token_file import token_file
from .toxicity import toxicity_scores
from .url_filter import captures_of, filter_urls, list_of
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), n=5, percent=80)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=5, window=10)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), token_budget=8192, max_length=2048, buckets=12)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_scores(_table(spark, sf_dir, "documents"), at_least=0.5)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"), coverage=0.85)


def op6_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(_table(spark, sf_dir, "documents"), order=3, backoff=0.4)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as captures of 2024 against a dated list over their own hosts, both derived by checksum."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(captures_of(pages), list_of(pages))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), train_rows=30_000, threshold=0.3)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_lines(_table(spark, sf_dir, "documents"), least=10, with_text=False)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"), components=4)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_digests(_table(spark, sf_dir, "documents"), seed=1)


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_decontaminate": op2_decontaminate,
    "op3_packing": op3_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_license_scan": op5_license_scan,
    "op6_backoff_lm": op6_backoff_lm,
    "op7_url_filter": op7_url_filter,
    "op8_language_id": op8_language_id,
    "op9_token_file": op9_token_file,
    "op10_toxicity": op10_toxicity,
    "op11_line_dedup": op11_line_dedup,
    "op12_whitening": op12_whitening,
    "op13_fill_in_middle": op13_fill_in_middle,
}
