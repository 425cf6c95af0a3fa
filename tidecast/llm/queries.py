"""Registered queries of this subpackage: thin digests over the operators, each over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import license_scan
from .decontaminate import find_contamination
from .jaccard_join import jaccard_components
from .language_id import learn_and_identify
from .nearest import nearest_by_product
from .packing import pack_documents
from .secrets import learn_words, scan_secrets
from .suffix_dedup import remove_repeats
from .token_counts import count_tokens
from .warc import build_derivatives, responses_from_pages


def tokenizer_file(name: str = "word_bpe_49k.json", folder: str | None = None) -> str:
    """Path of a public tokenizer file; folder: where the vocabulary files lie on every machine."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_derivatives(responses_from_pages(_table(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return scan_secrets(docs, learn_words(docs)).drop("found")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn_and_identify(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), count_links=True)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_by_product(_table(spark, sf_dir, "embeddings"), "id % 20 = 0")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file())


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_suffix_dedup, op3_warc, op4_secret_scan, op5_decontamination, op6_language_id, op7_jaccard_join, op8_nearest, op9_packing, op10_license_scan)}
ORACLE_SQL: dict[str, str] = {"op10_license_scan": license_scan.oracle_sql()}
