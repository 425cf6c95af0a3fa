"""Corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, secret redaction, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each stage's
result to the shared folder and reads it back as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.decontaminate import drop_contaminated
from tidecast.llm.jaccard_join import drop_near_duplicates
from tidecast.llm.language_id import keep_identified, learn
from tidecast.llm.packing import pack_documents
from tidecast.llm.queries import tokenizer_file
from tidecast.llm.secrets import learn_words, redact_secrets
from tidecast.llm.store import materialise


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Goes: no letter, null text, or an entropy no language model explains."""
    return keep_identified(docs, learn(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each group of rows linked by 5-word shingle similarity of 0.8.

    Rows with a null doc_id stay unless a copy has an id; repeated rows leave one.
    """
    return drop_near_duplicates(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets masked and n_chars renewed where the text changed."""
    redacted = redact_secrets(docs, learn_words(docs))
    if "n_chars" not in docs.columns:
        return redacted
    return redacted.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in sequences of at most 2048 tokens."""
    return pack_documents(docs, tokenizer_file())


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scan", secret_stage),
    ("best-fit packing", packing_stage),
]

#: A trained language model decides the first stage, which SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
