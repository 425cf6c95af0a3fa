"""Models as portable JSON documents, one string per series, and as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ModelSerializationError
from ..schema import MODEL

VERSION = 1


def encode_models(models: DataFrame) -> DataFrame:
    """(series_id, document)."""
    fields = F.struct(F.lit(VERSION).alias("version"), *(F.col(c) for c in models.columns))
    return models.select("series_id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("document"))


def decode_models(documents: DataFrame) -> DataFrame:
    """MODEL rows; raises on a document that does not parse, has another version or no parameters."""
    at = documents.select("series_id", F.from_json("document", f"version int, {MODEL}").alias("d"))
    bad = at.filter(F.col("d").isNull() | ~F.col("d.version").eqNullSafe(F.lit(VERSION)) | F.col("d.k").isNull() | F.col("d.time_scale").isNull() | ~F.col("d.series_id").eqNullSafe(F.col("series_id")))
    if (row := bad.select("series_id").first()) is not None:
        raise ModelSerializationError("decode", f"series {row['series_id']!r}")
    return at.select(*(F.col(f"d.{c}").alias(c) for c in at.schema["d"].dataType.names if c != "version"))


def write_models(models: DataFrame, path: str) -> None:
    models.write.mode("overwrite").parquet(path)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL).parquet(path)
