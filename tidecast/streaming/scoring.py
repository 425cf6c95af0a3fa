"""Scoring a stream of observations against fitted models, and counting late ones out by watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.predict import predict


def score_stream(models: DataFrame, rows: DataFrame) -> DataFrame:
    """Stream of (series_id, pos, ts_ms, ...) -> stream of FORECAST rows; models are a static table."""
    return predict(models, rows, components=False)


def windowed_series(events: DataFrame, key: str, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events (ts timestamp, <key>, value) -> (series_id, ts_ms, y, n) per tumbling window, once its watermark passes."""
    at = events.withWatermark("ts", late).groupBy(F.col(key).cast("string").alias("series_id"), F.window("ts", every).alias("w"))
    return at.agg(F.sum("value").alias("y"), F.count("*").alias("n")).select("series_id", F.unix_millis("w.start").alias("ts_ms"), "y", "n")


def score_batches(models: DataFrame, rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """foreachBatch with the batch's forecasts; sink must accept a batch again under the same number."""
    return rows.writeStream.foreachBatch(lambda batch, n: sink(predict(models, batch, components=False), n)).option("checkpointLocation", checkpoint).start()
