"""Future timestamps: generated beside each anchor, no driver loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FutureTimestampsError
from ..options import MAX_FUTURE_PERIODS
from .features import DAY_MS, time_of_day_ms

#: Largest distance of a timestamp from 1970, fixed value.
MAX_TIMESTAMP_MS = 8_640_000_000_000_000
# Weekday frequencies, by Spark's day-of-week names.
WEEKDAYS = {"W-SUN": "SU", "W-MON": "MO", "W-TUE": "TU", "W-WED": "WE", "W-THU": "TH", "W-FRI": "FR", "W-SAT": "SA"}


def _date(ts_ms: Column) -> Column:
    return F.date_from_unix_date(F.floor(ts_ms / F.lit(DAY_MS)).cast("int"))


def _back(date: Column, ts_ms: Column) -> Column:
    return F.unix_date(date).cast("long") * DAY_MS + time_of_day_ms(ts_ms)


def next_timestamp(anchor: Column, period: Column, frequency: str) -> Column:
    """The period-th (from 1) timestamp after the anchor; the time of day is kept."""
    if frequency in ("h", "H"):
        return anchor + period * 3_600_000
    if frequency == "D":
        return anchor + period * DAY_MS
    frequency = "W-SUN" if frequency == "W" else frequency
    if frequency in WEEKDAYS:
        return _back(F.next_day(_date(anchor), WEEKDAYS[frequency]), anchor) + (period - 1) * 7 * DAY_MS
    if frequency == "MS":
        return _back(F.add_months(F.trunc(_date(anchor), "MM"), period.cast("int")), anchor)
    if frequency == "ME":
        day = _date(anchor)
        ahead = F.when(day < F.last_day(day), period - 1).otherwise(period)
        return _back(F.last_day(F.add_months(F.trunc(day, "MM"), ahead.cast("int"))), anchor)
    raise FutureTimestampsError("invalid-shape", f"unknown frequency {frequency!r}")


def future_timestamps(anchors: DataFrame, periods: int, frequency: str) -> DataFrame:
    """anchors (series_id, anchor_ms) -> (series_id, pos, ts_ms), pos from 0; timestamps beyond the range raise."""
    if not isinstance(periods, int) or not 0 <= periods <= MAX_FUTURE_PERIODS:
        raise FutureTimestampsError("invalid-shape", f"periods must be 0..{MAX_FUTURE_PERIODS}")
    steps = F.explode(F.sequence(F.lit(1), F.lit(periods))) if periods else F.explode(F.array().cast("array<int>"))
    at = anchors.select("series_id", "anchor_ms", steps.alias("period"))
    made = at.select("series_id", (F.col("period") - 1).cast("long").alias("pos"), next_timestamp(F.col("anchor_ms"), F.col("period").cast("long"), frequency).alias("ts_ms"))
    over = F.raise_error(F.lit("timestamp-overflow")).cast("long")
    return made.withColumn("ts_ms", F.when(F.abs("ts_ms") > MAX_TIMESTAMP_MS, over).otherwise(F.col("ts_ms")))


def make_future(history: DataFrame, periods: int, frequency: str, include_history: bool = False) -> DataFrame:
    """history (series_id, ts_ms) -> (series_id, pos, ts_ms): distinct history timestamps first, if asked for."""
    anchors = history.groupBy("series_id").agg(F.max("ts_ms").alias("anchor_ms"))
    ahead = future_timestamps(anchors, periods, frequency)
    if not include_history:
        return ahead
    both = history.select("series_id", "ts_ms").distinct().unionByName(ahead.select("series_id", "ts_ms"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("series_id").orderBy("ts_ms")).cast("long") - 1
    return both.select("series_id", place.alias("pos"), "ts_ms")
