"""Forecast accuracy from CV_ROW facts: rows, horizons, overall, and windows over horizons, as aggregations."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EvaluationMetricError, MetricOptionsError, MetricScaleError


def _error() -> Column:
    return F.col("actual") - F.col("predicted")


def _ape() -> Column:
    return F.abs(_error() / F.col("actual"))


@dataclass(frozen=True)
class Metric:
    """score: value of a row; reduce: mean, median, quantile (with p) or ratio (score over denominator); finalise: of the
    reduced value."""

    name: str
    score: Callable[[], Column]
    reduce: str = "mean"
    p: float = 0.5
    denominator: Callable[[], Column] | None = None
    finalise: Callable[[Column], Column] | None = None


def _smape() -> Column:
    size = (F.abs("actual") + F.abs("predicted")) / 2
    return F.when(size == 0, 0.0).otherwise(F.abs(_error()) / size)


METRICS = {
    "mae": Metric("mae", lambda: F.abs(_error())),
    "mse": Metric("mse", lambda: _error() * _error()),
    "rmse": Metric("rmse", lambda: _error() * _error(), finalise=F.sqrt),
    "mape": Metric("mape", _ape),
    "mdape": Metric("mdape", _ape, reduce="median"),
    "smape": Metric("smape", _smape),
    "coverage": Metric("coverage", lambda: F.col("actual").between(F.col("lower"), F.col("upper")).cast("double")),
}
WAPE = Metric("wape", lambda: F.abs(_error()), reduce="ratio", denominator=lambda: F.abs("actual"))


def _metric(m: str | Metric) -> Metric:
    if isinstance(m, Metric):
        return m
    if m not in METRICS:
        raise MetricOptionsError("invalid-shape", f"unknown metric {m!r}")
    return METRICS[m]


def validate(cv: DataFrame, metrics: list[Metric], limit: int | None = None) -> None:
    """Finite rows, horizon = timestamp - cutoff, no zero actual where a metric divides by it, ranges for coverage."""
    bad = lambda c: ~F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    names = {m.name for m in metrics}
    near = 1e-8 if "mape" in names else 0.0
    zero = (F.abs("actual") < near) | (F.col("actual") == 0) if names & {"mape", "mdape"} else F.lit(False)
    found = cv.agg(
        F.count("*").alias("n"), F.sum((bad(F.col("actual")) | bad(F.col("predicted"))).cast("long")).alias("bad"), F.sum((F.col("ts_ms") - F.col("cutoff_ms") != F.col("horizon_ms")).cast("long")).alias("off"),
        F.sum(zero.cast("long")).alias("zero"), F.sum((F.col("lower").isNull() | F.col("upper").isNull()).cast("long")).alias("open"),
    ).first()
    if not found["n"] or limit and found["n"] > limit:
        raise MetricOptionsError("row-count-out-of-range", f"{found['n']} rows")
    for count, reason in ((found["bad"], "non-finite"), (found["off"], "misaligned"), (found["zero"], "zero-actual"), (found["open"] if "coverage" in names else 0, "unavailable")):
        if count:
            raise EvaluationMetricError(reason, rows=count)


def guarded(cv: DataFrame, metrics: list[Metric]) -> DataFrame:
    """cv, whose rows raise the reason if a metric cannot be taken of them: validate() as part of the plan."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    names = {m.name for m in metrics}
    reason = F.when(bad(F.col("actual")) | bad(F.col("predicted")), "non-finite")
    if {"ts_ms", "cutoff_ms", "horizon_ms"} <= set(cv.columns):
        reason = reason.when(F.col("ts_ms") - F.col("cutoff_ms") != F.col("horizon_ms"), "misaligned")
    if names & {"mape", "mdape"}:
        reason = reason.when((F.col("actual") == 0) | (F.abs("actual") < (1e-8 if "mape" in names else 0.0)), "zero-actual")
    if "coverage" in names:
        reason = reason.when(F.col("lower").isNull() | F.col("upper").isNull(), "unavailable")
    return cv.withColumn("actual", F.when(reason.isNotNull(), F.raise_error(reason).cast("double")).otherwise(F.col("actual")))


def _reduced(m: Metric) -> Column:
    x = m.score()
    if m.reduce == "median":
        out = F.percentile(x, F.lit(0.5))
    elif m.reduce == "quantile":
        out = F.percentile(x, F.lit(m.p))
    elif m.reduce == "ratio":
        out = F.sum(x) / F.sum(m.denominator())
    else:
        out = F.avg(x)
    return m.finalise(out) if m.finalise else out


def calendar_months() -> Column:
    """Horizon in calendar months: UTC month of the timestamp minus that of the cutoff."""
    month = lambda ms: F.year(F.timestamp_millis(ms)) * 12 + F.month(F.timestamp_millis(ms))
    return (month(F.col("ts_ms")) - month(F.col("cutoff_ms"))).cast("long")


def _unit(cv: DataFrame, unit: str) -> DataFrame:
    if unit not in ("duration", "calendar-month"):
        raise MetricOptionsError("invalid-shape", unit)
    return cv.withColumn("horizon", F.col("horizon_ms") if unit == "duration" else calendar_months())


def performance(cv: DataFrame, metrics: list[str | Metric], aggregation: str = "overall", unit: str = "duration", window_rows: int | None = None, window_fraction: float | None = None, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """METRIC rows (keys, horizon?, metric, value, row_count). aggregation: rows, horizons, overall or rolling.

    rolling: window_rows, or max(1, floor(fraction * rows)); a window ends with the horizon it is named after.
    """
    chosen = [_metric(m) for m in metrics]
    at = _unit(guarded(cv, chosen), unit)
    keys = list(keys)
    named = lambda df, group: df.select(*group, F.explode(F.array(*(F.struct(F.lit(m.name).alias("metric"), F.col(f"m{i}").alias("value")) for i, m in enumerate(chosen)))).alias("x"), "row_count").select(*group, "x.metric", "x.value", "row_count")
    if aggregation == "rows":
        own = at.select(*keys, "fold", "cutoff_ms", "ts_ms", "horizon", *((m.finalise(m.score()) if m.finalise else m.score() / m.denominator() if m.denominator else m.score()).alias(f"m{i}") for i, m in enumerate(chosen)), F.lit(1).cast("long").alias("row_count"))
        return named(own, [*keys, "fold", "cutoff_ms", "ts_ms", "horizon"])
    if aggregation in ("horizons", "overall"):
        group = keys + (["horizon"] if aggregation == "horizons" else [])
        return named(at.groupBy(*group).agg(*(_reduced(m).alias(f"m{i}") for i, m in enumerate(chosen)), F.count("*").alias("row_count")), group)
    if aggregation != "rolling":
        raise MetricOptionsError("invalid-shape", aggregation)
    parts = [(rolling_means if m.reduce in ("mean", "ratio") else rolling_order_statistics)(at, m, keys, window_rows, window_fraction) for m in chosen]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _window_size(keys: list[str], groups: DataFrame, rows: int | None, fraction: float | None) -> DataFrame:
    if (rows is None) == (fraction is None):
        raise MetricOptionsError("invalid-shape", "either a row count or a fraction")
    total = groups.groupBy(*keys).agg(F.sum("n").alias("total"))
    size = F.lit(rows).cast("long") if rows is not None else F.greatest(F.lit(1).cast("long"), F.floor(F.col("total") * F.lit(float(fraction))))
    return total.withColumn("w", F.when(size > F.col("total"), F.raise_error(F.lit("window-exceeds-rows")).cast("long")).otherwise(size))


def rolling_means(at: DataFrame, m: Metric, keys: list[str], rows: int | None, fraction: float | None) -> DataFrame:
    """Mean over exactly w rows up to each horizon; the oldest horizon in a window counts with its share.

    With cumulative counts C and sums S by horizon, the window of t reaches back to the first i with C_i > C_t - w: found by
    one window over horizons and wanted counts together, so a series costs what sorting its horizons costs.
    """
    sums = [F.sum(m.score()).alias("s"), F.sum(m.denominator() if m.denominator else F.lit(1.0)).alias("d"), F.count("*").alias("n")]
    groups = at.groupBy(*keys, "horizon").agg(*sums)
    run = Window.partitionBy(*keys).orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)
    total = groups.withColumn("rows_to", F.sum("n").over(run)).withColumn("sum_to", F.sum("s").over(run)).withColumn("low_to", F.sum("d").over(run)).join(_window_size(keys, groups, rows, fraction).drop("total"), keys)
    now = F.struct("horizon", F.col("rows_to").alias("t_rows"), F.col("sum_to").alias("t_sum"), F.col("low_to").alias("t_low"), "w")
    back = F.struct("n", "s", "d", "rows_to", "sum_to", "low_to")
    asked = F.when(F.col("rows_to") >= F.col("w"), F.struct((F.col("rows_to") - F.col("w")).alias("v"), F.lit(0).alias("asks"), now.alias("now"), F.lit(None).cast(total.select(back.alias("b")).schema["b"].dataType).alias("back")))
    held = F.struct(F.col("rows_to").alias("v"), F.lit(1).alias("asks"), F.lit(None).cast(total.select(now.alias("b")).schema["b"].dataType).alias("now"), back.alias("back"))
    both = total.select(*keys, F.explode(F.array_compact(F.array(asked, held))).alias("e")).select(*keys, "e.*")
    # falling counts; of equal ones the wish comes before the group, which does not reach beyond it
    fall = Window.partitionBy(*keys).orderBy(F.desc("v"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("back", F.last("back", ignorenulls=True).over(fall)).filter("asks = 0").select(*keys, "now.*", "back.*")
    surplus = (F.col("t_rows") - (F.col("rows_to") - F.col("n")) - F.col("w")) / F.col("n")
    top = F.col("t_sum") - (F.col("sum_to") - F.col("s")) - surplus * F.col("s")
    low = F.col("t_low") - (F.col("low_to") - F.col("d")) - surplus * F.col("d")
    value = top / low if m.reduce == "ratio" else top / F.col("w")
    value = m.finalise(value) if m.finalise else value
    return met.select(*keys, "horizon", F.lit(m.name).alias("metric"), value.alias("value"), F.col("w").alias("row_count"))


def rolling_order_statistics(at: DataFrame, m: Metric, keys: list[str], rows: int | None, fraction: float | None) -> DataFrame:
    """Median or quantile over a horizon's own rows, filled up to w with the rows just before it in horizon order."""
    x = at.select(*keys, "horizon", "fold", "ts_ms", m.score().alias("x"))
    sizes = _window_size(keys, x.groupBy(*keys).agg(F.count("*").alias("n")), rows, fraction).drop("total")
    p = 0.5 if m.reduce == "median" else m.p

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One sweep: both ends of the window only move on, and its values are kept sorted."""
        pdf = pdf.sort_values(["horizon", "fold", "ts_ms"], kind="stable")
        values, horizon, w = pdf["x"].tolist(), pdf["horizon"].to_numpy(), int(pdf["w"].iloc[0])
        first = np.flatnonzero(np.concatenate(([True], horizon[1:] != horizon[:-1])))
        out, kept, low = [], [], 0
        for start, end in zip(first, np.append(first[1:], len(values)), strict=True):
            for v in values[start:end]:
                insort(kept, v)
            begin = min(int(start), int(end) - w)
            if begin < 0:
                continue
            for v in values[low:begin]:
                del kept[bisect_left(kept, v)]
            low = max(low, begin)
            at_ = p * (len(kept) - 1)
            i = int(at_)
            j = min(i + 1, len(kept) - 1)
            out.append((horizon[start], kept[i] + (at_ - i) * (kept[j] - kept[i]), len(kept)))
        made = pd.DataFrame(out, columns=["horizon", "value", "row_count"])
        return pdf[keys].iloc[:1].merge(made, how="cross")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.select(*keys, "horizon").schema)
    out = x.join(sizes, keys).groupBy(*keys).applyInPandas(run, f"{fields}, value double, row_count long")
    value = m.finalise(F.col("value")) if m.finalise else F.col("value")
    return out.select(*keys, "horizon", F.lit(m.name).alias("metric"), value.alias("value"), "row_count")


def scaled_error(cv: DataFrame, scales: DataFrame) -> DataFrame:
    """(series_id, value, row_count): mean |error| over the fold's naive scale."""
    bad = scales.agg(F.sum((F.col("scale") == 0).cast("long")).alias("zero"), F.count("*").alias("n")).first()
    if not bad["n"]:
        raise MetricScaleError("insufficient-history")
    if bad["zero"]:
        raise MetricScaleError("zero-scale")
    met = cv.join(scales, ["series_id", "fold"])
    return met.groupBy("series_id").agg(F.avg(F.abs(_error()) / F.col("scale")).alias("value"), F.count("*").alias("row_count"))


def compare_performance(named: dict[str, DataFrame], metrics: list[str | Metric]) -> DataFrame:
    """(source, series_id, metric, value, row_count) of a model and baselines over the same rows; misaligned ones raise."""
    first = None
    out = None
    for name, cv in named.items():
        rows = cv.select("series_id", "fold", "cutoff_ms", "ts_ms", "actual")
        if first is not None and (rows.exceptAll(first).limit(1).count() or first.exceptAll(rows).limit(1).count()):
            raise EvaluationMetricError("misaligned", name)
        first = rows if first is None else first
        own = performance(cv, metrics).withColumn("source", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out
