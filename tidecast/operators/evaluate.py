"""Rolling-origin evaluation: folds as rows, every fold of every series and candidate fitted at once."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EvaluationError, EvaluationPlanError
from ..options import DEFAULT_INTERVAL_WIDTH, ForecastOptions
from ..schema import CV_ROW
from .effects import feature_matrix
from .fit import fit_series
from .simulate import _trend, fnv1a, simulate_rows

MAX_FOLDS = 128


def generate_cutoffs(ts: list[int], horizon_ms: int, period_ms: int | None = None, initial_ms: int | None = None, longest_season_ms: int = 0) -> list[int]:
    """Cutoffs of one series, ascending; jumps back over gaps that leave a horizon without rows."""
    if horizon_ms <= 0:
        raise EvaluationPlanError("invalid-shape", "the horizon must be positive")
    period = period_ms or -(-horizon_ms // 2)
    initial = initial_ms if initial_ms is not None else max(3 * horizon_ms, longest_season_ms)
    first, last = ts[0], ts[-1]
    cutoff = last - horizon_ms
    if cutoff < first:
        raise EvaluationPlanError("horizon-exceeds-history")
    out = [cutoff]
    while out[-1] >= first + initial:
        cutoff = out[-1] - period
        seen = bisect_right(ts, cutoff)
        if bisect_right(ts, cutoff + horizon_ms) == seen:
            if not seen:
                break
            cutoff = ts[seen - 1] - horizon_ms
        out.append(cutoff)
    out = out[:-1]
    if not out:
        raise EvaluationPlanError("insufficient-data-after-initial")
    if len(out) > MAX_FOLDS:
        raise EvaluationPlanError("limit-exceeded", f"{len(out)} folds")
    return out[::-1]


def generate_cutoffs_regular(history: DataFrame, horizon_ms: int, period_ms: int | None = None, initial_ms: int | None = None, longest_season_ms: int = 0) -> DataFrame:
    """(series_id, fold, cutoff_ms) where no horizon is without rows: last - h - j*p down to first + initial, as a plan."""
    period = period_ms or -(-horizon_ms // 2)
    initial = initial_ms if initial_ms is not None else max(3 * horizon_ms, longest_season_ms)
    ends = history.groupBy("series_id").agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"))
    steps = F.floor((F.col("b") - horizon_ms - F.col("a") - initial) / F.lit(period))
    n = ends.withColumn("steps", steps).filter("steps >= 0")
    return n.select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps"))).alias("fold"), "b", "steps").select("series_id", F.col("fold").cast("int").alias("fold"), (F.col("b") - horizon_ms - (F.col("steps") - F.col("fold")) * period).alias("cutoff_ms"))


def plan_rolling_origin(history: DataFrame, horizon_ms: int, cutoffs_ms: tuple[int, ...] | None = None, period_ms: int | None = None, initial_ms: int | None = None, longest_season_ms: int = 0) -> DataFrame:
    """FOLD rows: (series_id, fold, cutoff_ms, training_count, assessment_count)."""
    if cutoffs_ms is not None:
        values = F.array(*[F.lit(int(c)) for c in cutoffs_ms])
        folds = history.select("series_id").distinct().select("series_id", F.posexplode(values).alias("fold", "cutoff_ms"))
    else:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            found = generate_cutoffs(sorted(pdf["ts_ms"].tolist()), horizon_ms, period_ms, initial_ms, longest_season_ms)
            return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "fold": range(len(found)), "cutoff_ms": found})

        folds = history.select("series_id", "ts_ms").groupBy("series_id").applyInPandas(run, "series_id string, fold int, cutoff_ms long")
    return fold_counts(history, folds, horizon_ms)


def fold_counts(history: DataFrame, folds: DataFrame, horizon_ms: int) -> DataFrame:
    """Rows up to each cutoff, and in the horizon after it: counts run over each series once, beside the folds' ends."""
    ends = folds.select("series_id", "fold", "cutoff_ms", F.explode(F.array(F.lit(0).cast("long"), F.lit(horizon_ms).cast("long"))).alias("after"))
    counted = _running(history.select("series_id", "ts_ms", F.lit(1.0).alias("x")), ends.withColumn("at_ms", F.col("cutoff_ms") + F.col("after")))
    met = counted.groupBy("series_id", "fold", "cutoff_ms").agg(F.min("n").alias("training_count"), F.max("n").alias("n"))
    return met.select("series_id", "fold", "cutoff_ms", "training_count", (F.col("n") - F.col("training_count")).alias("assessment_count"))


def _running(values: DataFrame, ends: DataFrame) -> DataFrame:
    """ends (series_id, at_ms, ...) with n and total: count and sum of the series' values (ts_ms, x) up to at_ms.

    One window over the values and the ends together: no fold meets all rows of its series.
    """
    names = [c for c in ends.columns if c != "series_id"]
    rows = values.select("series_id", F.col("ts_ms").alias("at_ms"), F.lit(0).alias("kind"), "x", F.lit(None).cast(ends.select(F.struct(*names).alias("e")).schema["e"].dataType).alias("e"))
    asked = ends.select("series_id", "at_ms", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("x"), F.struct(*names).alias("e"))
    run = Window.partitionBy("series_id").orderBy("at_ms", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(asked).withColumn("n", F.count("x").over(run)).withColumn("total", F.sum("x").over(run))
    return both.filter("kind = 1").select("series_id", "e.*", "n", "total")


def split_folds(history: DataFrame, folds: DataFrame, horizon_ms: int) -> DataFrame:
    """Every fold's training and assessment rows, marked by `assess`."""
    met = folds.select("series_id", "fold", "cutoff_ms").join(history, "series_id").filter(F.col("ts_ms") <= F.col("cutoff_ms") + horizon_ms)
    return met.withColumn("assess", F.col("ts_ms") > F.col("cutoff_ms"))


def _fold_options(options: ForecastOptions, last_ms: int) -> ForecastOptions:
    if options.changepoints_ms is None:
        return options
    return options.with_(changepoints_ms=tuple(c for c in options.changepoints_ms if c < last_ms))


def predict_series(model: dict, rows: pd.DataFrame) -> pd.DataFrame:
    """Point forecasts of one series in numpy, for folds that are fitted and scored in the same task."""
    ts = rows["ts_ms"].to_numpy(np.int64)
    tau = (ts - model["time_origin"]) / model["time_scale"]
    floor = rows["floor"].to_numpy(float) if model["has_floor"] else np.full(len(rows), model["y_offset"] if model["growth"] == "logistic" else 0.0)
    cap = rows["capacity"].to_numpy(float) - floor if model["growth"] == "logistic" else None
    s = (np.array(model["changepoints_ms"], float) - model["time_origin"]) / model["time_scale"]
    none = np.zeros(0)
    trend = _trend(model["growth"], tau, cap, model["k"], model["m"], np.array(model["deltas"], float), s, none, none) + floor * (model["growth"] == "logistic")
    features = feature_matrix(model, rows)
    add, mult = features.effects(features.coef)
    return rows.assign(trend=trend, additive=add, multiplicative=mult, predicted=trend * (1 + mult) + add)


_CV_COLUMNS = ["series_id", "fold", "cutoff_ms", "ts_ms", "horizon_ms", "actual", "predicted", "lower", "upper"]


def _score_fold(pdf: pd.DataFrame, options: ForecastOptions, intervals: dict | None) -> pd.DataFrame:
    """CV_ROW of one fold's training and assessment rows."""
    pdf = pdf.sort_values("pos")
    train, ahead = pdf[~pdf["assess"]], pdf[pdf["assess"]].reset_index(drop=True)
    if not len(ahead):
        return pd.DataFrame(columns=_CV_COLUMNS)
    own = _fold_options(options, int(train["ts_ms"].max())) if len(train) else options
    model = fit_series(train, own)
    found = predict_series(model, ahead)
    lower = upper = None
    if intervals:
        for name in ("growth", "time_origin", "time_scale", "k", "m", "sigma", "has_floor", "y_offset"):
            found[name] = model[name]
        for name in ("changepoints_ms", "deltas", "draws"):
            found[name] = [model[name]] * len(found)
        for name in ("capacity", "floor"):
            if name not in found:
                found[name] = float("nan")
        width = intervals.get("width", DEFAULT_INTERVAL_WIDTH)
        _, value = simulate_rows(found, fnv1a(intervals["seed"], int(pdf["cutoff_ms"].iloc[0])), intervals.get("samples", 1000))
        lower, upper = np.quantile(value, [(1 - width) / 2, (1 + width) / 2], axis=1)
    return pd.DataFrame({"series_id": found["series_id"], "fold": found["fold"], "cutoff_ms": found["cutoff_ms"], "ts_ms": found["ts_ms"], "horizon_ms": found["ts_ms"] - found["cutoff_ms"], "actual": found["y"], "predicted": found["predicted"], "lower": lower, "upper": upper})


def cross_validate(history: DataFrame, options: ForecastOptions, folds: DataFrame, horizon_ms: int, intervals: dict | None = None, scaling: str = "absmax") -> DataFrame:
    """CV_ROW of every assessment row. intervals: seed, samples, width. Scaling is `scaling`, whatever the options say."""
    options = options.with_(scaling=scaling)
    return split_folds(history, folds, horizon_ms).groupBy("series_id", "fold").applyInPandas(lambda pdf: _score_fold(pdf, options, intervals), CV_ROW)


def cross_validate_candidates(history: DataFrame, candidates: list[ForecastOptions], folds: DataFrame, horizon_ms: int, record: bool = False) -> DataFrame:
    """CV_ROW with candidate (place in the list) and error: every candidate, fold and series in one stage.

    record: a group that fails gives one row with its error instead of failing the job.
    """
    chosen = list(candidates)
    rows = split_folds(history, folds, horizon_ms).withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(len(chosen) - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(pdf["candidate"].iloc[0])
        try:
            return _score_fold(pdf, chosen[at], None).assign(candidate=at, error=None)
        except Exception as error:  # noqa: BLE001  reported under the candidate
            if not record:
                raise
            first = pdf.iloc[0]
            return pd.DataFrame([{"series_id": first["series_id"], "fold": first["fold"], "cutoff_ms": first["cutoff_ms"], "candidate": at, "error": str(error)}], columns=[*_CV_COLUMNS, "candidate", "error"])

    return rows.groupBy("series_id", "fold", "candidate").applyInPandas(run, f"{CV_ROW}, candidate int, error string")


def cross_validate_baseline(history: DataFrame, folds: DataFrame, horizon_ms: int, kind: str = "last", lag_ms: int | None = None) -> DataFrame:
    """CV_ROW of a naive forecast: last training value, training mean, or the value exactly lag_ms earlier."""
    rows = split_folds(history, folds, horizon_ms)
    train = rows.filter("not assess")
    ahead = rows.filter("assess").select("series_id", "fold", "cutoff_ms", "ts_ms", (F.col("ts_ms") - F.col("cutoff_ms")).alias("horizon_ms"), F.col("y").alias("actual"))
    keys = ["series_id", "fold"]
    if kind in ("last", "mean"):
        value = F.max_by("y", "pos") if kind == "last" else F.avg("y")
        made = ahead.join(train.groupBy(*keys).agg(value.alias("predicted")), keys)
    elif kind == "seasonal_naive":
        if not lag_ms or lag_ms < horizon_ms:
            raise EvaluationError("baseline", "the lag must be a positive duration no shorter than the horizon")
        lagged = train.groupBy(*keys, "ts_ms").agg(F.max_by("y", "pos").alias("predicted")).withColumn("ts_ms", F.col("ts_ms") + lag_ms)
        met = ahead.join(lagged, [*keys, "ts_ms"], "left")
        made = met.withColumn("predicted", F.coalesce("predicted", F.raise_error(F.lit("no training value one lag earlier")).cast("double")))
    else:
        raise EvaluationError("baseline", f"unknown baseline {kind!r}")
    none = F.lit(None).cast("double")
    return made.select("series_id", "fold", "cutoff_ms", "ts_ms", "horizon_ms", "actual", "predicted", none.alias("lower"), none.alias("upper"))


def same_plan(a: DataFrame, b: DataFrame) -> bool:
    columns = ["series_id", "fold", "cutoff_ms", "training_count", "assessment_count"]
    a, b = a.select(columns), b.select(columns)
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def fold_scales(history: DataFrame, folds: DataFrame, lag_ms: int | None = None) -> DataFrame:
    """(series_id, fold, scale): mean |y - lagged y| over each fold's training rows; the previous row, or exactly lag_ms."""
    if lag_ms is None:
        before: Column = F.lag("y").over(Window.partitionBy("series_id").orderBy("pos"))
        gaps = history.select("series_id", "ts_ms", F.abs(F.col("y") - before).alias("gap"))
    else:
        earlier = history.groupBy("series_id", "ts_ms").agg(F.max_by("y", "pos").alias("before")).withColumn("ts_ms", F.col("ts_ms") + lag_ms)
        gaps = history.join(earlier, ["series_id", "ts_ms"]).select("series_id", "ts_ms", F.abs(F.col("y") - F.col("before")).alias("gap"))
    found = _running(gaps.select("series_id", "ts_ms", F.col("gap").alias("x")).filter("x is not null"), folds.select("series_id", "fold", F.col("cutoff_ms").alias("at_ms")))
    return found.filter("n > 0").select("series_id", "fold", (F.col("total") / F.col("n")).alias("scale"))
