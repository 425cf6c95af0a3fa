"""Prediction: rows meet their model on series_id and everything else is column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import PredictionInputError
from ..functions import features as X
from .events import holiday_years


def with_models(rows: DataFrame, models: DataFrame, columns: list[str]) -> DataFrame:
    """Rows beside their model; adaptive execution sends models to all tasks only where their measured size is small."""
    return rows.join(models.select("series_id", *columns), "series_id")


def trend_column() -> Column:
    """Trend of a row joined with its model, in observation units."""
    tau = X.scaled_time(F.col("ts_ms"), F.col("time_origin"), F.col("time_scale"))
    at = F.transform("changepoints_ms", lambda c: (c - F.col("time_origin")).cast("double") / F.col("time_scale").cast("double"))
    linear = X.linear_trend(tau, F.col("k"), F.col("m"), at, F.col("deltas"))
    floor = F.when(F.col("has_floor"), F.col("floor")).otherwise(F.col("y_offset"))
    logistic = X.logistic_trend(tau, F.col("k"), F.col("m"), at, F.col("deltas"), F.col("capacity"), floor)
    return F.when(F.col("growth") == "linear", linear).when(F.col("growth") == "flat", F.col("m")).otherwise(logistic)


def _parts() -> tuple[Column, Column, Column]:
    """Arrays of (name, mode, effect) of seasonalities, events and regressors."""
    day = X.epoch_day(F.col("ts_ms"))
    seasonal = F.transform("seasonalities", lambda s: F.struct(
        s["name"].alias("name"), s["mode"].alias("mode"),
        F.when(s["condition"].isNull() | F.coalesce(F.col("conditions")[s["condition"]], F.lit(False)), X.seasonal_component(F.col("ts_ms"), s)).otherwise(F.lit(0.0)).alias("effect"),
    ))
    names = F.array_distinct(F.transform("events", lambda e: F.struct(e["name"].alias("name"), e["mode"].alias("mode"))))
    met = lambda n, e: (e["epoch_day"] == day) | (e["offset"] == 0) & F.array_contains("holiday_names", n["name"])
    own = lambda n: F.filter("events", lambda e: (e["name"] == n["name"]) & met(n, e))
    events = F.transform(names, lambda n: F.struct(n["name"].alias("name"), n["mode"].alias("mode"), F.aggregate(F.transform(F.array_distinct(F.transform(own(n), lambda e: F.struct(e["offset"], e["coef"].alias("coef")))), lambda e: e["coef"]), F.lit(0.0), lambda a, x: a + x).alias("effect")))
    regressors = F.transform("regressors", lambda r: F.struct(r["name"].alias("name"), r["mode"].alias("mode"), (r["coef"] * (F.col("regressor_values")[r["name"]] - r["mean"]) / r["sd"]).alias("effect")))
    return seasonal, events, regressors


def with_holidays(at: DataFrame) -> DataFrame:
    """Rows joined with models -> holiday_names: those of the model's country on the row's day; raises where the years of
    the country end, have a known gap that the model rejects, or name a holiday as an event of another prior scale."""
    day = X.epoch_day(F.col("ts_ms"))
    met = at.join(F.broadcast(holiday_years(at.sparkSession)), (F.col("country.country") == F.col("holiday_country")) & (F.year(F.date_from_unix_date(day)) == F.col("holiday_year")), "left")
    names = F.transform(F.filter("holidays", lambda h: h["epoch_day"] == day), lambda h: h["name"])
    return met.withColumn("holiday_names", (
        F.when(F.col("country").isNull(), F.array().cast("array<string>"))
        .when(F.col("holidays").isNull(), F.raise_error(F.lit("invalid-year: no holidays are known for the country in this year")))
        .when((F.col("country.coverage") == "reject-known-gaps") & F.col("gap").isNotNull(), F.raise_error(F.concat(F.lit("known-gap: "), "gap")))
        .when(F.arrays_overlap("country.conflicts", F.transform("holidays", lambda h: h["name"])), F.raise_error(F.lit("prior-conflict")))
        .otherwise(names)
    ))


def _refusal() -> Column:
    """Reason why a row joined with its model cannot be predicted, null if it can."""
    wanted = lambda column, pick: F.array_distinct(F.filter(F.transform(column, pick), lambda x: x.isNotNull()))
    given = lambda column: F.coalesce(F.map_keys(F.map_filter(column, lambda k, v: v.isNotNull())), F.array().cast("array<string>"))
    regressors, conditions = wanted("regressors", lambda r: r["name"]), wanted("seasonalities", lambda s: s["condition"])
    bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    logistic = F.col("growth") == "logistic"
    return (
        F.when(F.size(F.array_except(regressors, given("regressor_values"))) > 0, "missing-regressor")
        .when(F.size(F.array_except(given("regressor_values"), regressors)) > 0, "unexpected-regressor")
        .when(F.exists(F.coalesce(F.map_values("regressor_values"), F.array().cast("array<double>")), bad), "unrepresentable-regressor")
        .when(F.size(F.array_except(conditions, given("conditions"))) > 0, "missing-condition")
        .when(F.size(F.array_except(given("conditions"), conditions)) > 0, "unexpected-condition")
        .when(~logistic & (F.col("capacity").isNotNull() | F.col("floor").isNotNull()), "bound-on-non-logistic")
        .when(logistic & F.col("capacity").isNull(), "missing-capacity")
        .when(logistic & F.col("has_floor") & F.col("floor").isNull(), "missing-floor")
        .when(logistic & ~F.col("has_floor") & F.col("floor").isNotNull(), "unexpected-floor")
        .when(logistic & (F.col("capacity") <= F.when(F.col("has_floor"), F.col("floor")).otherwise(F.col("y_offset"))), "capacity-not-above-floor")
    )


def predict(models: DataFrame, rows: DataFrame, components: bool = True) -> DataFrame:
    """rows (series_id, pos, ts_ms, capacity?, floor?, regressors?, conditions?) -> FORECAST.

    Country holidays are expanded for the years of the rows, with the coefficients of names seen in fitting.
    value = trend * (1 + multiplicative) + additive. Component arrays hold name, mode, and value (additive) or factor and
    contribution (multiplicative). Rows whose names or bounds do not fit their model raise the reason when they are computed;
    rows of series without a model give no row (unmodelled_rows() names them).
    """
    for name, kind in (("capacity", "double"), ("floor", "double"), ("regressors", "map<string,double>"), ("conditions", "map<string,boolean>")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = rows.withColumnRenamed("regressors", "regressor_values")
    fields = ["growth", "y_offset", "time_origin", "time_scale", "k", "m", "has_floor", "changepoints_ms", "deltas", "seasonalities", "events", "regressors", "country"]
    seasonal, events, regressors = _parts()
    at = with_holidays(with_models(rows, models, fields))
    at = at.withColumn("trend", F.when(_refusal().isNotNull(), F.raise_error(_refusal()).cast("double")).otherwise(trend_column()))
    at = at.select("series_id", "pos", "ts_ms", "trend", seasonal.alias("s"), events.alias("e"), regressors.alias("r"))
    every = F.concat("s", "e", "r")
    total = lambda mode: F.aggregate(F.filter(every, lambda c: c["mode"] == mode), F.lit(0.0), lambda a, c: a + c["effect"])
    at = at.withColumn("additive", total("additive")).withColumn("multiplicative", total("multiplicative"))
    value = F.col("trend") * (1 + F.col("multiplicative")) + F.col("additive")
    out = ["series_id", "pos", "ts_ms", value.alias("value"), "trend", "additive", "multiplicative"]
    if components:
        shape = lambda a: F.transform(a, lambda c: F.struct(
            c["name"].alias("name"), c["mode"].alias("mode"), F.when(c["mode"] == "additive", c["effect"]).alias("value"),
            F.when(c["mode"] == "multiplicative", c["effect"]).alias("factor"), F.when(c["mode"] == "multiplicative", c["effect"] * F.col("trend")).alias("contribution"),
        ))
        out += [shape("s").alias("seasonalities"), shape("e").alias("events"), shape("r").alias("regressors")]
    return at.select(*out)


def unmodelled_rows(models: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of series that have no model."""
    return rows.join(models.select("series_id"), "series_id", "left_anti")


def residuals(models: DataFrame, history: DataFrame) -> DataFrame:
    """(series_id, pos, ts_ms, actual, predicted, residual) of the rows the model is asked about."""
    found = predict(models, history.drop("y"), components=False).select("series_id", "pos", F.col("value").alias("predicted"))
    return history.select("series_id", "pos", "ts_ms", F.col("y").alias("actual")).join(found, ["series_id", "pos"]).withColumn("residual", F.col("actual") - F.col("predicted"))


def fill_regressor_values(rows: DataFrame, history: DataFrame, forecasts: dict[str, DataFrame]) -> DataFrame:
    """Regressors that have a model of their own: rows after the history take its forecast (over a supplied value);
    earlier rows keep a supplied value, else take the history's at exactly this timestamp, which must be unique.

    forecasts: by regressor, (series_id, pos, value).
    """
    last = history.groupBy("series_id").agg(F.max("ts_ms").alias("last_ms"))
    out = rows.join(last, "series_id", "left")
    if "regressors" not in out.columns:
        out = out.withColumn("regressors", F.create_map().cast("map<string,double>"))
    for name, made in forecasts.items():
        known = history.select("series_id", "ts_ms", F.col("regressors")[name].alias("x")).groupBy("series_id", "ts_ms").agg(F.min("x").alias("lookup"), (F.min("x") != F.max("x")).alias("differs"))
        out = out.join(made.select("series_id", "pos", F.col("value").alias("forecast")), ["series_id", "pos"], "left").join(known, ["series_id", "ts_ms"], "left")
        supplied = F.col("regressors")[name]
        value = F.when(F.col("ts_ms") > F.col("last_ms"), F.col("forecast")).otherwise(F.coalesce(supplied, F.when(F.col("differs"), F.raise_error(F.lit("several values at one timestamp"))).otherwise(F.col("lookup"))))
        rest = F.map_filter(F.coalesce("regressors", F.create_map().cast("map<string,double>")), lambda k, v: k != name)  # noqa: B023
        out = out.withColumn("regressors", F.map_concat(rest, F.create_map(F.lit(name), value))).drop("forecast", "lookup", "differs")
    return out.drop("last_ms")


def pair_forecasts(observations: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Observations and forecasts of the same (series_id, pos); raises if a pair's timestamps differ or a row has none."""
    both = observations.select("series_id", "pos", F.col("ts_ms").alias("ts_ms"), F.col("y").alias("actual")).join(forecasts.select("series_id", "pos", F.col("ts_ms").alias("forecast_ms"), F.col("value").alias("predicted")), ["series_id", "pos"], "full")
    bad = both.filter(~F.col("ts_ms").eqNullSafe(F.col("forecast_ms"))).limit(1).count()
    if bad:
        raise PredictionInputError("invalid-shape", "observations and forecasts are not aligned")
    return both.drop("forecast_ms")


def prediction_rows(history: DataFrame) -> DataFrame:
    """Observations without their target."""
    return history.drop("y")


def latest_rows(history: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("pos")))
    return history.withColumn("_place", place).filter("_place = 1").drop("_place")
