"""Decoding rows, and configuration that depends on them: one window or aggregation each, for all series at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ObservationError, OptionsError, PredictionInputError
from ..functions.features import DAY_MS
from ..options import ForecastOptions, Seasonality

_TEXT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"
# Orders and periods of the built-in seasonalities, in their order.
BUILT_IN = (("yearly", 365.25, 10), ("weekly", 7.0, 3), ("daily", 1.0, 4))


def parse_timestamp(text: Column) -> Column:
    """Epoch milliseconds of a canonical UTC timestamp such as 2024-01-01T00:00:00.000Z, null for anything else."""
    at = F.try_to_timestamp(text)
    ms = F.unix_millis(at)
    return F.when(text.rlike(_TEXT) & (F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") == text), ms)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def decode_observations(rows: DataFrame, order: str = "input_ord", validate: bool = True) -> DataFrame:
    """(series_id, ts_ms, y, <order>, ...) -> the same with pos: place by timestamp, ties in input order. Ties are kept.

    Raises ObservationError 'empty' or 'invalid-shape' (null timestamp, value not finite) before anything is fitted.
    """
    if validate:
        bad = ~F.coalesce(finite(F.col("y")), F.lit(False)) | F.col("ts_ms").isNull() | F.col("series_id").isNull()
        found = rows.agg(F.count("*").alias("n"), F.sum(bad.cast("long")).alias("bad")).first()
        if not found["n"]:
            raise ObservationError("empty")
        if found["bad"]:
            raise ObservationError("invalid-shape", "timestamps and finite values are needed", rows=found["bad"])
    place = F.row_number().over(Window.partitionBy("series_id").orderBy("ts_ms", order)).cast("long") - 1
    return rows.withColumn("pos", place)


def _refusals(rows: DataFrame, options: ForecastOptions, training: bool) -> list[tuple[str, Column]]:
    """(reason, test) of rows whose regressor and condition names or bounds do not fit the options."""
    tests: list[tuple[str, Column]] = []

    def maps(column: str, names: list[str], missing: str, unexpected: str) -> None:
        wanted = F.array(*map(F.lit, names)).cast("array<string>")
        if column in rows.columns:
            keys = F.coalesce(F.map_keys(column), F.array().cast("array<string>"))
        elif names:
            keys = F.array().cast("array<string>")
        else:
            return
        tests.append((missing, F.size(F.array_except(wanted, keys)) > 0))
        tests.append((unexpected, F.size(F.array_except(keys, wanted)) > 0))

    maps("regressors", [r.name for r in options.regressors], "missing-regressor", "unexpected-regressor")
    maps("conditions", sorted({s.condition for s in options.seasonalities if s.condition}), "missing-condition", "unexpected-condition")
    capacity = F.col("capacity") if "capacity" in rows.columns else F.lit(None).cast("double")
    floor = F.col("floor") if "floor" in rows.columns else F.lit(None).cast("double")
    if options.growth == "logistic":
        tests.append(("missing-capacity", capacity.isNull()))
        tests.append(("capacity-not-above-floor", capacity <= F.coalesce(floor, F.lit(0.0)) if training else capacity <= floor))
    else:
        tests.append(("bound-on-non-logistic", capacity.isNotNull() | floor.isNotNull()))
    return tests


def row_reasons(rows: DataFrame, options: ForecastOptions, training: bool = True) -> DataFrame:
    """rows with `reason`: the first one why a row does not fit the options, null if it does."""
    reason = F.lit(None).cast("string")
    for name, test in reversed(_refusals(rows, options, training)):
        reason = F.when(F.coalesce(test, F.lit(False)), name).otherwise(reason)
    return rows.withColumn("reason", reason)


def guard_history(history: DataFrame, options: ForecastOptions) -> DataFrame:
    """history, whose rows raise the reason if they do not fit the options: part of the plan, no job of its own."""
    bad = F.col("y").isNull() | F.isnan("y") | (F.abs("y") == float("inf"))
    reason = F.when(bad, "invalid-target")
    for name, test in _refusals(history, options, True):
        reason = reason.when(F.coalesce(test, F.lit(False)), name)
    return history.withColumn("y", F.when(reason.isNotNull(), F.raise_error(reason).cast("double")).otherwise(F.col("y").cast("double")))


def check_names(rows: DataFrame, options: ForecastOptions, training: bool = True) -> None:
    """Regressor and condition names of every row match the configured ones exactly; bounds fit the growth. A job of its own,
    whose errors are typed; fit() and predict() raise the same reasons as they read the rows."""
    error = ObservationError if training else PredictionInputError
    tests = _refusals(rows, options, training)
    floor = F.col("floor") if "floor" in rows.columns else F.lit(None).cast("double")
    found = rows.agg(*(F.sum(F.coalesce(t, F.lit(False)).cast("long")).alias(f"t{i}") for i, (_, t) in enumerate(tests)), F.count(floor).alias("floors"), F.count("*").alias("n")).first()
    for i, (reason, _) in enumerate(tests):
        if found[f"t{i}"]:
            raise error(reason, rows=found[f"t{i}"])
    if training and options.growth == "logistic":
        mixed = rows.groupBy("series_id").agg(F.count(floor).alias("f"), F.count("*").alias("n")).filter("f > 0 and f < n").limit(1).count()
        if mixed:
            raise error("inconsistent-floor")


def history_summary(history: DataFrame) -> DataFrame:
    """(series_id, n, first_ms, last_ms, span_ms, min_gap_ms): min_gap_ms is the least positive gap, null if none."""
    gap = F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy("series_id").orderBy("ts_ms"))
    return history.withColumn("gap", gap).groupBy("series_id").agg(
        F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
        (F.max("ts_ms") - F.min("ts_ms")).alias("span_ms"), F.min(F.when(F.col("gap") > 0, F.col("gap"))).alias("min_gap_ms"),
    )


def _decision(name: str, span: Column, gap: Column, setting: str) -> Column:
    days = {"yearly": 730, "weekly": 14, "daily": 2}[name]
    if setting != "auto":
        return F.lit("explicitly-enabled" if setting == "on" else "explicitly-disabled")
    out = F.when(span < days * DAY_MS, "insufficient-history")
    if name != "yearly":
        most = {"weekly": 7, "daily": 1}[name] * DAY_MS
        out = out.when(gap.isNull() | (gap >= most), "sampling-too-sparse")
    return out.otherwise("automatic-enabled")


def resolve_seasonalities(summary: DataFrame, options: ForecastOptions) -> DataFrame:
    """summary -> (series_id, yearly, weekly, daily): the reason for each built-in seasonality to be on or off."""
    return summary.select("series_id", *(_decision(n, F.col("span_ms"), F.col("min_gap_ms"), getattr(options, n)).alias(n) for n, _, _ in BUILT_IN))


def enabled_seasonalities(options: ForecastOptions, span_ms: int, min_gap_ms: int | None) -> list[Seasonality]:
    """Custom seasonalities, then the built-in ones that are on; the same rule as resolve_seasonalities for one series."""
    out = list(options.seasonalities)
    least = {"yearly": 730, "weekly": 14, "daily": 2}
    most = {"weekly": 7, "daily": 1}
    for name, period, order in BUILT_IN:
        setting = getattr(options, name)
        fine = name == "yearly" or min_gap_ms is not None and min_gap_ms < most[name] * DAY_MS
        if setting == "on" or setting == "auto" and span_ms >= least[name] * DAY_MS and fine:
            out.append(Seasonality(name, period, order, options.seasonality_prior_scale, options.seasonality_mode))
    return out


def changepoint_positions(n: int, count: int, share: float) -> list[int]:
    """Row places of automatic changepoints: evenly spread, halves to even, over the first `share` of the rows."""
    eligible = int(n * share)
    chosen = min(count, eligible - 1)
    if chosen <= 0:
        return []
    step = (eligible - 1) / chosen
    return [*(round(i * step) for i in range(1, chosen)), eligible - 1]


def resolve_changepoints(history: DataFrame, count: int = 25, share: float = 0.8) -> DataFrame:
    """(series_id, ord, ts_ms): automatic changepoints of each series, counted over rows, repeats included."""
    sizes = history.groupBy("series_id").agg(F.count("*").alias("n"))
    eligible = F.floor(F.col("n") * F.lit(float(share)))
    chosen = F.least(F.lit(count).cast("long"), eligible - 1)
    spread = sizes.select("series_id", eligible.alias("eligible"), chosen.alias("chosen")).filter("chosen > 0")
    spread = spread.select("series_id", "eligible", "chosen", F.explode(F.sequence(F.lit(1).cast("long"), F.col("chosen"))).alias("ord"))
    pos = F.when(F.col("ord") == F.col("chosen"), F.col("eligible") - 1).otherwise(F.rint(F.col("ord") * ((F.col("eligible") - 1) / F.col("chosen"))).cast("long"))
    return spread.select("series_id", "ord", pos.alias("pos")).join(history.select("series_id", "pos", "ts_ms"), ["series_id", "pos"]).select("series_id", "ord", "ts_ms")


def check_changepoints(history_range: DataFrame, changepoints_ms: tuple[int, ...]) -> None:
    """Explicit changepoints lie inside every series' range."""
    low, high = min(changepoints_ms), max(changepoints_ms)
    if history_range.filter((F.col("first_ms") > low) | (F.col("last_ms") < high)).limit(1).count():
        raise OptionsError("changepoint-out-of-range")


def resolve_target_scaling(history: DataFrame, mode: str = "absmax") -> DataFrame:
    """(series_id, y_offset, y_scale): absmax 0 and max |y|; minmax min and range; a zero scale becomes 1."""
    if mode == "absmax":
        offset, scale = F.lit(0.0), F.max(F.abs("y"))
    else:
        offset, scale = F.min("y"), F.max("y") - F.min("y")
    out = history.groupBy("series_id").agg(offset.alias("y_offset"), scale.alias("y_scale"))
    return out.withColumn("y_scale", F.when(F.col("y_scale") == 0, F.lit(1.0)).otherwise(F.col("y_scale")))


def resolve_logistic_scaling(history: DataFrame, mode: str = "absmax") -> DataFrame:
    """(series_id, y_offset, y_scale, has_floor): of the target above its floor.

    Without floors the floor is 0 (absmax) or the least value (minmax). absmax scales by the largest |y - floor|, minmax
    by the largest capacity above the floor.
    """
    floor = F.col("floor") if "floor" in history.columns else F.lit(None).cast("double")
    implicit = F.lit(0.0) if mode == "absmax" else F.min("y").over(Window.partitionBy("series_id"))
    at = history.withColumn("own_floor", F.coalesce(floor, implicit))
    scale = F.max(F.abs(F.col("y") - F.col("own_floor"))) if mode == "absmax" else F.max(F.col("capacity") - F.col("own_floor"))
    out = at.groupBy("series_id").agg(F.min("own_floor").alias("y_offset"), scale.alias("y_scale"), (F.count(floor) > 0).alias("has_floor"))
    return out.withColumn("y_scale", F.when(F.col("y_scale") == 0, F.lit(1.0)).otherwise(F.col("y_scale")))


def resolve_regressor_transform(values: DataFrame, standardize: str = "auto") -> DataFrame:
    """values (series_id, x) -> (series_id, transform, mean, sd): identity (0, 1), or mean and sample deviation."""
    binary = F.bool_and(F.col("x").isin(0.0, 1.0))
    same = (F.count("*") < 2) | (F.min("x") == F.max("x"))
    keep = F.lit(True) if standardize == "never" else same | binary if standardize == "auto" else same
    out = values.groupBy("series_id").agg(keep.alias("keep"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    return out.select("series_id", F.when(F.col("keep"), "identity").otherwise("standardized").alias("transform"), F.when(F.col("keep"), 0.0).otherwise(F.col("mean")).alias("mean"), F.when(F.col("keep"), 1.0).otherwise(F.col("sd")).alias("sd"))
