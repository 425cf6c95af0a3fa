"""Search over option grids and holdout evaluation. Candidates times folds times series fit in one stage."""

from __future__ import annotations

import dataclasses
import itertools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EvaluationReportError, EvaluationSearchError, ForecastError, HoldoutInputError, SearchOptionsError
from ..options import MAX_SEARCH_CANDIDATES, ForecastOptions
from .evaluate import cross_validate_baseline, cross_validate_candidates, plan_rolling_origin
from .fit import fit
from .metrics import Metric, performance
from .predict import predict

# The axes of a grid, the first of which varies slowest.
AXES = ("growth", "seasonality_mode", "holidays_mode", "scaling", "n_changepoints", "changepoint_range", "changepoint_prior_scale", "seasonality_prior_scale", "holidays_prior_scale")


def parameter_grid(base: ForecastOptions, axes: dict[str, list]) -> list[tuple[str, ForecastOptions]]:
    """(id, options) of every combination; ids grid-i-j-... by place on each axis."""
    if not axes or any(a not in AXES for a in axes):
        raise SearchOptionsError("invalid-candidate", f"axes are {AXES}")
    if any(len(set(map(repr, v))) < len(v) or not v for v in axes.values()):
        raise SearchOptionsError("duplicate-choice")
    names = [a for a in AXES if a in axes]
    total = 1
    for n in names:
        total *= len(axes[n])
    if total > MAX_SEARCH_CANDIDATES:
        raise SearchOptionsError("limit-exceeded", f"{total} candidates")
    out = []
    for places in itertools.product(*(range(len(axes[n])) for n in names)):
        out.append(("grid-" + "-".join(map(str, places)), base.with_(**{n: axes[n][i] for n, i in zip(names, places, strict=True)})))
    return out


def grid_frame(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """The same combinations as a table (id, one column per axis)."""
    out = None
    for name in [a for a in AXES if a in axes]:
        own = spark.createDataFrame([(i, str(v)) for i, v in enumerate(axes[name])], f"i_{name} int, {name} string")
        out = own if out is None else out.crossJoin(own)
    ids = [c for c in out.columns if c.startswith("i_")]
    return out.select(F.concat_ws("-", F.lit("grid"), *ids).alias("id"), *(c for c in out.columns if c not in ids))


def search_models(history: DataFrame, candidates: list[tuple[str, ForecastOptions]], folds: DataFrame, horizon_ms: int, metric: str | Metric = "mae", mode: str = "fail-fast") -> DataFrame:
    """(series_id, candidate, ord, score, best): the least overall score wins, the earliest candidate among equals.

    mode record: a candidate that fails for any series is left out; fail-fast: it raises.
    """
    if mode not in ("record", "fail-fast"):
        raise SearchOptionsError("invalid-mode", mode)
    if len(candidates) > MAX_SEARCH_CANDIDATES or len({c for c, _ in candidates}) < len(candidates):
        raise SearchOptionsError("limit-exceeded" if len(candidates) > MAX_SEARCH_CANDIDATES else "duplicate-choice")
    cv = cross_validate_candidates(history, [o for _, o in candidates], folds, horizon_ms, record=mode == "record")
    if mode == "record":
        failed = {r["candidate"] for r in cv.filter("error is not null").select("candidate").distinct().collect()}  # at most 32
        if len(failed) == len(candidates):
            raise EvaluationSearchError("no-success")
        cv = cv.filter(~F.col("candidate").isin(sorted(failed))) if failed else cv
    scores = performance(cv, [metric], keys=("series_id", "candidate")).select("series_id", F.col("candidate").alias("ord"), F.col("value").alias("score"))
    names = F.array(*(F.lit(n) for n, _ in candidates))
    return select_best(scores.select("series_id", names[F.col("ord")].alias("candidate"), "ord", "score"))


def select_best(scores: DataFrame) -> DataFrame:
    best = scores.groupBy("series_id").agg(F.min_by("ord", F.struct("score", "ord")).alias("best_ord"))
    return scores.join(best, "series_id").withColumn("best", F.col("ord") == F.col("best_ord")).drop("best_ord")


def evaluate_holdout(development: DataFrame, holdout: DataFrame, options: ForecastOptions, metrics: list[str | Metric], baselines: dict[str, dict] | None = None) -> DataFrame:
    """METRIC rows with `source`: the model refitted on development, and baselines, scored on a strictly later holdout."""
    ends = development.groupBy("series_id").agg(F.max("ts_ms").alias("last_ms"))
    if holdout.join(ends, "series_id").filter("ts_ms <= last_ms").limit(1).count():
        raise HoldoutInputError("partition-not-later")
    if any((m if isinstance(m, str) else m.name) == "coverage" for m in metrics):
        raise HoldoutInputError("missing-intervals")
    found = predict(fit(development, options), holdout.drop("y"), components=False).select("series_id", "pos", F.col("value").alias("predicted"))
    none = F.lit(None).cast("double")
    cv = holdout.join(found, ["series_id", "pos"]).join(ends, "series_id").select("series_id", F.lit(0).alias("fold"), F.col("last_ms").alias("cutoff_ms"), "ts_ms", (F.col("ts_ms") - F.col("last_ms")).alias("horizon_ms"), F.col("y").alias("actual"), "predicted", none.alias("lower"), none.alias("upper"))
    out = performance(cv, metrics).withColumn("source", F.lit("model"))
    for name, how in (baselines or {}).items():
        both = development.unionByName(holdout)
        folds = ends.select("series_id", F.lit(0).alias("fold"), F.col("last_ms").alias("cutoff_ms"))
        out = out.unionByName(performance(cross_validate_baseline(both, folds, 1 << 50, **how), metrics).withColumn("source", F.lit(name)))
    return out


def encode_report(rows: list[dict], forecasts: list[dict]) -> str:
    try:
        return json.dumps({"version": 1, "metrics": rows, "forecasts": forecasts}, sort_keys=True, allow_nan=False)
    except (TypeError, ValueError) as error:
        raise EvaluationReportError("encode", str(error)) from error


def decode_report(text: str, tolerance: float = 1e-9) -> dict:
    """The report, after its mean absolute error has been computed again from its forecasts."""
    try:
        doc = json.loads(text)
        by: dict[str, list[float]] = {}
        for f in doc["forecasts"]:
            by.setdefault(f["series_id"], []).append(abs(f["actual"] - f["predicted"]))
        for m in doc["metrics"]:
            if m["metric"] == "mae" and m.get("source", "model") == "model" and abs(sum(by[m["series_id"]]) / len(by[m["series_id"]]) - m["value"]) > tolerance:
                raise EvaluationReportError("score-mismatch", m["series_id"])
    except (KeyError, TypeError, ValueError) as error:
        raise EvaluationReportError("decode", str(error)) from error
    return doc


def options_document(options: ForecastOptions) -> str:
    return json.dumps(dataclasses.asdict(options), sort_keys=True, default=str)


__all__ = ["AXES", "ForecastError", "decode_report", "encode_report", "evaluate_holdout", "grid_frame", "options_document", "parameter_grid", "plan_rolling_origin", "search_models", "select_best"]
