"""Uncertainty by simulation, and anomalies. One grouped map per series; samples leave it only when asked for."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PredictionError, UncertaintyOptionsError
from ..options import DEFAULT_ANOMALY_WIDTH, DEFAULT_INTERVAL_WIDTH, MAX_SAMPLE_CELLS, MAX_SAMPLES, MAX_SIMULATION_ROWS
from ..schema import INTERVAL, SAMPLE
from .effects import Features, feature_matrix
from .numerics import rates, sigmoid
from .predict import predict

SIMULATION_IDENTITY = "map-philox-v1"
POSTERIOR_IDENTITY = "posterior-philox-v1"


def fnv1a(*fields: int | str) -> int:
    """32-bit FNV-1a over 8-byte little-endian numbers and UTF-8 strings."""
    h = 0x811C9DC5
    for f in fields:
        for b in f.encode() if isinstance(f, str) else (f % (1 << 64)).to_bytes(8, "little"):
            h = ((h ^ b) * 0x01000193) % (1 << 32)
    return h


def generator(seed: int, series: str) -> np.random.Generator:
    """Depends on the seed and the series' name only, never on where the task runs."""
    own = int.from_bytes(hashlib.blake2b(series.encode(), digest_size=8).digest(), "little")
    return np.random.Generator(np.random.Philox(key=[seed, own]))


def _trend(growth, tau, cap, k, m, deltas, s, extra_at, extra_size):
    """Trend of each row with further changes after the history."""
    at, size = np.concatenate((s, extra_at)), np.concatenate((deltas, extra_size))
    if growth == "flat":
        return np.full(len(tau), m)
    if growth == "linear":
        return m + k * tau + np.maximum(tau[:, None] - at[None, :], 0.0) @ size
    q, offset = rates(k, m, size, at)
    active = (tau[:, None] >= at[None, :]).sum(axis=1)
    return cap * sigmoid(q[active] * (tau - offset[active]))


def interval_reduce(values: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) by row of samples: equal tails, linear interpolation."""
    low, high = np.quantile(values, [(1 - width) / 2, (1 + width) / 2], axis=-1)
    return low, high


def _offsets(pdf: pd.DataFrame, features: Features, first, j: int) -> np.ndarray:
    """What the j-th draws of regressors' own models move each regressor's standardised value by, by row and coefficient."""
    out = np.zeros_like(features.block)
    if "regressor_draws" in pdf.columns:
        spread = {r["name"]: r["sd"] for r in first["regressors"]}
        for c, (name, kind) in enumerate(zip(features.names, features.kinds, strict=True)):
            if kind == "regressor":
                for i, held in enumerate(pdf["regressor_draws"]):
                    own = dict(held or ()).get(name)
                    if own is not None:
                        out[i, c] = (own["draws"][j % len(own["draws"])] - own["point"]) / spread[name]
    return out


def simulate_rows(pdf: pd.DataFrame, seed: int, samples: int, limits: bool = True, model=None) -> tuple[np.ndarray, np.ndarray]:
    """(trend, value) arrays (rows, samples) for rows of one series joined with its model and point forecast.

    With posterior draws every draw is simulated ceil(samples / draws) times, with its own trend, noise and coefficients.
    Draws of regressors' own models (regressor_draws) move the rows that they stand beside.
    """
    first = pdf.iloc[0] if model is None else model
    growth, origin, scale = first["growth"], first["time_origin"], first["time_scale"]
    tau = (pdf["ts_ms"].to_numpy(np.int64) - origin) / scale
    s = (np.array(first["changepoints_ms"], float) - origin) / scale
    deltas = np.array(first["deltas"], float)
    horizon = max(0.0, float(tau.max()) - 1)
    if limits and (len(pdf) > MAX_SIMULATION_ROWS or horizon > 20 or len(s) * horizon > 256):
        raise PredictionError("simulation-limit", f"{len(pdf)} rows, horizon {horizon:.1f} times the history")
    rng = generator(seed, str(first["series_id"]))
    add, mult = pdf["additive"].to_numpy(float), pdf["multiplicative"].to_numpy(float)
    floor = np.where(pdf["has_floor"], pdf["floor"].to_numpy(float), pdf["y_offset"].to_numpy(float)) if growth == "logistic" else np.zeros(len(pdf))
    cap = pdf["capacity"].to_numpy(float) - floor if growth == "logistic" else None
    draws = first["draws"] if first["draws"] is not None and len(first["draws"]) else None
    moved = "regressor_draws" in pdf.columns
    features = feature_matrix(first, pdf) if draws is not None or moved else None
    per_draw = -(-samples // len(draws)) if draws is not None else 1
    samples = per_draw * len(draws) if draws is not None else samples
    trend, value = np.empty((len(pdf), samples)), np.empty((len(pdf), samples))
    for j in range(samples):
        k, m, d, sigma = first["k"], first["m"], deltas, first["sigma"]
        if draws is not None:
            one = draws[j // per_draw]
            k, m, d, sigma = one["k"], one["m"], np.array(one["deltas"], float), one["sigma"]
            if j % per_draw == 0:
                beta = np.array(one["beta"], float)
                own_add, own_mult = features.effects(beta)
        else:
            own_add, own_mult, beta = add, mult, None if features is None else features.coef
        if moved:
            by = _offsets(pdf, features, first, j) * beta
            own_add, own_mult = own_add + by[:, ~features.multiplicative].sum(axis=1), own_mult + by[:, features.multiplicative].sum(axis=1)
        spread = float(np.abs(d).mean()) + 1e-8 if len(d) else 1e-8
        count = rng.poisson(len(s) * horizon) if growth != "flat" and len(s) else 0
        at = np.sort(1 + horizon * rng.random(count))
        trend[:, j] = _trend(growth, tau, cap, k, m, d, s, at, rng.laplace(0, spread, count)) + floor
        value[:, j] = trend[:, j] * (1 + own_mult) + own_add + sigma * rng.standard_normal(len(pdf))
    return trend, value


def _asked(seed: int, samples: int, width: float) -> None:
    if not 0 <= seed < 1 << 32 or not 1 <= samples <= MAX_SAMPLES or not 0 < width < 1:
        raise UncertaintyOptionsError("invalid-shape", f"seed a 32-bit number, samples 1..{MAX_SAMPLES}, width in (0, 1)")


def _joined(models: DataFrame, rows: DataFrame) -> DataFrame:
    for name, kind in (("capacity", "double"), ("floor", "double"), ("regressors", "map<string,double>"), ("conditions", "map<string,boolean>")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    point = predict(models, rows, components=False).drop("ts_ms")
    fields = ["growth", "time_origin", "time_scale", "k", "m", "sigma", "has_floor", "y_offset", "changepoints_ms", "deltas", "draws", "seasonalities", "events", "country"]
    kept = ["series_id", "pos", "ts_ms", "capacity", "floor", F.col("regressors").alias("row_regressors"), "conditions", *(c for c in rows.columns if c == "regressor_draws")]
    return rows.select(*kept).join(point, ["series_id", "pos"]).join(models.select("series_id", *fields, F.col("regressors").alias("model_regressors")), "series_id")


def _named(pdf: pd.DataFrame) -> tuple[pd.Series, pd.DataFrame]:
    """The model and the rows of a series, with the names that each has for its regressors."""
    pdf = pdf.sort_values("pos").reset_index(drop=True)
    return pdf.iloc[0].rename({"model_regressors": "regressors"}), pdf.rename(columns={"row_regressors": "regressors"})


def regressor_draws(models: dict[str, DataFrame], rows: dict[str, DataFrame], seed: int, samples: int = 200) -> DataFrame:
    """(series_id, pos, regressor_draws): by regressor, draws and point forecast of its own model at these rows."""
    out = None
    for name, own in models.items():
        drawn = predict_uncertainty(own, rows[name], seed, samples, output="samples")
        listed = drawn.groupBy("series_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "value"))), lambda x: x["value"]).alias("draws"))
        point = predict(own, rows[name], components=False).select("series_id", "pos", F.col("value").alias("point"))
        made = listed.join(point, ["series_id", "pos"]).select("series_id", "pos", F.struct(F.lit(name).alias("key"), F.struct("draws", "point").alias("value")).alias("entry"))
        out = made if out is None else out.unionByName(made)
    return out.groupBy("series_id", "pos").agg(F.map_from_entries(F.collect_list("entry")).alias("regressor_draws"))


def predict_uncertainty(models: DataFrame, rows: DataFrame, seed: int, samples: int = 1000, width: float = DEFAULT_INTERVAL_WIDTH, output: str = "intervals", limits: bool = True) -> DataFrame:
    """INTERVAL rows (equal-tailed, linear interpolation) or SAMPLE rows; the same seed gives the same result."""
    _asked(seed, samples, width)
    if output not in ("intervals", "samples"):
        raise UncertaintyOptionsError("unsupported-output", output)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model, pdf = _named(pdf)
        trend, value = simulate_rows(pdf, seed, samples, limits, model)
        base = pdf[["series_id", "pos", "ts_ms"]]
        if output == "samples":
            if limits and trend.size > MAX_SAMPLE_CELLS:
                raise PredictionError("simulation-limit", f"{trend.size} sample cells")
            out = base.loc[base.index.repeat(trend.shape[1])].reset_index(drop=True)
            return out.assign(sample=np.tile(np.arange(trend.shape[1], dtype=np.int32), len(base)), trend=trend.ravel(), value=value.ravel())
        (tl, tu), (vl, vu) = interval_reduce(trend, width), interval_reduce(value, width)
        return base.assign(trend_lower=tl, trend_upper=tu, value_lower=vl, value_upper=vu)

    return _joined(models, rows).groupBy("series_id").applyInPandas(run, SAMPLE if output == "samples" else INTERVAL)


def predict_with_intervals(models: DataFrame, rows: DataFrame, seed: int, samples: int = 1000, width: float = DEFAULT_INTERVAL_WIDTH) -> DataFrame:
    """FORECAST with trend and value ranges."""
    ranges = predict_uncertainty(models, rows, seed, samples, width).drop("ts_ms")
    return predict(models, rows).join(ranges, ["series_id", "pos"])


def posterior_component_intervals(models: DataFrame, rows: DataFrame, width: float = DEFAULT_INTERVAL_WIDTH) -> DataFrame:
    """(series_id, pos, kind, name, lower, upper): ranges over posterior draws of each seasonality, event and regressor, and of
    the additive and multiplicative totals (kind total). Series without draws give no row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model, pdf = _named(pdf)
        columns = ["series_id", "pos", "kind", "name", "lower", "upper"]
        if model["draws"] is None or not len(model["draws"]):
            return pd.DataFrame(columns=columns)
        features = feature_matrix(model, pdf)
        beta = np.array([d["beta"] for d in model["draws"]], float).T  # (coefficient, draw)
        kinds, names = np.array(features.kinds, object), np.array(features.names, object)
        groups = {(k, n): (kinds == k) & (names == n) for k, n in dict.fromkeys(zip(features.kinds, features.names, strict=True))}
        groups |= {("total", "additive"): ~features.multiplicative, ("total", "multiplicative"): features.multiplicative}
        out = []
        for (kind, name), which in groups.items():
            low, high = interval_reduce(features.block[:, which] @ beta[which], width)
            out.append(pdf[["series_id", "pos"]].assign(kind=kind, name=name, lower=low, upper=high))
        return pd.concat(out)[columns]

    return _joined(models, rows).groupBy("series_id").applyInPandas(run, "series_id string, pos long, kind string, name string, lower double, upper double")


def anomaly_position(actual, lower, upper):
    return F.when(actual < lower, "below").when(actual > upper, "above").otherwise("within")


def detect_anomalies(models: DataFrame, rows: DataFrame, seed: int, samples: int = 1000, width: float = DEFAULT_ANOMALY_WIDTH) -> DataFrame:
    """ANOMALY: each row's place against its range; strictly outside counts."""
    ranges = predict_with_intervals(models, rows.drop("y"), seed, samples, width).select("series_id", "pos", F.col("value").alias("predicted"), F.col("value_lower").alias("lower"), F.col("value_upper").alias("upper"))
    at = rows.select("series_id", "pos", "ts_ms", F.col("y").alias("actual")).join(ranges, ["series_id", "pos"])
    return at.withColumn("position", anomaly_position(F.col("actual"), F.col("lower"), F.col("upper")))


def anomalies(history: DataFrame, options, seed: int, **how) -> DataFrame:
    """Fit, and return the flagged rows of the same history; repeated timestamps stay repeated."""
    from .fit import fit

    return detect_anomalies(fit(history, options), history, seed, **how).filter("position <> 'within'")


def expected_simulation(options, samples: int) -> dict:
    per_draw = None
    if options.mcmc is not None:
        kept = options.mcmc.chains * (options.mcmc.samples - options.mcmc.samples // 2 if options.mcmc.warmup is None else options.mcmc.samples)
        per_draw = math.ceil(samples / kept)
    return {"identity": SIMULATION_IDENTITY if per_draw is None else POSTERIOR_IDENTITY, "samples": samples if per_draw is None else per_draw * kept}
