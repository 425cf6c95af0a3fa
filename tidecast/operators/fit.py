"""Fitting: one grouped map, one row per series. The only shuffle is by series (and chain, when sampling)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FittingError, OptionsError
from ..functions.features import DAY_MS
from ..options import ForecastOptions, Seasonality
from ..schema import MODEL
from .events import country_state, event_columns, merged_events
from .history import changepoint_positions, enabled_seasonalities, guard_history
from .numerics import ForecastProblem, maximise, nuts, split_rhat_ess


@dataclass
class Prepared:
    """A series ready for the optimiser, and what is needed to put its parameters back into units."""

    problem: ForecastProblem
    model: dict
    seasonalities: list[Seasonality]
    events: list[tuple[str, int, int]]
    regressors: list[dict]
    floor: np.ndarray


def fourier_block(ts_ms: np.ndarray, s: Seasonality) -> np.ndarray:
    angle = 2 * math.pi * np.outer(ts_ms / DAY_MS, np.arange(1, s.fourier_order + 1)) / s.period_days
    return np.stack([np.sin(angle), np.cos(angle)], axis=2).reshape(len(ts_ms), -1)


def event_block(ts_ms: np.ndarray, columns: list[tuple[str, int]], days: list[tuple[str, int, int]]) -> np.ndarray:
    day = np.floor(ts_ms / DAY_MS).astype(np.int64)
    out = np.zeros((len(ts_ms), len(columns)))
    place = {c: i for i, c in enumerate(columns)}
    for name, at, offset in days:
        out[day == at, place[name, offset]] = 1.0
    return out


def prepare(pdf: pd.DataFrame, options: ForecastOptions) -> Prepared:
    pdf = pdf.sort_values("pos" if "pos" in pdf.columns else "ts_ms", kind="stable")
    ts, y = pdf["ts_ms"].to_numpy(np.int64), pdf["y"].to_numpy(float)
    if len(y) < 2:
        raise FittingError("insufficient-observations", f"series {pdf['series_id'].iloc[0]!r} has {len(y)} row")
    span = int(ts[-1] - ts[0])
    if span == 0 and options.growth != "flat":
        raise FittingError("degenerate-observations", f"series {pdf['series_id'].iloc[0]!r} has one timestamp")
    gaps = np.diff(ts)
    gaps = gaps[gaps > 0]
    cap, floor, has_floor = None, np.zeros(len(y)), False
    if options.growth == "logistic":
        own = pdf["floor"].to_numpy(float) if "floor" in pdf.columns else np.full(len(y), np.nan)
        has_floor = bool(np.isfinite(own).all())
        floor = own if has_floor else np.full(len(y), 0.0 if options.scaling == "absmax" else y.min())
        above = pdf["capacity"].to_numpy(float) - floor
        scale = float(np.abs(y - floor).max()) if options.scaling == "absmax" else float(above.max())
        offset = 0.0 if has_floor else float(floor[0])
    elif options.scaling == "absmax":
        offset, scale = 0.0, float(np.abs(y).max())
    else:
        offset, scale = float(y.min()), float(np.ptp(y))
    scale = scale or 1.0
    shift = floor if options.growth == "logistic" else np.full(len(y), offset)
    if options.growth == "logistic":
        cap = above / scale
    if options.changepoints_ms and (min(options.changepoints_ms) < ts[0] or max(options.changepoints_ms) > ts[-1]):
        raise OptionsError("changepoint-out-of-range", f"series {pdf['series_id'].iloc[0]!r}")
    if options.growth == "flat":
        at = np.zeros(0, np.int64)
    elif options.changepoints_ms is not None:
        at = np.array(options.changepoints_ms, np.int64)
    else:
        at = ts[changepoint_positions(len(y), options.n_changepoints, options.changepoint_range)]
    seasonalities = enabled_seasonalities(options, span, int(gaps.min()) if len(gaps) else None)
    years = sorted(set(pd.to_datetime(ts, unit="ms").year.tolist()))
    events = merged_events(options, years)
    days = event_columns(events)
    columns = list(dict.fromkeys((n, o) for n, _, o in days))
    prior_of = {e.name: e.prior_scale or options.holidays_prior_scale for e in events}
    blocks, mult, priors = [], [], []
    for s in seasonalities:
        block = fourier_block(ts, s)
        if s.condition:
            block = block * np.array([bool(dict(c)[s.condition]) for c in pdf["conditions"]], float)[:, None]
        blocks.append(block)
        mult += [s.mode == "multiplicative"] * block.shape[1]
        priors += [s.prior_scale] * block.shape[1]
    if columns:
        blocks.append(event_block(ts, columns, days))
        mult += [options.event_mode == "multiplicative"] * len(columns)
        priors += [prior_of[n] for n, _ in columns]
    regressors = []
    for r in options.regressors:
        x = np.array([float(dict(v)[r.name]) for v in pdf["regressors"]])
        same = len(x) < 2 or x.min() == x.max()
        plain = r.standardize == "never" or same or r.standardize == "auto" and bool(np.isin(x, (0.0, 1.0)).all())
        mean, sd = (0.0, 1.0) if plain else (float(x.mean()), float(x.std(ddof=1)))
        mode = r.mode or options.seasonality_mode
        regressors.append({"name": r.name, "prior_scale": r.prior_scale or options.holidays_prior_scale, "mode": mode, "transform": "identity" if plain else "standardized", "mean": mean, "sd": sd})
        blocks.append(((x - mean) / sd)[:, None])
        mult.append(mode == "multiplicative")
        priors.append(regressors[-1]["prior_scale"])
    features = np.concatenate(blocks, axis=1) if blocks else np.zeros((len(y), 0))
    width = span or 1
    problem = ForecastProblem(options.growth, (ts - ts[0]) / width, (y - shift) / scale, (at - ts[0]) / width, options.changepoint_prior_scale, features, np.array(mult, bool), np.array(priors, float), cap)
    model = {
        "series_id": pdf["series_id"].iloc[0], "model_kind": f"{'mcmc' if options.mcmc else 'map'}-{options.growth}", "growth": options.growth, "scaling": options.scaling, "y_offset": offset, "y_scale": scale,
        "time_origin": int(ts[0]), "time_scale": int(width), "has_floor": has_floor, "changepoints_ms": at.tolist(),
    }
    return Prepared(problem, model, seasonalities, days, regressors, floor)


def units(p: Prepared, theta: np.ndarray) -> dict:
    """Scaled parameters -> observation units: k, m, sigma, deltas and one coefficient per feature."""
    problem, scale = p.problem, p.model["y_scale"]
    k, m, delta, log_sigma, beta = problem.parts(theta)
    if not len(problem.changepoints):
        k, delta = k + delta[0] * (problem.growth != "flat"), delta[:0]
    beta = beta[: problem.features.shape[1]]
    beta = np.where(problem.multiplicative, beta, beta * scale) if len(beta) else beta
    if problem.growth != "logistic":
        k, m, delta = k * scale, m * scale + p.model["y_offset"], delta * scale
    if problem.growth == "flat":
        k = 0.0
    return {"k": float(k), "m": float(m), "sigma": float(math.exp(log_sigma) * scale), "deltas": delta.tolist(), "beta": beta.tolist()}


def shape_model(p: Prepared, values: dict, options: ForecastOptions, summary: dict, draws: list[dict], diagnostics: list[dict]) -> dict:
    beta, at = values["beta"], 0
    seasonal, events, regressors = [], [], []
    for s in p.seasonalities:
        n = 2 * s.fourier_order
        seasonal.append({"name": s.name, "period_days": float(s.period_days), "fourier_order": s.fourier_order, "prior_scale": float(s.prior_scale), "mode": s.mode, "condition": s.condition, "coef": beta[at : at + n]})
        at += n
    columns = list(dict.fromkeys((n, o) for n, _, o in p.events))
    coef = dict(zip(columns, beta[at:], strict=False))
    events = [{"name": n, "epoch_day": d, "offset": o, "mode": options.event_mode, "coef": coef[n, o]} for n, d, o in p.events]
    at += len(columns)
    for r, b in zip(p.regressors, beta[at:], strict=True):
        regressors.append({**r, "coef": b})
    return {**p.model, **{k: values[k] for k in ("k", "m", "sigma", "deltas")}, "seasonalities": seasonal, "events": events, "regressors": regressors, "fit_summary": {**summary, "n": len(p.problem.y)}, "draws": draws, "diagnostics": diagnostics, "country": country_state(options)}


def warm_start(p: Prepared, start: dict | None) -> np.ndarray | None:
    """Start values in scaled units: k, m and sigma always, deltas and betas only if as many."""
    if not start:
        return None
    theta = p.problem.start()
    n, scale = len(p.problem.s), p.model["y_scale"]
    unit = 1.0 if p.problem.growth == "logistic" else scale
    theta[0], theta[1] = start["k"] / unit, (start["m"] - (0 if unit == 1.0 else p.model["y_offset"])) / unit
    theta[2 + n] = math.log(max(start["sigma"] / scale, 1e-9))
    if len(start["deltas"]) == len(p.problem.changepoints) and len(start["deltas"]):
        theta[2 : 2 + n] = np.array(start["deltas"]) / unit
    beta = np.array(start.get("beta", ()), float)
    if len(beta) == p.problem.features.shape[1] and len(beta):
        theta[3 + n :] = np.where(p.problem.multiplicative, beta, beta / scale)
    return theta


def fit_series(pdf: pd.DataFrame, options: ForecastOptions) -> dict:
    """MAP model of one series."""
    p = prepare(pdf, options)
    y = p.problem.y
    if options.growth != "logistic" and np.ptp(y) == 0:
        theta = np.zeros(p.problem.size)
        theta[1] = y[0]
        theta[2 + len(p.problem.s)] = math.log(1e-9)
        return shape_model(p, units(p, theta), options, {"method": "map", "algorithm": "constant", "termination": "constant", "iterations": 0, "objective": None, "stationarity": None}, [], [])
    found = maximise(p.problem, options.optimizer, warm_start(p, (options.warm_start or {}).get(p.model["series_id"])))
    if not np.isfinite(found.theta).all():
        raise FittingError("non-finite-result")
    summary = {"method": "map", "algorithm": found.algorithm, "termination": found.termination, "iterations": found.iterations, "objective": found.objective, "stationarity": p.problem.stationarity(found.theta)}
    return shape_model(p, units(p, found.theta), options, summary, [], [])


def _chain(pdf: pd.DataFrame, options: ForecastOptions) -> pd.DataFrame:
    p, mcmc, chain = prepare(pdf, options), options.mcmc, int(pdf["chain"].iloc[0])
    warmup = mcmc.samples // 2 if mcmc.warmup is None else mcmc.warmup
    rng = np.random.Generator(np.random.Philox(key=[mcmc.seed, chain]))
    draws, info = nuts(p.problem, p.problem.start(), mcmc.samples - warmup if mcmc.warmup is None else mcmc.samples, warmup, rng)
    rows = [{"series_id": p.model["series_id"], "chain": chain, "draw": i, **units(p, t), "divergences": info["divergences"]} for i, t in enumerate(draws)]
    return pd.DataFrame(rows, columns=["series_id", "chain", "draw", "k", "m", "sigma", "deltas", "beta", "divergences"])


def _pool(key, pdf: pd.DataFrame, draws: pd.DataFrame, options: ForecastOptions) -> dict:
    p = prepare(pdf, options)
    draws = draws.sort_values(["draw", "chain"])
    mean = lambda c: np.mean(np.array(draws[c].tolist(), float), axis=0)
    values = {c: mean(c).tolist() if c in ("deltas", "beta") else float(mean(c)) for c in ("k", "m", "sigma", "deltas", "beta")}
    chains = draws["chain"].nunique()
    table = {c: np.array(draws[c].tolist(), float).reshape(-1, chains).T for c in ("k", "m", "sigma")}
    diagnostics = []
    for name, x in table.items():
        rhat, bulk, tail = split_rhat_ess(x)
        diagnostics.append({"name": name, "rhat": None if math.isnan(rhat) else rhat, "bulk_ess": None if math.isnan(bulk) else bulk, "tail_ess": None if math.isnan(tail) else tail})
    kept = [{c: r[c] for c in ("chain", "draw", "k", "m", "sigma", "deltas", "beta")} for r in draws.to_dict("records")]
    summary = {"method": "mcmc", "algorithm": "nuts", "termination": f"{int(draws.groupby('chain')['divergences'].max().sum())} divergences", "iterations": len(draws), "objective": None, "stationarity": None}
    return shape_model(p, values, options, summary, kept, diagnostics)


def fit(history: DataFrame, options: ForecastOptions = ForecastOptions()) -> DataFrame:
    """history (series_id, pos, ts_ms, y, ...) -> MODEL, one row per series.

    Rows whose target, names or bounds do not fit the options raise the reason when they are read.
    """
    history = guard_history(history, options)
    columns = _MODEL_COLUMNS
    if options.mcmc is None:
        return history.groupBy("series_id").applyInPandas(lambda pdf: pd.DataFrame([fit_series(pdf, options)], columns=columns), MODEL)
    chains = history.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(options.mcmc.chains - 1))))
    draws = chains.groupBy("series_id", "chain").applyInPandas(lambda pdf: _chain(pdf, options), "series_id string, chain int, draw int, k double, m double, sigma double, deltas array<double>, beta array<double>, divergences int")
    both = history.groupBy("series_id").cogroup(draws.groupBy("series_id"))
    return both.applyInPandas(lambda pdf, d: pd.DataFrame([_pool(None, pdf, d, options)], columns=columns), MODEL)


_MODEL_COLUMNS = [c.strip().split(" ")[0] for c in (
    "series_id model_kind growth scaling y_offset y_scale time_origin time_scale k m sigma has_floor changepoints_ms deltas seasonalities events regressors fit_summary draws diagnostics country".split()
)]


def warm_start_parameters(models: DataFrame) -> dict:
    """Start values by series for ForecastOptions(warm_start=...); models are as many as the series of one call."""
    out = {}
    for r in models.select("series_id", "k", "m", "sigma", "deltas", "seasonalities", "events", "regressors").collect():
        beta = [c for s in r["seasonalities"] for c in s["coef"]]
        beta += list({(e["name"], e["offset"]): e["coef"] for e in r["events"]}.values()) + [x["coef"] for x in r["regressors"]]
        out[r["series_id"]] = {"k": r["k"], "m": r["m"], "sigma": r["sigma"], "deltas": list(r["deltas"]), "beta": beta}
    return out


def regressor_coefficients(models: DataFrame) -> DataFrame:
    """(series_id, name, mode, center, coef, lower, upper) in input units; the range is that of 80 % of draws, if any."""
    n = F.size("regressors")
    each = models.select("series_id", "draws", n.alias("n"), F.posexplode("regressors").alias("i", "r"))
    low = F.transform("draws", lambda d: F.element_at(d["beta"], F.col("i") - F.col("n")) / F.col("r")["sd"])
    drawn = each.select("series_id", F.col("r.name").alias("name"), F.col("r.mode").alias("mode"), F.col("r.mean").alias("center"), (F.col("r.coef") / F.col("r.sd")).alias("coef"), F.when(F.size("draws") > 0, low).alias("values"))
    spread = drawn.select("series_id", "name", "mode", "center", "coef", F.explode_outer("values").alias("v"))
    q = lambda p: F.percentile("v", F.lit(p))
    return spread.groupBy("series_id", "name", "mode", "center", "coef").agg(q(0.1).alias("lower"), q(0.9).alias("upper"))


def fit_regressor_models(history: DataFrame, options: ForecastOptions) -> dict[str, DataFrame]:
    """A model of each regressor that has a predictor, over the same timestamps, by regressor name."""
    out = {}
    for r in options.regressors:
        if r.predictor is not None:
            own = history.select("series_id", "pos", "ts_ms", F.col("regressors")[r.name].alias("y"))
            out[r.name] = fit(own, r.predictor)
    return out
