import math

import numpy as np
import pandas as pd
import pytest

from tidecast.errors import FittingError, OptionsError, ObservationError, PredictionError, is_input_error
from tidecast.operators.evaluate import generate_cutoffs, predict_series
from tidecast.operators.fit import fit_series, prepare
from tidecast.operators.history import changepoint_positions
from tidecast.operators.numerics import ForecastProblem, maximise, nuts, split_rhat_ess
from tidecast.operators.simulate import fnv1a
from tidecast.options import Event, ForecastOptions, Mcmc, Optimizer, Regressor, Seasonality

DAY = 86_400_000


def problem(growth, seed=0, n=80, cps=3, features=4):
    rnd = np.random.default_rng(seed)
    tau = np.sort(rnd.random(n))
    tau[0], tau[-1] = 0, 1
    cap = np.full(n, 1.4) if growth == "logistic" else None
    y = 0.3 + 0.5 * tau + 0.05 * rnd.standard_normal(n)
    x = rnd.standard_normal((n, features))
    mult = np.arange(features) % 2 == 0
    return ForecastProblem(growth, tau, y, np.linspace(0.1, 0.8, cps) if cps else np.zeros(0), 0.05, x, mult, np.full(features, 10.0), cap)


@pytest.mark.parametrize("growth", ["linear", "flat", "logistic"])
@pytest.mark.parametrize("cps", [0, 3])
def test_gradient_is_the_derivative(growth, cps):
    p = problem(growth, cps=cps)
    rnd = np.random.default_rng(1)
    theta = p.start() + 0.1 * rnd.standard_normal(p.size)
    _, grad = p.density(theta)
    for i in range(p.size):
        e = np.zeros(p.size)
        e[i] = 1e-6
        slope = (p.density(theta + e)[0] - p.density(theta - e)[0]) / 2e-6
        assert abs(slope - grad[i]) < 1e-4 * max(1, abs(slope)), i


@pytest.mark.parametrize("growth", ["linear", "flat", "logistic"])
def test_both_optimisers_reach_the_same_optimum(growth):
    p = problem(growth, n=150)
    a = maximise(p, Optimizer(algorithm="lbfgs"))
    b = maximise(p, Optimizer(algorithm="newton"))
    assert abs(a.objective - b.objective) < 0.1  # both may stop short at a kink
    assert np.allclose(p.trend(a.theta), p.trend(b.theta), atol=0.01)


def series(n=200, seed=0, **more):
    rnd = np.random.default_rng(seed)
    t = np.arange(n) * DAY
    y = 10 + 0.02 * np.arange(n) + 2 * np.sin(2 * np.pi * np.arange(n) / 7) + 0.1 * rnd.standard_normal(n)
    return pd.DataFrame({"series_id": "a", "pos": np.arange(n), "ts_ms": t, "y": y, **more})


def test_fit_recovers_a_known_series_and_extrapolates():
    model = fit_series(series(), ForecastOptions())
    ahead = pd.DataFrame({"series_id": "a", "ts_ms": (200 + np.arange(14)) * DAY})
    found = predict_series(model, ahead)["predicted"].to_numpy()
    want = 10 + 0.02 * (200 + np.arange(14)) + 2 * np.sin(2 * np.pi * (200 + np.arange(14)) / 7)
    assert np.abs(found - want).max() < 0.5
    assert [s["name"] for s in model["seasonalities"]] == ["weekly"] and abs(model["sigma"] - 0.1) < 0.05


def test_row_order_does_not_matter_but_repeats_do():
    a = fit_series(series(60), ForecastOptions())
    b = fit_series(series(60).sample(frac=1, random_state=1), ForecastOptions())
    assert a["k"] == b["k"] and a["seasonalities"] == b["seasonalities"]
    twice = pd.concat([series(60), series(60)]).sort_values("ts_ms").assign(pos=range(120))
    assert fit_series(twice, ForecastOptions())["sigma"] != a["sigma"]


def test_constant_one_row_and_zero_span():
    flat = fit_series(series(50).assign(y=3.0), ForecastOptions())
    assert flat["fit_summary"]["algorithm"] == "constant" and flat["m"] == pytest.approx(3.0) and flat["k"] == 0
    with pytest.raises(FittingError) as e:
        fit_series(series(1), ForecastOptions())
    assert e.value.reason == "insufficient-observations"
    same = series(5).assign(ts_ms=0)
    with pytest.raises(FittingError) as e:
        fit_series(same, ForecastOptions())
    assert e.value.reason == "degenerate-observations"
    assert math.isfinite(fit_series(same, ForecastOptions(growth="flat"))["m"])


def test_minmax_multiplicative_events_regressors_and_conditions():
    n = 300
    rnd = np.random.default_rng(2)
    x = rnd.standard_normal(n)
    base = series(n)
    pdf = base.assign(y=base["y"] + 3 * x, regressors=[{"x": float(v)} for v in x], conditions=[{"on": bool(i % 2)} for i in range(n)])
    pdf.loc[100, "y"] += 8
    options = ForecastOptions(scaling="minmax", regressors=(Regressor("x", mode="additive"),), events=(Event("day", "1970-04-11", 0, 0),), seasonalities=(Seasonality("odd", 3.0, 1, condition="on"),), seasonality_mode="additive")
    model = fit_series(pdf, options)
    coef = model["regressors"][0]
    assert abs(coef["coef"] / coef["sd"] - 3) < 0.1
    assert abs(model["events"][0]["coef"] - 8) < 1
    times = fit_series(base.assign(y=base["y"] * (1 + 0.3 * np.sin(2 * np.pi * np.arange(n) / 7))), ForecastOptions(seasonality_mode="multiplicative"))
    found = predict_series(times, base)
    assert np.allclose(found["predicted"], found["trend"] * (1 + found["multiplicative"]) + found["additive"])


def test_logistic_stays_between_floor_and_capacity():
    t = np.arange(120)
    y = 2 + 8 / (1 + np.exp(-(t - 60) / 10))
    pdf = pd.DataFrame({"series_id": "a", "pos": t, "ts_ms": t * DAY, "y": y, "capacity": 10.0, "floor": 2.0})
    model = fit_series(pdf, ForecastOptions(growth="logistic", weekly="off", n_changepoints=3))
    found = predict_series(model, pd.DataFrame({"ts_ms": np.arange(0, 400) * DAY, "capacity": 10.0, "floor": 2.0}))
    assert found["trend"].between(2, 10).all() and abs(found["trend"].iloc[-1] - 10) < 0.3 and np.abs(found["trend"][:120] - y).max() < 0.3


def test_sampler_agrees_with_the_optimum_and_mixes():
    p = problem("linear", n=60, cps=1, features=0)
    chains = []
    for c in range(2):
        draws, _ = nuts(p, p.start(), 150, 200, np.random.default_rng(c))
        chains.append(draws)
    both = np.array(chains)
    best = maximise(p, Optimizer(algorithm="lbfgs"))
    trends = np.array([p.trend(t) for t in both.reshape(-1, p.size)])
    assert np.abs(trends.mean(axis=0) - p.trend(best.theta)).max() < 0.1
    rhat, bulk, tail = split_rhat_ess(both[:, :, 1])
    assert rhat < 1.1 and bulk > 30 and tail > 10


def test_changepoints_cutoffs_and_hashes():
    assert changepoint_positions(10, 25, 0.8) == [1, 2, 3, 4, 5, 6, 7]
    assert changepoint_positions(1, 25, 0.8) == [] and changepoint_positions(100, 3, 0.8)[-1] == 79
    ts = list(range(0, 100 * DAY, DAY))
    cut = generate_cutoffs(ts, 10 * DAY)
    assert cut[-1] == 89 * DAY and cut[0] >= 30 * DAY and all(b - a == 5 * DAY for a, b in zip(cut, cut[1:], strict=False))
    gap = [t for t in ts if not 40 * DAY <= t < 70 * DAY]
    assert all(any(c < t <= c + 10 * DAY for t in gap) for c in generate_cutoffs(gap, 10 * DAY))
    assert fnv1a("") == 0x811C9DC5 and fnv1a("a") == 0xE40C292C


def test_options_are_checked():
    for bad in (dict(growth="x"), dict(changepoint_prior_scale=0), dict(optimizer=Optimizer(), mcmc=Mcmc(10, 1)), dict(regressors=(Regressor("a"), Regressor("a")))):
        with pytest.raises(OptionsError) as e:
            ForecastOptions(**bad)
        assert is_input_error(e.value)
    for name in ("", "a_delim_b", "trend"):
        with pytest.raises(OptionsError):
            Regressor(name)
    assert not is_input_error(PredictionError("invalid-model"))
    with pytest.raises(ValueError):
        ObservationError("no such reason")


def test_prepare_counts_features():
    p = prepare(series(800), ForecastOptions())
    assert p.problem.features.shape == (800, 26) and len(p.problem.changepoints) == 25
