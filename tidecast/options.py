"""Configuration documents: frozen dataclasses, checked when made."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from .errors import OptionsError

DEFAULT_PRIOR_SCALE = 10.0
DELIMITER = "_delim_"
# Names that features may not have, because the forecast has columns of these names.
RESERVED_NAMES = ("trend", "additive_terms", "daily", "weekly", "yearly", "holidays", "zeros", "extra_regressors_additive", "yhat", "extra_regressors_multiplicative", "multiplicative_terms", "ds", "y", "cap", "floor")
MODES = ("additive", "multiplicative")
MAX_FUTURE_PERIODS = 100_000
MAX_SEARCH_CANDIDATES = 32
DEFAULT_INTERVAL_WIDTH = 0.8
DEFAULT_ANOMALY_WIDTH = 0.99
MAX_SIMULATION_ROWS = 10_000
MAX_SAMPLE_CELLS = 1_000_000
MAX_SAMPLES = 2048


def _positive(value: float, name: str) -> None:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value <= 0:
        raise OptionsError("invalid-value", f"{name} must be positive and finite", name=name, value=value)


def _one_of(value: object, allowed: tuple, name: str) -> None:
    if value not in allowed:
        raise OptionsError("invalid-value", f"{name} must be one of {allowed}", name=name, value=value)


def _name(value: str, built_in: tuple[str, ...] = ()) -> None:
    if not isinstance(value, str) or not value or DELIMITER in value or value in RESERVED_NAMES and value not in built_in:
        raise OptionsError("invalid-value", f"unusable name {value!r}", name=value)


@dataclass(frozen=True)
class Seasonality:
    name: str
    period_days: float
    fourier_order: int
    prior_scale: float = DEFAULT_PRIOR_SCALE
    mode: str = "additive"
    condition: str | None = None

    def __post_init__(self) -> None:
        _name(self.name, ("daily", "weekly", "yearly"))
        _positive(self.period_days, "period_days"), _positive(self.prior_scale, "prior_scale"), _one_of(self.mode, MODES, "mode")
        if not isinstance(self.fourier_order, int) or self.fourier_order < 1:
            raise OptionsError("invalid-value", "fourier_order must be a positive integer")


@dataclass(frozen=True)
class Event:
    name: str
    date: str
    lower_window: int = 0
    upper_window: int = 0
    prior_scale: float | None = None

    def __post_init__(self) -> None:
        _name(self.name)
        if self.lower_window > 0 or self.upper_window < 0:
            raise OptionsError("invalid-value", "an event's window must contain its day", name=self.name)
        if self.prior_scale is not None:
            _positive(self.prior_scale, "prior_scale")


@dataclass(frozen=True)
class Regressor:
    name: str
    prior_scale: float | None = None
    standardize: str = "auto"
    mode: str | None = None
    predictor: "ForecastOptions | None" = None

    def __post_init__(self) -> None:
        _name(self.name), _one_of(self.standardize, ("auto", "always", "never"), "standardize")
        if self.mode is not None:
            _one_of(self.mode, MODES, "mode")
        if self.prior_scale is not None:
            _positive(self.prior_scale, "prior_scale")


@dataclass(frozen=True)
class CountryHolidays:
    country: str
    prior_scale: float | None = None
    coverage: str = "reject-known-gaps"

    def __post_init__(self) -> None:
        _one_of(self.coverage, ("reject-known-gaps", "allow-known-gaps"), "coverage")


@dataclass(frozen=True)
class Optimizer:
    algorithm: str = "auto"
    iterations: int = 10_000
    newton_fallback: bool = True
    history: int = 5
    initial_step: float = 0.001
    tol_objective: float = 1e-12
    tol_relative_objective: float = 1e4
    tol_gradient: float = 1e-8
    tol_relative_gradient: float = 1e7
    tol_parameters: float = 1e-8

    def __post_init__(self) -> None:
        _one_of(self.algorithm, ("auto", "lbfgs", "newton"), "algorithm")
        if self.iterations < 1:
            raise OptionsError("invalid-value", "iterations must be positive")


@dataclass(frozen=True)
class Mcmc:
    samples: int
    seed: int
    chains: int = 4
    warmup: int | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.chains <= 16 or not 1 <= self.samples <= 20_000 or not 0 <= self.seed < 1 << 32:
            raise OptionsError("limit-exceeded", "chains 1..16, samples 1..20000, seed a 32-bit number")
        if self.warmup is not None and not 0 <= self.warmup <= 100_000:
            raise OptionsError("limit-exceeded", "warmup 0..100000")


@dataclass(frozen=True)
class ForecastOptions:
    growth: str = "linear"
    seasonality_mode: str = "additive"
    holidays_mode: str | None = None
    seasonality_prior_scale: float = DEFAULT_PRIOR_SCALE
    holidays_prior_scale: float = DEFAULT_PRIOR_SCALE
    yearly: str = "auto"
    weekly: str = "auto"
    daily: str = "auto"
    seasonalities: tuple[Seasonality, ...] = ()
    events: tuple[Event, ...] = ()
    country_holidays: CountryHolidays | None = None
    regressors: tuple[Regressor, ...] = ()
    scaling: str = "absmax"
    n_changepoints: int = 25
    changepoint_range: float = 0.8
    changepoints_ms: tuple[int, ...] | None = None
    changepoint_prior_scale: float = 0.05
    optimizer: Optimizer | None = None
    mcmc: Mcmc | None = None
    warm_start: dict | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        _one_of(self.growth, ("linear", "flat", "logistic"), "growth"), _one_of(self.scaling, ("absmax", "minmax"), "scaling")
        _one_of(self.seasonality_mode, MODES, "seasonality_mode")
        for name in ("yearly", "weekly", "daily"):
            _one_of(getattr(self, name), ("auto", "on", "off"), name)
        for name in ("seasonality_prior_scale", "holidays_prior_scale", "changepoint_prior_scale"):
            _positive(getattr(self, name), name)
        if self.n_changepoints < 0 or not 0 < self.changepoint_range <= 1:
            raise OptionsError("invalid-value", "n_changepoints >= 0, changepoint_range in (0, 1]")
        if self.changepoints_ms is not None and any(b <= a for a, b in zip(self.changepoints_ms, self.changepoints_ms[1:], strict=False)):
            raise OptionsError("invalid-value", "explicit changepoints must increase strictly")
        if self.optimizer is not None and self.mcmc is not None:
            raise OptionsError("conflicting-options", "an optimizer and mcmc exclude one another")
        names = [s.name for s in self.seasonalities] + [s.condition for s in self.seasonalities if s.condition] + sorted({e.name for e in self.events}) + [r.name for r in self.regressors]
        if len(set(names)) < len(names) and len({s.condition for s in self.seasonalities if s.condition}) == len([s for s in self.seasonalities if s.condition]):
            raise OptionsError("name-collision", "configured names must be distinct", names=names)
        priors: dict[str, set] = {}
        for e in self.events:
            priors.setdefault(e.name, set()).add(e.prior_scale)
        if any(len(x) > 1 for x in priors.values()):
            raise OptionsError("invalid-value", "an event has one prior scale")

    @property
    def event_mode(self) -> str:
        return self.holidays_mode or self.seasonality_mode

    def with_(self, **changes) -> "ForecastOptions":
        return replace(self, **changes)
