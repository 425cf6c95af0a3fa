"""Typed errors; every reason is one of a closed list."""

from __future__ import annotations


class ForecastError(Exception):
    """Base of all errors here. reason: one of `reasons`; details: what was found, as keyword values."""

    reasons: tuple[str, ...] = ()

    def __init__(self, reason: str, message: str = "", **details):
        if self.reasons and reason not in self.reasons:
            raise ValueError(f"{type(self).__name__} has no reason {reason!r}")
        self.reason, self.details = reason, details
        super().__init__(f"{reason}: {message}" if message else reason)


class InputError(ForecastError):
    """The caller's rows or options are at fault."""


_ROW_REASONS = (
    "empty", "invalid-shape", "missing-capacity", "inconsistent-floor", "capacity-not-above-floor", "bound-on-non-logistic", "missing-regressor",
    "unexpected-regressor", "unrepresentable-regressor", "missing-condition", "unexpected-condition",
)


class ObservationError(InputError):
    reasons = _ROW_REASONS


class PredictionInputError(InputError):
    reasons = (*_ROW_REASONS, "missing-floor", "unexpected-floor")


class OptionsError(InputError):
    reasons = ("invalid-shape", "invalid-value", "name-collision", "changepoint-out-of-range", "conflicting-options", "limit-exceeded")


class FutureTimestampsError(InputError):
    reasons = ("invalid-shape", "timestamp-overflow")


class UncertaintyOptionsError(InputError):
    reasons = ("invalid-shape", "unsupported-output")


class EvaluationPlanError(InputError):
    reasons = ("horizon-exceeds-history", "insufficient-data-after-initial", "cutoff-out-of-range", "empty-assessment", "summary-mismatch", "limit-exceeded", "timestamp-overflow", "invalid-shape")


class MetricOptionsError(InputError):
    reasons = ("invalid-shape", "row-count-out-of-range", "window-exceeds-rows")


class SearchOptionsError(InputError):
    reasons = ("invalid-candidate", "invalid-base-options", "invalid-mode", "cutoff-mismatch", "duplicate-choice", "limit-exceeded")


class HoldoutInputError(InputError):
    reasons = ("partition-not-later", "unsupported-objective", "receipt-mismatch", "objective-dropped", "limit-exceeded", "missing-intervals")


class CountryHolidayError(InputError):
    reasons = ("unknown-country", "invalid-year", "known-gap", "prior-conflict", "invalid-shape")


class EvaluationMetricError(ForecastError):
    reasons = ("unavailable", "zero-actual", "zero-denominator", "non-finite", "misaligned")


class MetricScaleError(ForecastError):
    reasons = ("insufficient-history", "non-finite", "zero-scale")


class EvaluationError(ForecastError):
    reasons = ("fit", "predict", "simulate", "baseline")


class EvaluationSearchError(ForecastError):
    reasons = ("candidate-failed", "no-success")


class HoldoutEvaluationError(ForecastError):
    reasons = ("fit", "predict", "metrics")


class EvaluationReportError(ForecastError):
    reasons = ("encode", "decode", "score-mismatch")


class FittingError(ForecastError):
    reasons = ("insufficient-observations", "degenerate-observations", "rank-deficient", "non-finite-result", "non-convergence", "memory-limit", "sampling-limit", "backend-failure")


class PredictionError(ForecastError):
    reasons = ("invalid-model", "non-finite-forecast", "backend-failure", "simulation-limit")


class ModelSerializationError(ForecastError):
    reasons = ("encode", "decode")


def is_input_error(error: BaseException) -> bool:
    return isinstance(error, InputError)
