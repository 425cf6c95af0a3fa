"""Feature columns: pure expressions, so they stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def epoch_day(ts_ms: Column) -> Column:
    return F.floor(ts_ms / F.lit(DAY_MS)).cast("int")


def time_of_day_ms(ts_ms: Column) -> Column:
    return F.pmod(ts_ms, F.lit(DAY_MS))


def to_ms(ts: Column) -> Column:
    """Epoch milliseconds; anything below a millisecond is cut off towards the past."""
    return F.unix_millis(ts.cast("timestamp"))


def scaled_time(ts_ms: Column, origin: Column, scale: Column) -> Column:
    return (ts_ms - origin).cast("double") / scale.cast("double")


def scale_value(y: Column, offset: Column, scale: Column) -> Column:
    return (y - offset) / scale


def hinge(tau: Column, at: Column) -> Column:
    return F.greatest(tau - at, F.lit(0.0))


def fourier(ts_ms: Column, period_days: float, order: int) -> list[Column]:
    """sin before cos for each harmonic, of days since the epoch."""
    days = ts_ms / F.lit(float(DAY_MS))
    angles = [F.lit(2.0 * math.pi * h) * days / F.lit(float(period_days)) for h in range(1, order + 1)]
    return [f(a) for a in angles for f in (F.sin, F.cos)]


def masked(feature: Column, condition: Column) -> Column:
    return F.when(condition, feature).otherwise(F.lit(0.0))


def stable_sigmoid(x: Column) -> Column:
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def linear_trend(tau: Column, k: Column, m: Column, changepoints: Column, deltas: Column) -> Column:
    """k, m, deltas in output units; changepoints in scaled time."""
    bends = F.aggregate(F.zip_with(changepoints, deltas, lambda s, d: d * F.greatest(tau - s, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return m + k * tau + bends


def logistic_trend(tau: Column, k: Column, m: Column, changepoints: Column, deltas: Column, cap: Column, floor: Column) -> Column:
    """floor + (cap - floor) * sigmoid(rate * (tau - offset)), rate and offset adjusted at each passed changepoint."""
    start = F.struct(k.alias("q"), m.alias("o"))

    def step(a: Column, x: Column) -> Column:
        q = a["q"] + x["d"]
        passed = x["s"] <= tau
        return F.struct(F.when(passed, q).otherwise(a["q"]).alias("q"), F.when(passed, a["o"] + (x["s"] - a["o"]) * (1 - a["q"] / q)).otherwise(a["o"]).alias("o"))

    state = F.aggregate(F.zip_with(changepoints, deltas, lambda s, d: F.struct(s.alias("s"), d.alias("d"))), start, step)
    return floor + (cap - floor) * stable_sigmoid(state["q"] * (tau - state["o"]))


def seasonal_component(ts_ms: Column, seasonality: Column) -> Column:
    """Fitted seasonality struct -> its value, without its condition."""
    days = ts_ms / F.lit(float(DAY_MS))
    angle = lambda i: F.lit(2.0 * math.pi) * ((i / 2).cast("int") + 1) * days / seasonality["period_days"]
    terms = F.transform(seasonality["coef"], lambda c, i: c * F.when(i % 2 == 0, F.sin(angle(i))).otherwise(F.cos(angle(i))))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
