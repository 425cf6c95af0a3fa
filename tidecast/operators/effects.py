"""Features of one series' rows under a fitted model, in numpy: one column for each coefficient, in the order of `beta`."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

from ..errors import PredictionInputError
from ..options import Seasonality
from .events import predicted_holidays
from .fit import event_block, fourier_block


@dataclass
class Features:
    """block (row, coefficient); by coefficient: component name, kind (seasonality, event, regressor), multiplicative, and
    the model's own coefficient."""

    block: np.ndarray
    names: list[str]
    kinds: list[str]
    multiplicative: np.ndarray
    coef: np.ndarray

    def effects(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(additive, multiplicative) sums by row."""
        m = self.multiplicative
        return self.block[:, ~m] @ beta[~m], self.block[:, m] @ beta[m]


def _value(maps, name: str, reason: str) -> np.ndarray:
    found = [dict(v or ()).get(name) for v in maps]
    if any(x is None for x in found):
        raise PredictionInputError(reason, name)
    return np.array(found, float)


def feature_matrix(model, rows: pd.DataFrame) -> Features:
    """model: a MODEL row; rows: ts_ms, and regressors and conditions where the model has any."""
    ts = rows["ts_ms"].to_numpy(np.int64)
    blocks, names, kinds, mult, coef = [np.zeros((len(ts), 0))], [], [], [], []

    def put(block: np.ndarray, name: list[str], kind: str, mode: str, values) -> None:
        blocks.append(block)
        names.extend(name)
        kinds.extend([kind] * block.shape[1])
        mult.extend([mode == "multiplicative"] * block.shape[1])
        coef.extend(float(x) for x in values)

    for s in model["seasonalities"]:
        block = fourier_block(ts, Seasonality(s["name"], s["period_days"], s["fourier_order"]))
        if s["condition"]:
            block = block * _value(rows["conditions"], s["condition"], "missing-condition")[:, None]
        put(block, [s["name"]] * block.shape[1], "seasonality", s["mode"], s["coef"])
    columns = list(dict.fromkeys((e["name"], e["offset"]) for e in model["events"]))
    if columns:
        own = {(e["name"], e["offset"]): e["coef"] for e in model["events"]}
        years = sorted(set(pd.to_datetime(ts, unit="ms").year.tolist()))
        ahead = predicted_holidays(model["country"], years, {n for n, _ in columns})
        days = [(e["name"], e["epoch_day"], e["offset"]) for e in model["events"]] + ahead
        put(event_block(ts, columns, days), [n for n, _ in columns], "event", model["events"][0]["mode"], [own[c] for c in columns])
    for r in model["regressors"]:
        x = _value(rows["regressors"], r["name"], "missing-regressor")
        put(((x - r["mean"]) / r["sd"])[:, None], [r["name"]], "regressor", r["mode"], [r["coef"]])
    return Features(np.concatenate(blocks, axis=1), names, kinds, np.array(mult, bool), np.array(coef))
