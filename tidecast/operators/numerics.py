"""Dense numerics of one series: log density with gradient, Newton and L-BFGS, and the no-U-turn sampler (numpy only).

Parameters are [k, m, delta..., log sigma, beta...] in scaled units; see ForecastProblem.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np

from ..errors import FittingError
from ..options import Optimizer


@dataclass
class ForecastProblem:
    """One series in scaled units. growth: linear, flat or logistic."""

    growth: str
    tau: np.ndarray
    y: np.ndarray
    changepoints: np.ndarray
    changepoint_prior: float
    features: np.ndarray
    multiplicative: np.ndarray
    priors: np.ndarray
    cap: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.s = self.changepoints if len(self.changepoints) else np.zeros(1)
        self.x = self.features if self.features.shape[1] else np.zeros((len(self.y), 1))
        self.mult = self.multiplicative if self.features.shape[1] else np.zeros(1, bool)
        self.prior = self.priors if self.features.shape[1] else np.ones(1)
        self.hinges = np.maximum(self.tau[:, None] - self.s[None, :], 0.0)
        self.active = (self.tau[:, None] >= self.s[None, :]).sum(axis=1)
        self.size = 3 + len(self.s) + self.x.shape[1]

    def parts(self, theta: np.ndarray) -> tuple[float, float, np.ndarray, float, np.ndarray]:
        n = len(self.s)
        return theta[0], theta[1], theta[2 : 2 + n], theta[2 + n], theta[3 + n :]

    def start(self) -> np.ndarray:
        theta = np.zeros(self.size)
        first, last = int(np.argmin(self.tau)), int(np.argmax(self.tau))
        if self.growth == "flat":
            theta[1] = self.y.mean()
        elif self.growth == "linear":
            theta[0] = (self.y[last] - self.y[first]) / (self.tau[last] - self.tau[first])
            theta[1] = self.y[first] - theta[0] * self.tau[first]
        else:
            r0 = self.cap[first] / min(max(self.y[first], 0.01 * self.cap[first]), 0.99 * self.cap[first])
            r1 = self.cap[last] / min(max(self.y[last], 0.01 * self.cap[last]), 0.99 * self.cap[last])
            if abs(r0 - r1) <= 0.01:
                r0 *= 1.05
            l0, l1 = math.log(r0 - 1), math.log(r1 - 1)
            span = self.tau[last] - self.tau[first]
            theta[1] = l0 * span / (l0 - l1)
            theta[0] = (l0 - l1) / span
        return theta

    def trend(self, theta: np.ndarray) -> np.ndarray:
        k, m, delta, _, _ = self.parts(theta)
        if self.growth == "flat":
            return np.full(len(self.y), m)
        if self.growth == "linear":
            return k * self.tau + m + self.hinges @ delta
        q, offset = rates(k, m, delta, self.s)
        return self.cap * sigmoid(q[self.active] * (self.tau - offset[self.active]))

    def density(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Log density without constants, and its gradient; -inf where a state is not allowed."""
        k, m, delta, log_sigma, beta = self.parts(theta)
        n, count = len(self.s), len(self.y)
        grad = np.zeros(self.size)
        if not np.isfinite(theta).all() or abs(log_sigma) > 300:
            return -math.inf, grad
        sigma = math.exp(log_sigma)
        share = None
        if self.growth == "logistic":
            q, offset = rates(k, m, delta, self.s)
            if not (np.isfinite(q).all() and np.isfinite(offset).all() and (q[1:] != 0).all()):
                return -math.inf, grad
            share = sigmoid(q[self.active] * (self.tau - offset[self.active]))
            trend = self.cap * share
        else:
            trend = self.trend(theta)
        add = self.x[:, ~self.mult] @ beta[~self.mult]
        times = 1.0 + self.x[:, self.mult] @ beta[self.mult]
        r = (self.y - add - trend * times) / sigma
        value = -count * log_sigma - 0.5 * float(r @ r) - 0.5 * (k * k + m * m) / 25 - float(np.abs(delta).sum()) / self.changepoint_prior - 2.0 * sigma * sigma - 0.5 * float(((beta / self.prior) ** 2).sum())
        score = r / sigma
        pull = score * times
        if self.growth == "linear":
            grad[0], grad[1] = self.tau @ pull, pull.sum()
            grad[2 : 2 + n] = self.hinges.T @ pull
        elif self.growth == "flat":
            grad[1] = pull.sum()
        else:
            g = pull * self.cap * share * (1 - share)
            dq = np.bincount(self.active, g * (self.tau - offset[self.active]), n + 1)
            dm = np.bincount(self.active, -g * q[self.active], n + 1)
            for j in range(n, 0, -1):
                back = offset[j - 1] - self.s[j - 1]
                dq[j] += dm[j] * -back * q[j - 1] / (q[j] * q[j])
                dq[j - 1] += dm[j] * back / q[j]
                dm[j - 1] += dm[j] * q[j - 1] / q[j]
                grad[1 + j] = dq[j]
                dq[j - 1] += dq[j]
            grad[0], grad[1] = dq[0], dm[0]
        grad[0] -= k / 25
        grad[1] -= m / 25
        grad[2 : 2 + n] -= np.sign(delta) / self.changepoint_prior
        grad[2 + n] = float(r @ r) - count - 4 * sigma * sigma
        gb = self.x.T @ score
        if self.mult.any():
            gb[self.mult] = self.x[:, self.mult].T @ (score * trend)
        grad[3 + n :] = gb - beta / self.prior**2
        if not math.isfinite(value) or not np.isfinite(grad).all():
            return -math.inf, np.zeros(self.size)
        return value, grad

    def stationarity(self, theta: np.ndarray) -> float:
        """Largest violation of the optimality conditions, with the sub-gradient of the kink at zero changes."""
        _, grad = self.density(theta)
        n = len(self.s)
        delta = theta[2 : 2 + n]
        out = np.abs(grad)
        near = np.abs(delta) < 1e-6
        smooth = grad[2 : 2 + n] + np.sign(delta) / self.changepoint_prior
        out[2 : 2 + n] = np.where(near, np.maximum(np.abs(smooth) - 1 / self.changepoint_prior, 0), out[2 : 2 + n])
        return float(out.max())


def sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


def rates(k: float, m: float, delta: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Growth rate and offset of each segment of a logistic trend."""
    q = k + np.concatenate(([0.0], np.cumsum(delta)))
    offset = np.empty(len(s) + 1)
    offset[0] = m
    for j in range(1, len(s) + 1):
        ratio = q[j - 1] / q[j] if q[j] else math.inf
        offset[j] = offset[j - 1] + (s[j - 1] - offset[j - 1]) * (1 - ratio)
    return q, offset


@dataclass
class Solution:
    theta: np.ndarray
    objective: float
    iterations: int
    algorithm: str
    termination: str


def _cubic(a: float, fa: float, ga: float, b: float, fb: float, gb: float) -> float:
    d1 = ga + gb - 3 * (fa - fb) / (a - b) if a != b else math.nan
    root = d1 * d1 - ga * gb
    if not root >= 0:
        return (a + b) / 2
    d2 = math.copysign(math.sqrt(root), b - a)
    low = gb - ga + 2 * d2
    return b - (b - a) * (gb + d2 - d1) / low if low else (a + b) / 2


def _wolfe(f, x, fx, gx, p, step, c1=1e-4, c2=0.9):
    """(step, value, gradient) of a point that meets the strong Wolfe conditions, None if none is found."""
    slope = float(gx @ p)
    if slope >= 0:
        return None
    prev, f_prev, g_prev = 0.0, fx, slope
    a, halved = step, 0

    def at(t):
        v, g = f(x + t * p)
        return v, g, float(g @ p)

    for turn in range(20):
        v, g, d = at(a)
        while not math.isfinite(v) and halved < 40:
            a, halved = (prev + a) / 2, halved + 1
            v, g, d = at(a)
        if not math.isfinite(v):
            return None
        if v > fx + c1 * a * slope or turn and v >= f_prev:
            return _zoom(at, fx, slope, prev, f_prev, g_prev, a, v, d, c1, c2)
        if abs(d) <= -c2 * slope:
            return a, v, g
        if d >= 0:
            return _zoom(at, fx, slope, a, v, d, prev, f_prev, g_prev, c1, c2)
        prev, f_prev, g_prev, a = a, v, d, a * 10
    return None


def _zoom(at, fx, slope, lo, f_lo, g_lo, hi, f_hi, g_hi, c1, c2):
    for turn in range(1, 60):
        if abs(hi - lo) < 1e-16:
            return None
        a = _cubic(lo, f_lo, g_lo, hi, f_hi, g_hi) if turn % 5 else (lo + hi) / 2
        edge = 0.01 * abs(hi - lo)
        if not min(lo, hi) + edge <= a <= max(lo, hi) - edge:
            a = (lo + hi) / 2
        v, g, d = at(a)
        if not math.isfinite(v) or v > fx + c1 * a * slope or v >= f_lo:
            hi, f_hi, g_hi = a, v if math.isfinite(v) else 1e300, d
            continue
        if abs(d) <= -c2 * slope:
            return a, v, g
        if d * (hi - lo) >= 0:
            hi, f_hi, g_hi = lo, f_lo, g_lo
        lo, f_lo, g_lo = a, v, d
    return None


def lbfgs(problem: ForecastProblem, theta: np.ndarray, control: Optimizer) -> Solution:
    def f(t):
        v, g = problem.density(t)
        return -v, -g

    eps = np.finfo(float).eps
    x = theta.copy()
    fx, gx = f(x)
    if not math.isfinite(fx):
        raise FittingError("non-finite-result", "the start has no finite density")
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    p, step, iteration, fresh = -gx, control.initial_step, 0, True
    while iteration < control.iterations:
        found = _wolfe(f, x, fx, gx, p, step)
        if found is None:
            if fresh:
                return Solution(x, -fx, iteration, "lbfgs", "line-search-failure")
            pairs, p, step, fresh = [], -gx, control.initial_step, True
            continue
        iteration += 1
        a, fn, gn = found
        s, y = a * p, gn - gx
        change = fx - fn
        last_slope = float(gx @ p)
        x, fx, gx = x + s, fn, gn
        curve = float(s @ y)
        if curve > 0:
            pairs = [*pairs[-(control.history - 1) :], (s, y)] if control.history > 1 else [(s, y)]
        q, alphas = gx.copy(), []
        for sv, yv in reversed(pairs):
            alphas.append(float(sv @ q) / float(sv @ yv))
            q -= alphas[-1] * yv
        if pairs:
            sv, yv = pairs[-1]
            q *= float(sv @ yv) / float(yv @ yv)
        for (sv, yv), al in zip(pairs, reversed(alphas), strict=True):
            q += (al - float(yv @ q) / float(sv @ yv)) * sv
        p, fresh = -q, False
        if abs(change) < control.tol_objective:
            return Solution(x, -fx, iteration, "lbfgs", "objective")
        if float(np.linalg.norm(gx)) < control.tol_gradient:
            return Solution(x, -fx, iteration, "lbfgs", "gradient")
        if float(np.linalg.norm(s)) < control.tol_parameters:
            return Solution(x, -fx, iteration, "lbfgs", "parameters")
        if abs(change) / max(abs(fx), 1.0) < control.tol_relative_objective * eps:
            return Solution(x, -fx, iteration, "lbfgs", "relative-objective")
        if -float(p @ gx) / max(abs(fx), 1.0) < control.tol_relative_gradient * eps:
            return Solution(x, -fx, iteration, "lbfgs", "relative-gradient")
        slope = float(gx @ p)
        step = min(1.0, 1.01 * 2 * -change / last_slope) if slope < 0 and last_slope < 0 and change > 0 else 1.0
        if not step > 0:
            step = 1.0
    return Solution(x, -fx, iteration, "lbfgs", "iterations")


def newton(problem: ForecastProblem, theta: np.ndarray, control: Optimizer) -> Solution:
    """Damped Newton on finite-difference Hessians of the gradient; eigenvalues enter by size."""
    x = theta.copy()
    value, grad = problem.density(x)
    if not math.isfinite(value):
        raise FittingError("non-finite-result", "the start has no finite density")
    step = 1e-3
    for iteration in range(1, control.iterations + 1):
        n = len(x)
        hess = np.zeros((n, n))
        for c in range(n):
            for shift, weight in ((-2, 1 / 12), (-1, -2 / 3), (1, 2 / 3), (2, -1 / 12)):
                moved = x.copy()
                moved[c] += shift * step
                g = weight * problem.density(moved)[1] / step
                hess[c] += 0.5 * g
                hess[:, c] += 0.5 * g
        if not np.isfinite(hess).all():
            raise FittingError("non-finite-result", "the Hessian is not finite")
        lam, vec = np.linalg.eigh(hess)
        lam = np.where(np.abs(lam) < 1e-12, 1e-12, np.abs(lam))
        direction = vec @ ((vec.T @ grad) / lam)
        t, moved = 1.0, False
        while t >= 1e-50:
            trial, trial_grad = problem.density(x + t * direction)
            if trial >= value:
                moved = True
                break
            t /= 2
        if not moved:
            return Solution(x, value, iteration, "newton", "no-progress")
        gain = trial - value
        x, value, grad = x + t * direction, trial, trial_grad
        if abs(gain) <= 1e-8:
            return Solution(x, value, iteration, "newton", "objective")
    return Solution(x, value, control.iterations, "newton", "iterations")


def maximise(problem: ForecastProblem, control: Optimizer | None, theta: np.ndarray | None = None) -> Solution:
    """MAP estimate. auto: Newton below 100 rows, else L-BFGS with Newton where its line search fails.

    Where the noise tends to zero Newton creeps; after 100 steps auto goes on from there with L-BFGS.
    """
    control = control or Optimizer()
    theta = problem.start() if theta is None else theta
    if control.algorithm == "newton":
        return newton(problem, theta, control)
    if control.algorithm == "auto" and len(problem.y) < 100:
        found = newton(problem, theta, replace(control, iterations=min(control.iterations, 100)))
        if found.termination != "iterations" or control.iterations <= 100:
            return found
        more = lbfgs(problem, found.theta, control)
        return more if more.objective >= found.objective else found
    try:
        found = lbfgs(problem, theta, control)
    except FittingError:
        if control.newton_fallback:
            return newton(problem, theta, control)
        raise
    if found.termination == "line-search-failure" and found.iterations == 0 and control.newton_fallback:
        return newton(problem, theta, control)
    return found


# --- no-U-turn sampler -------------------------------------------------------------------------------------------------

_DEPTH, _TARGET, _GAMMA, _KAPPA, _T0, _INIT, _BASE, _TERM, _DIVERGED = 10, 0.8, 0.05, 0.75, 10, 75, 25, 50, 1000.0


def nuts(problem: ForecastProblem, theta: np.ndarray, samples: int, warmup: int, rng: np.random.Generator) -> tuple[np.ndarray, dict]:
    """(draws, summary): multinomial no-U-turn sampling with a diagonal metric adapted in doubling windows.

    The density carries the Jacobian of log sigma.
    """
    sigma_at = 2 + len(problem.s)

    def f(t):
        v, g = problem.density(t)
        if math.isfinite(v):
            v += t[sigma_at]
            g = g.copy()
            g[sigma_at] += 1
        return v, g

    n = len(theta)
    inverse = np.ones(n)
    q = theta.copy()
    v, g = f(q)

    def leap(q, p, g, e):
        p = p + 0.5 * e * g
        q = q + e * inverse * p
        v, g = f(q)
        return q, p + 0.5 * e * g, v, g

    def energy(v, p):
        return v - 0.5 * float(p @ (inverse * p))

    def first_step():
        e, p = 0.1, rng.standard_normal(n) / np.sqrt(inverse)
        h0 = energy(v, p)
        _, p1, v1, _ = leap(q, p, g, e)
        up = energy(v1, p1) - h0 > math.log(0.8) if math.isfinite(v1) else False
        for _ in range(60):
            e = e * 2 if up else e / 2
            p = rng.standard_normal(n) / np.sqrt(inverse)
            h0 = energy(v, p)
            _, p1, v1, _ = leap(q, p, g, e)
            now = math.isfinite(v1) and energy(v1, p1) - h0 > math.log(0.8)
            if now != up:
                break
        return e

    def tree(q, p, g, h0, e, depth):
        """left/right ends, sample, log weight, momentum sum, acceptance sum, leaves, ok."""
        if depth == 0:
            q1, p1, v1, g1 = leap(q, p, g, e)
            h = energy(v1, p1) if math.isfinite(v1) else -math.inf
            ok = h0 - h < _DIVERGED
            return (q1, p1, g1), (q1, p1, g1), (q1, v1, g1), h - h0, p1, min(1.0, math.exp(min(0.0, h - h0))), 1, ok, not ok
        a = tree(q, p, g, h0, e, depth - 1)
        if not a[7]:
            return a
        b = tree(*a[1], h0, e, depth - 1)
        total = np.logaddexp(a[3], b[3])
        pick = b[2] if b[7] and math.log(rng.random() + 1e-300) < b[3] - total else a[2]
        rho = a[4] + b[4]
        ok = b[7] and turning(a[0], b[1], rho) and turning(a[0], b[0], a[4] + b[0][1]) and turning(a[1], b[1], b[4] + a[1][1])
        return a[0], b[1], pick, total, rho, a[5] + b[5], a[6] + b[6], ok, b[8]

    def turning(start, end, rho):
        w = inverse * rho
        return float(start[1] @ w) > 0 and float(end[1] @ w) > 0

    e = first_step()
    mu, bar, x_bar, count = math.log(10 * e), 0.0, 0.0, 0
    windows, at, size = [], _INIT, _BASE
    if warmup >= _INIT + _BASE + _TERM:
        while at + size <= warmup - _TERM:
            end = at + size
            if end + 2 * size > warmup - _TERM:
                end = warmup - _TERM
            windows.append(end)
            at, size = end, size * 2
    draws, seen, diverged, depths = [], [], 0, []
    for it in range(warmup + samples):
        p = rng.standard_normal(n) / np.sqrt(inverse)
        h0 = energy(v, p)
        left = right = (q, p, g)
        pick, weight, rho, accept, leaves, bad, depth = (q, v, g), 0.0, p, 0.0, 0, False, 0
        while depth < _DEPTH:
            forward = rng.random() < 0.5
            if forward:
                t = tree(*right, h0, e, depth)
                inner, outer = t[0], t[1]
            else:
                t = tree(*left, h0, -e, depth)
                inner, outer = t[0], t[1]
            accept, leaves = accept + t[5], leaves + t[6]
            bad = bad or t[8]
            depth += 1
            if not t[7]:
                break
            if math.log(rng.random() + 1e-300) < t[3] - weight:
                pick = t[2]
            weight = np.logaddexp(weight, t[3])
            old_rho, rho = rho, rho + t[4]
            if forward:
                lo, hi, join_lo, join_hi = left, outer, right, inner
                right = outer
                ok = turning(lo, hi, rho) and turning(lo, join_hi, old_rho + join_hi[1]) and turning(join_lo, hi, t[4] + join_lo[1])
            else:
                lo, hi, join_lo, join_hi = outer, right, inner, left
                left = outer
                ok = turning(lo, hi, rho) and turning(lo, join_hi, t[4] + join_hi[1]) and turning(join_lo, hi, old_rho + join_lo[1])
            if not ok:
                break
        q, v, g = pick
        rate = accept / max(1, leaves)
        if it < warmup:
            count += 1
            eta = 1 / (count + _T0)
            bar = (1 - eta) * bar + eta * (_TARGET - rate)
            x = mu - bar * math.sqrt(count) / _GAMMA
            x_eta = count**-_KAPPA
            x_bar = (1 - x_eta) * x_bar + x_eta * x
            e = math.exp(x)
            if windows and it >= _INIT and it < windows[-1]:
                seen.append(q.copy())
            if windows and it + 1 in windows:
                m = len(seen)
                inverse = m / (m + 5) * np.var(np.array(seen), axis=0, ddof=1) + 1e-3 * 5 / (m + 5)
                seen = []
                e = first_step()
                mu, bar, x_bar, count = math.log(10 * e), 0.0, 0.0, 0
            if it == warmup - 1:
                e = math.exp(x_bar)
        else:
            draws.append(q.copy())
            diverged += bad
            depths.append(depth)
    return np.array(draws), {"divergences": int(diverged), "step_size": float(e), "mean_depth": float(np.mean(depths)) if depths else 0.0}


def split_rhat_ess(chains: np.ndarray) -> tuple[float, float, float]:
    """Rank-normalised split R-hat, bulk and tail effective sample size of (chain, draw) values; NaN if constant."""
    from statistics import NormalDist

    half = chains.shape[1] // 2
    if half < 2 or np.ptp(chains) == 0:
        return math.nan, math.nan, math.nan
    split = np.concatenate([chains[:, :half], chains[:, -half:]])

    def normalise(x):
        flat = x.ravel()
        _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
        rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
        inv = NormalDist().inv_cdf
        return np.array([inv((r - 0.375) / (len(flat) + 0.25)) for r in rank]).reshape(x.shape)

    def rhat(x):
        m, n = x.shape
        within = x.var(axis=1, ddof=1).mean()
        between = n * x.mean(axis=1).var(ddof=1)
        return math.sqrt((n - 1) / n + between / n / within) if within > 0 else math.nan

    def ess(x):
        m, n = x.shape
        centred = x - x.mean(axis=1, keepdims=True)
        size = 1 << (2 * n - 1).bit_length()
        spectrum = np.fft.rfft(centred, size)
        auto = np.fft.irfft(spectrum * np.conj(spectrum), size)[:, :n].real / n
        within = (auto[:, 0] * n / (n - 1)).mean()
        plus = within * (n - 1) / n + (x.mean(axis=1).var(ddof=1) if m > 1 else 0)
        if not plus > 0:
            return math.nan
        rho = 1 - (within - auto.mean(axis=0) * n / (n - 1)) / plus
        rho[0] = 1
        total, before, t = -1.0, math.inf, 0
        while t + 1 < n:
            pair = rho[t] + rho[t + 1]
            if pair < 0:
                break
            before = min(before, pair)
            total += 2 * before
            t += 2
        return m * n / max(total, 1 / math.log10(m * n))

    folded = np.abs(split - np.median(split))
    low, high = np.quantile(chains, [0.05, 0.95])
    tail = min(ess((split <= q).astype(float)) for q in (low, high))
    return max(rhat(normalise(split)), rhat(normalise(folded))), ess(normalise(split)), tail
