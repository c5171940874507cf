"""A trend with sparse changes of slope times a yearly season, fitted to its posterior mode.

y / max|y| is normal around g(t) (1 + s(t)): g is linear between changepoints, with a Laplace prior on changes of slope, so
that most are exactly 0; s is a Fourier sum. The mode is found by steps to the minimum of a quadratic model with the same
absolute-value penalty, whose second derivatives come from the first ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CHANGEPOINTS, CHANGE_RANGE, CHANGE_SCALE = 25, 0.8, 0.05
HARMONICS, SEASON_SCALE = 10, 10.0
OFFSET_SCALE, NOISE_SCALE = 5.0, 0.5
MOST_STEPS, SLACK = 300, 1e-8


@dataclass
class TrendFit:
    """params: offset, slope, changes of slope, season, log of the noise; penalty is that of the absolute values of some."""

    params: np.ndarray
    penalty: np.ndarray
    knots: np.ndarray
    scale: float
    weeks: int
    season: int

    @property
    def changes(self) -> np.ndarray:
        return self.params[2 : 2 + len(self.knots)]


def _design(t: np.ndarray, weeks: int, knots: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the trend (offset, slope, a bend at each knot), with time from 0 to 1 over the history, and of the season."""
    at = t / max(weeks - 1, 1)
    trend = np.column_stack([np.ones(len(t)), at, np.maximum(at[:, None] - knots[None], 0)])
    waves = np.column_stack([f(2 * np.pi * k * t / season) for k in range(1, min(HARMONICS, (season - 1) // 2) + 1) for f in (np.sin, np.cos)])
    return trend, waves


def objective(params: np.ndarray, y: np.ndarray, trend: np.ndarray, waves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The smooth part of the negative log posterior, its gradient, and the second derivatives that squares of first ones give.

    The last parameter, the noise's logarithm, has a curvature of its own alone; see best_noise.
    """
    n, k = len(y), trend.shape[1]
    theta, beta, log_noise = params[:k], params[k:-1], params[-1]
    noise = np.exp(log_noise)
    level, season = trend @ theta, 1 + waves @ beta
    r = level * season - y
    squares = float(r @ r) / noise**2
    value = n * log_noise + squares / 2 + (theta[:2] @ theta[:2]) / (2 * OFFSET_SCALE**2) + (beta @ beta) / (2 * SEASON_SCALE**2) + noise**2 / (2 * NOISE_SCALE**2)
    slopes = np.column_stack([trend * season[:, None], waves * level[:, None], np.zeros(n)])
    gradient = slopes.T @ r / noise**2
    curve = slopes.T @ slopes / noise**2
    prior = np.concatenate([[OFFSET_SCALE**-2] * 2, np.zeros(k - 2), [SEASON_SCALE**-2] * len(beta), [0.0]])
    gradient += prior * params
    gradient[-1] = n - squares + noise**2 / NOISE_SCALE**2
    curve += np.diag(prior + 1e-9)
    curve[-1, -1] = 2 * squares + 2 * noise**2 / NOISE_SCALE**2
    return value, gradient, curve


def best_noise(params: np.ndarray, y: np.ndarray, trend: np.ndarray, waves: np.ndarray) -> np.ndarray:
    """params with the logarithm of the noise that is best for the others."""
    k, v = trend.shape[1], NOISE_SCALE**2
    r = (trend @ params[:k]) * (1 + waves @ params[k:-1]) - y
    squares = max(float(r @ r), 1e-12)
    variance = v / 2 * (np.sqrt(len(y) ** 2 + 4 * squares / v) - len(y))
    return np.append(params[:-1], np.log(variance) / 2)


def pseudo_gradient(x: np.ndarray, gradient: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """The gradient with the penalty's slope; where a penalised value is 0, what is left of it beyond the penalty."""
    at_zero = np.sign(gradient) * np.maximum(np.abs(gradient) - penalty, 0)
    return np.where((x == 0) & (penalty > 0), at_zero, gradient + penalty * np.sign(x))


def penalised_step(x: np.ndarray, gradient: np.ndarray, curve: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """The minimum z of gradient (z - x) + (z - x) curve (z - x) / 2 + penalty |z|, by a set of values that aren't 0.

    A value that would change its sign leaves the set; when none does, the one whose slope exceeds the penalty most enters.
    """
    c = gradient - curve @ x
    z, sign = x.copy(), np.sign(x)
    active = (penalty == 0) | (z != 0)
    for _ in range(20 * len(x)):
        at = np.flatnonzero(active)
        target = np.zeros(len(x))
        target[at] = np.linalg.solve(curve[np.ix_(at, at)], -(c + penalty * sign)[at])
        over = active & (penalty > 0) & (sign * target < 0)
        if over.any():
            reach = np.where(over, np.abs(z) / np.maximum(np.abs(z - target), 1e-300), np.inf)
            gone = int(reach.argmin())
            z += reach[gone] * (target - z)
            z[gone], active[gone], sign[gone] = 0.0, False, 0.0
            continue
        z = target
        beyond = np.where(active, -np.inf, np.abs(curve @ z + c) - penalty)
        new = int(beyond.argmax())
        if beyond[new] <= 1e-9 * (1 + penalty[new]):
            break
        active[new], sign[new] = True, -np.sign((curve @ z + c)[new])
    return z


def minimise(function, x: np.ndarray, penalty: np.ndarray, renew=lambda x: x, most: int = MOST_STEPS, slack: float = SLACK) -> np.ndarray:
    """A minimum of function(x)[0] + penalty |x|; function also gives the gradient and about the second derivatives.

    Each step goes towards the minimum of the penalised quadratic model, as far as the objective falls; renew may better x
    between steps.
    """
    for _ in range(most):
        x = renew(x)
        value, gradient, curve = function(x)
        if np.abs(pseudo_gradient(x, gradient, penalty)).max() <= slack * max(1.0, abs(value)):
            break
        total = value + penalty @ np.abs(x)
        move = penalised_step(x, gradient, curve, penalty) - x
        falls = gradient @ move + penalty @ (np.abs(x + move) - np.abs(x))
        rate = 1.0
        while rate > 1e-12 and not function(x + rate * move)[0] + penalty @ np.abs(x + rate * move) <= total + 1e-4 * rate * falls:
            rate /= 2
        if rate <= 1e-12:
            break
        x = x + rate * move
    return x


def fit_trend(history: np.ndarray, season: int = 52, changepoints: int = CHANGEPOINTS) -> TrendFit:
    """Raises ValueError for less than a season and eight weeks, or weeks that aren't finite."""
    n = len(history)
    if n < season + 8 or not np.isfinite(history).all():
        raise ValueError(f"needs {season + 8} finite weeks")
    scale = float(np.abs(history).max()) or 1.0
    y = history / scale
    last = int(CHANGE_RANGE * n)
    knots = np.unique(np.linspace(0, last - 1, min(changepoints, last - 1) + 1).round().astype(int))[1:] / (n - 1)
    trend, waves = _design(np.arange(n), n, knots, season)
    start = np.zeros(trend.shape[1] + waves.shape[1] + 1)
    start[0], start[1], start[-1] = y[0], y[-1] - y[0], np.log(max(y.std(), 1e-3))
    penalty = np.zeros(len(start))
    penalty[2 : 2 + len(knots)] = 1 / CHANGE_SCALE
    params = minimise(lambda p: objective(p, y, trend, waves), start, penalty, lambda p: best_noise(p, y, trend, waves))
    return TrendFit(params, penalty, knots, scale, n, season)


def forecast_trend(fit: TrendFit, horizon: int) -> np.ndarray:
    """The weeks after the history, at the last slope; never below 0."""
    trend, waves = _design(np.arange(fit.weeks, fit.weeks + horizon), fit.weeks, fit.knots, fit.season)
    k = trend.shape[1]
    return np.maximum((trend @ fit.params[:k]) * (1 + waves @ fit.params[k:-1]) * fit.scale, 0)
