"""A small recurrent network with gates, trained by back-propagation through time, for single weekly series.

One layer of long short-term memory over a window of weeks, dropout, a rectified layer and a linear output. Steps adapt
to the first and second moments of the gradients. All is seeded, so a series always gives the same forecast.
"""

from __future__ import annotations

import numpy as np

UNITS, LOOKBACK, EPOCHS, BATCH = 32, 52, 40, 8
DROPOUT, RATE, HELD_OUT = 0.2, 0.01, 0.15

Weights = dict[str, np.ndarray]


def start_weights(units: int, random: np.random.Generator) -> Weights:
    """Uniform entries scaled by both sides' widths, an orthogonal recurrent part, and gates that forget little at first."""
    uniform = lambda rows, columns: random.uniform(-1, 1, (rows, columns)) * np.sqrt(6 / (rows + columns))
    square = np.linalg.qr(random.normal(size=(4 * units, units)))[0].T
    bias = np.zeros(4 * units)
    bias[units : 2 * units] = 1
    half = max(1, units // 2)
    return {"entry": uniform(1, 4 * units), "inner": square, "gate": bias, "hidden": uniform(units, half), "hidden_bias": np.zeros(half), "out": uniform(half, 1), "out_bias": np.zeros(1)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def forward(w: Weights, x: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
    """Outputs for windows x (rows by weeks), and what the way back needs. keep scales the layer's outputs (dropout)."""
    n, units = len(x), w["inner"].shape[0]
    h, c, past = np.zeros((n, units)), np.zeros((n, units)), []
    for t in range(x.shape[1]):
        z = x[:, t, None] @ w["entry"] + h @ w["inner"] + w["gate"]
        gates = _sigmoid(z)  # in, forget, and out; the third quarter is the new content
        content = np.tanh(z[:, 2 * units : 3 * units])
        before, last = c, h
        c = gates[:, units : 2 * units] * before + gates[:, :units] * content
        squashed = np.tanh(c)
        h = gates[:, 3 * units :] * squashed
        past.append((gates, content, before, squashed, last))
    top = h if keep is None else h * keep
    hidden = np.maximum(top @ w["hidden"] + w["hidden_bias"], 0)
    return (hidden @ w["out"] + w["out_bias"])[:, 0], (past, top, hidden)


def gradients(w: Weights, x: np.ndarray, y: np.ndarray, keep: np.ndarray | None = None) -> tuple[float, Weights]:
    """The mean squared error and its gradient in all weights."""
    found, (past, top, hidden) = forward(w, x, keep)
    units = w["inner"].shape[0]
    slope = 2 * (found - y)[:, None] / len(y)
    below = (slope @ w["out"].T) * (hidden > 0)
    out = {"out": hidden.T @ slope, "out_bias": slope.sum(0), "hidden": top.T @ below, "hidden_bias": below.sum(0)}
    out |= {name: np.zeros_like(w[name]) for name in ("entry", "inner", "gate")}
    dh = below @ w["hidden"].T
    dh = dh if keep is None else dh * keep
    dc = np.zeros_like(dh)
    dz = np.empty((len(y), 4 * units))
    for t in range(x.shape[1] - 1, -1, -1):
        gates, content, before, squashed, last = past[t]
        enter, forget, leave = gates[:, :units], gates[:, units : 2 * units], gates[:, 3 * units :]
        dc = dc + dh * leave * (1 - squashed * squashed)
        dz[:, :units] = dc * content * enter * (1 - enter)
        dz[:, units : 2 * units] = dc * before * forget * (1 - forget)
        dz[:, 2 * units : 3 * units] = dc * enter * (1 - content * content)
        dz[:, 3 * units :] = dh * squashed * leave * (1 - leave)
        out["entry"] += x[:, t, None].T @ dz
        out["inner"] += last.T @ dz
        out["gate"] += dz.sum(0)
        dh, dc = dz @ w["inner"].T, dc * forget
    return float(np.mean((found - y) ** 2)), out


def train(z: np.ndarray, lookback: int = LOOKBACK, units: int = UNITS, epochs: int = EPOCHS, seed: int = 11) -> Weights:
    """Weights fitted to predict each week of a standardised series from the lookback weeks before it; the last HELD_OUT share of windows is left out."""
    random = np.random.default_rng(seed)
    x = np.lib.stride_tricks.sliding_window_view(z, lookback)[:-1]
    y = z[lookback:]
    used = max(1, int(len(y) * (1 - HELD_OUT)))
    w = start_weights(units, random)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(epochs):
        for at in range(0, used, BATCH):
            rows = slice(at, min(at + BATCH, used))
            keep = (random.random((rows.stop - rows.start, units)) >= DROPOUT) / (1 - DROPOUT)
            _, g = gradients(w, x[rows], y[rows], keep)
            step += 1
            for k in w:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                w[k] = w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
    return w


def forecast_network(history: np.ndarray, horizon: int, lookback: int = LOOKBACK, units: int = UNITS, epochs: int = EPOCHS, seed: int = 11) -> np.ndarray:
    """A network trained on the history, run on with its own forecasts; never below 0. Raises ValueError for less than lookback + 20 weeks."""
    if len(history) < lookback + 20:
        raise ValueError(f"needs {lookback + 20} weeks")
    mean, deviation = history.mean(), history.std() or 1.0
    known = list((history - mean) / deviation)
    w = train(np.array(known), lookback, units, epochs, seed)
    for _ in range(horizon):
        known.append(float(forward(w, np.array(known[-lookback:])[None])[0][0]))
    return np.maximum(np.array(known[len(history) :]) * deviation + mean, 0)
