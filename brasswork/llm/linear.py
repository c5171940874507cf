"""Linear classifiers on sparse rows, small enough to fit on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np

Row = tuple[np.ndarray, np.ndarray]  # places and values of what isn't zero


def fit_hinge(rows: list[Row], signs: np.ndarray, width: int, cost: float = 1.0, epochs: int = 20, seed: int = 7, bias: float = 1.0, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept of a hinge-loss machine, by dual coordinate descent.

    Each step solves the dual for one row's multiplier, kept between 0 and its class's cost; classes weigh the same.
    Stops when no step of an epoch moves a multiplier by more than tolerance times its cost.
    """
    weights, intercept = np.zeros(width), 0.0
    share = {s: max(1, int((signs == s).sum())) for s in (-1, 1)}
    costs = np.array([cost * len(signs) / (2 * share[int(s)]) for s in signs])
    norms = np.array([float(v @ v) + bias * bias for _, v in rows])
    alpha = np.zeros(len(rows))
    order = np.arange(len(rows))
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        random.shuffle(order)
        moved = 0.0
        for i in order.tolist():
            places, values = rows[i]
            y = signs[i]
            slope = y * (weights[places] @ values + intercept * bias) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), costs[i])
            step = new - alpha[i]
            if step:
                weights[places] += step * y * values
                intercept += step * y * bias
                alpha[i] = new
                moved = max(moved, abs(step) / costs[i])
        if moved < tolerance:
            break
    return weights, intercept * bias


def margin(row: Row, weights: np.ndarray, intercept: float) -> float:
    return float(weights[row[0]] @ row[1]) + intercept


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit_logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, steps: int = 30, positive: bool = False) -> np.ndarray:
    """Coefficients, the intercept last, of a logistic regression with a ridge, by Newton's method.

    With positive, the feature of the most negative coefficient is put at 0 and the rest fitted again, until none is left.
    """
    free = list(range(features.shape[1]))
    while True:
        x = np.column_stack([features[:, free], np.ones(len(features))])
        coefficients = np.zeros(x.shape[1])
        penalty = ridge * np.eye(x.shape[1])
        penalty[-1, -1] = 1e-6
        for _ in range(steps):
            p = sigmoid(x @ coefficients)
            gradient = x.T @ (p - labels) + penalty @ coefficients
            hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
            step = np.linalg.solve(hessian, gradient)
            coefficients -= step
            if np.abs(step).max() < 1e-8:
                break
        worst = int(np.argmin(coefficients[:-1])) if free else -1
        if not positive or worst < 0 or coefficients[worst] >= 0:
            break
        del free[worst]
    whole = np.zeros(features.shape[1] + 1)
    whole[[*free, features.shape[1]]] = coefficients
    return whole
