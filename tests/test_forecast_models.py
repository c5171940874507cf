"""The changepoint trend, the trained network and the ranking of models across horizons."""

import itertools

import numpy as np
import pytest

from brasswork.operators import forecast as P
from brasswork.operators import network as N
from brasswork.operators import trend as T


def weeks(base, noise=0.01, seed=0, season=0.2):
    t = np.arange(len(base))
    return base * (1 + season * np.sin(2 * np.pi * t / 52)) * (1 + noise * np.random.default_rng(seed).normal(size=len(base)))


def parts(fit, y):
    trend, waves = T._design(np.arange(fit.weeks), fit.weeks, fit.knots, fit.season)
    return y / fit.scale, trend, waves


BENT = np.where(np.arange(290) < 140, 100 + 0.1 * np.arange(290), 114 + 0.9 * (np.arange(290) - 140.0))


@pytest.mark.parametrize("base", [100 + 0.2 * np.arange(290.0), BENT, np.full(120, 40.0)])
def test_the_fit_is_a_mode(base):
    y = weeks(base)
    fit = T.fit_trend(y)
    value, gradient, _ = T.objective(fit.params, *parts(fit, y))
    assert np.abs(T.pseudo_gradient(fit.params, gradient, fit.penalty)).max() < 1e-4
    total = lambda p: T.objective(p, *parts(fit, y))[0] + fit.penalty @ np.abs(p)
    for k, step in itertools.product(range(len(fit.params)), (1e-3, -1e-3)):
        other = fit.params.copy()
        other[k] += step
        assert total(other) >= total(fit.params) - 1e-9


def test_gradient_of_the_objective():
    r = np.random.default_rng(2)
    trend, waves = T._design(np.arange(90), 90, np.array([0.3, 0.6]), 52)
    p, y = np.concatenate([r.normal(size=4), 0.1 * r.normal(size=waves.shape[1]), [-1.0]]), r.normal(size=90)
    gradient = T.objective(p, y, trend, waves)[1]
    for k in range(len(p)):
        up, down = p.copy(), p.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert gradient[k] == pytest.approx((T.objective(up, y, trend, waves)[0] - T.objective(down, y, trend, waves)[0]) / 2e-6, rel=1e-4, abs=1e-4)


def test_penalised_step_is_the_minimum():
    r = np.random.default_rng(3)
    for _ in range(30):
        a = r.normal(size=(9, 7))
        curve, g, x = a.T @ a + 0.1 * np.eye(7), 3 * r.normal(size=7), r.normal(size=7) * (r.random(7) < 0.5)
        penalty = np.where(np.arange(7) < 2, 0.0, 2.0)
        z = T.penalised_step(x, g, curve, penalty)
        assert np.abs(T.pseudo_gradient(z, g + curve @ (z - x), penalty)).max() < 1e-7


def test_changepoints_are_found_and_few():
    fit = T.fit_trend(weeks(BENT))
    place = fit.knots[np.abs(fit.changes).argmax()] * 289
    assert abs(place - 140) < 12 and np.abs(fit.changes).max() > 0.6 * np.abs(fit.changes).sum()
    straight = T.fit_trend(weeks(100 + 0.2 * np.arange(290.0)))
    assert np.abs(straight.changes).sum() < 0.05 and (straight.changes == 0).sum() > 15


def test_trend_forecasts():
    t = np.arange(294)
    y = weeks(np.append(BENT, BENT[-1] + 0.9 * np.arange(1, 5)), noise=0.005)
    assert np.abs(T.forecast_trend(T.fit_trend(y[:290]), 4) / y[290:] - 1).max() < 0.03
    falling = np.maximum(200 - 1.2 * t, 0.0)
    assert (T.forecast_trend(T.fit_trend(falling), 6) >= 0).all()
    assert T.forecast_trend(T.fit_trend(np.zeros(80)), 2).tolist() == pytest.approx([0, 0], abs=1e-6)
    for bad in (y[:40], np.append(y, np.nan)):
        with pytest.raises(ValueError):
            T.fit_trend(bad)


def test_network_gradients():
    r = np.random.default_rng(1)
    w = N.start_weights(6, r)
    x, y, keep = r.normal(size=(5, 9)), r.normal(size=5), (r.random((5, 6)) > 0.2) / 0.8
    loss, gradient = N.gradients(w, x, y, keep)
    assert loss == pytest.approx(np.mean((N.forward(w, x, keep)[0] - y) ** 2))
    for name, table in w.items():
        for k in range(0, table.size, max(1, table.size // 7)):
            value = table.flat[k]
            sides = []
            for step in (1e-6, -1e-6):
                table.flat[k] = value + step
                sides.append(np.mean((N.forward(w, x, keep)[0] - y) ** 2))
            table.flat[k] = value
            assert gradient[name].flat[k] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=1e-7)


def test_network_learns_a_lag():
    r = np.random.default_rng(5)
    z = np.zeros(260)
    for t in range(260):
        z[t] = 0.95 * (z[t - 5] if t >= 5 else r.normal()) + 0.1 * r.normal()
    w = N.train(z[:220], lookback=12, units=12, epochs=30)
    x = np.lib.stride_tricks.sliding_window_view(z, 12)[:-1][-40:]
    found, y = N.forward(w, x)[0], z[-40:]
    assert np.mean((found - y) ** 2) < 0.35 * np.mean((x[:, -1] - y) ** 2)


def test_network_forecasts():
    y = 100 + 20 * np.sin(2 * np.pi * np.arange(120) / 13)
    first, again = (N.forecast_network(y[:116], 4, lookback=26, units=12, epochs=25) for _ in range(2))
    assert np.array_equal(first, again) and np.abs(first - y[116:]).max() < 15
    with pytest.raises(ValueError):
        N.forecast_network(y[:60], 1)


def test_simple_forecasts_and_inversions(spark):
    r = np.random.default_rng(9)
    data = {k: r.integers(1, 90, 70).astype(float) for k in ("x", "y", None)}
    series = spark.createDataFrame([(k, t, v) for k, ys in data.items() for t, v in enumerate(ys.tolist())], "k string, t int, y double")
    scores = P.simple_holdout(series, ["k"], season=13)
    got = {(s["k"], s["model"], s["horizon"]): s["wape"] for s in scores.collect()}
    for k, ys in data.items():
        for h in (1, 2, 4):
            told = {"seasonal_naive": ys[-h - 13 : -13], "last_value": np.full(h, ys[-h - 1]), "recent_mean": np.full(h, ys[-h - 4 : -h].mean())}
            for m, f in told.items():
                assert got[k, m, h] == pytest.approx(np.abs(ys[-h:] - f).sum() / ys[-h:].sum(), abs=1e-6)
    want = {
        (k, a, b, m, n) for k in data for a, b in ((1, 2), (1, 4), (2, 4)) for m, n in itertools.permutations(("seasonal_naive", "last_value", "recent_mean"), 2)
        if got[k, m, a] < got[k, n, a] and got[k, n, b] < got[k, m, b]
    }
    rows = P.ranking_inversions(scores, ["k"]).collect()
    assert {(x["k"], x["short"], x["long"], x["better_short"], x["better_long"]) for x in rows} == want and len(rows) == len(want) > 0
    counts = {x["k"]: (x["inversions"], x["inverted"]) for x in P.rankings_agree(scores, ["k"]).collect()}
    assert counts == {k: (n := sum(w[0] == k for w in want), n > 0) for k in data}
    one = P.rankings_agree(scores.where("k = 'x'")).first()
    assert one["inversions"] == counts["x"][0]
    flat = spark.createDataFrame([("a", 1, 0.1), ("b", 1, 0.2), ("a", 2, 0.1), ("b", 2, 0.2), ("c", 1, None)], "model string, horizon int, wape double")
    assert P.ranking_inversions(flat).count() == 0 and not P.rankings_agree(flat).first()["inverted"]
