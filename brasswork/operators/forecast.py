"""Holdout back-tests of weekly series, selection of a model for each horizon, and top-down reconciliation."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brasswork.functions.metrics import forecast_aggregates
from brasswork.functions.numbers import ratio
from brasswork.operators.network import forecast_network
from brasswork.operators.rollup import first_by
from brasswork.operators.trend import fit_trend, forecast_trend

SEASON = 52
HORIZONS = (1, 2, 4)
MAX_PATH = 10_000
LEVELS = {"total": [], "store": ["store_id"], "product": ["product_id"], "category": ["product_category"], "store_product": ["store_id", "product_id"]}


def build_series(panel: DataFrame, level: str = "total", value: str = "units_sold") -> DataFrame:
    """Weekly sums by a level's keys, with `t`, the week's place from 0."""
    keys = LEVELS[level]
    sums = panel.groupBy(*keys, "week_start_date").agg(F.sum(value).cast("double").alias("y"))
    first = panel.agg(F.min("week_start_date").alias("first_"))
    return sums.crossJoin(F.broadcast(first)).withColumn("t", (F.datediff("week_start_date", "first_") / 7).cast("int")).drop("first_")


def seasonal_naive(history: np.ndarray, horizon: int, season: int = SEASON) -> np.ndarray:
    if len(history) < season:
        raise ValueError(f"needs {season} weeks")
    return np.array([history[len(history) - season + i % season] for i in range(horizon)])


def iso_weeks(first: datetime.date, n: int) -> np.ndarray:
    """The ISO week numbers of n weeks from one on."""
    return np.array([(first + datetime.timedelta(weeks=i)).isocalendar().week for i in range(n)])


def _design(y: np.ndarray, n: int, season: int, weeks: np.ndarray | None) -> np.ndarray:
    """Trend, week dummies (the first dropped) and lags 1, 2 and one season for weeks season .. n - 1; unknown lags are 0.

    Dummies are of ISO week numbers, 1 to 53, or without these of places in the season.
    """
    t = np.arange(season, n)
    padded = np.concatenate([y, np.zeros(max(0, n - len(y)))])
    if weeks is None:
        dummies = (t[:, None] % season == np.arange(1, season)[None]).astype(float)
    else:
        dummies = (weeks[t][:, None] == np.arange(2, 54)[None]).astype(float)
    return np.column_stack([t / n, (t / n) ** 2, dummies, padded[t - 1], padded[t - 2], padded[t - season]])


def ridge_seasonal(history: np.ndarray, horizon: int, season: int = SEASON, alpha: float = 1.0, recursive: bool = False, weeks: np.ndarray | None = None) -> np.ndarray:
    """Ridge regression on trend, week of the year and lags. Lags that lie in the future count as 0, or with recursive are what was forecast.

    weeks are the ISO week numbers of the history and the horizon.
    """
    n = len(history)
    if n < season + 20:
        raise ValueError(f"needs {season + 20} weeks")
    x, y = _design(history, n, season, weeks), history[season:]
    mean_x, mean_y = x.mean(0), y.mean()
    beta = np.linalg.solve((x - mean_x).T @ (x - mean_x) + alpha * np.eye(x.shape[1]), (x - mean_x).T @ (y - mean_y))
    known = history
    out = []
    for h in range(1, horizon + 1):
        row = _design(known, n + h, season, weeks)[-1]
        row[0], row[1] = (n + h - 1) / n, ((n + h - 1) / n) ** 2
        value = max(0.0, float((row - mean_x) @ beta + mean_y))
        out.append(value)
        known = np.append(known, value if recursive else 0.0)
    return np.array(out)


def additive_trend(history: np.ndarray, horizon: int, season: int = SEASON) -> np.ndarray:
    """A trend whose slope changes at few places, times a yearly season."""
    return forecast_trend(fit_trend(history, season), horizon)


def recurrent(history: np.ndarray, horizon: int) -> np.ndarray:
    """A small network of gated units, trained on the history."""
    return forecast_network(history, horizon)


def ensemble(history: np.ndarray, horizon: int) -> np.ndarray:
    """Half the seasonal naive, half the additive trend; the weights are fixed beforehand."""
    return 0.5 * seasonal_naive(history, horizon) + 0.5 * additive_trend(history, horizon)


Model = Callable[[np.ndarray, int], np.ndarray]
#: In the order that breaks ties of selection.
MODELS: dict[str, Model] = {"seasonal_naive": seasonal_naive, "ridge_seasonal": ridge_seasonal, "additive_trend": additive_trend, "recurrent": recurrent, "ensemble": ensemble}


def run_model(model: str, history: np.ndarray, horizon: int, first: datetime.date | None) -> np.ndarray:
    """A model's forecast; first is the Monday of the history's first week, if known."""
    if model == "ridge_seasonal" and first is not None:
        return ridge_seasonal(history, horizon, weeks=iso_weeks(first, len(history) + horizon))
    return MODELS[model](history, horizon)


def _start(frame: pd.DataFrame) -> datetime.date | None:
    return frame["week_start_date"].iloc[0] if "week_start_date" in frame else None


def naive_holdout(series: DataFrame, keys: Sequence[str] = (), horizons: Sequence[int] = HORIZONS, season: int = SEASON) -> DataFrame:
    """horizon and metrics of the seasonal naive forecast of each series' last weeks, all in DataFrame functions."""
    window = Window.partitionBy(*keys).orderBy("t")
    ends = Window.partitionBy(*keys).orderBy(F.desc("t"))
    # within the last h <= season weeks the forecast is the value a season before
    tail = series.withColumns({"f": F.lag("y", season).over(window), "from_end": F.row_number().over(ends)})
    per = tail.select("*", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")).where("from_end <= horizon")
    return per.groupBy(*keys, "horizon").agg(*forecast_aggregates())


def simple_holdout(series: DataFrame, keys: Sequence[str] = (), horizons: Sequence[int] = HORIZONS, season: int = SEASON, recent: int = 4) -> DataFrame:
    """keys, model, horizon and metrics of three forecasts that need no fit, of each series' last weeks, in DataFrame functions.

    seasonal_naive repeats the season, last_value the last week before the holdout, recent_mean the mean of the `recent` weeks
    before it. Weeks of a series must follow each other.
    """
    ends = Window.partitionBy(*keys).orderBy(F.desc("t"))
    per = series.withColumn("from_end", F.row_number().over(ends)).select("*", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    whole = Window.partitionBy(*keys, "horizon")
    place = F.col("from_end") - F.col("horizon")  # 1 is the last week before the holdout
    ordered = whole.orderBy("t")
    told = per.select(
        *keys, "horizon", "y", place.alias("place"), F.lag("y", season).over(ordered).alias("seasonal_naive"),
        F.max(F.when(place == 1, F.col("y"))).over(whole).alias("last_value"), F.avg(F.when((place >= 1) & (place <= recent), F.col("y"))).over(whole).alias("recent_mean"),
    ).where("place <= 0")
    each = told.select(*keys, "horizon", "y", F.expr("stack(3, 'seasonal_naive', seasonal_naive, 'last_value', last_value, 'recent_mean', recent_mean) as (model, f)"))
    return each.groupBy(*keys, "model", "horizon").agg(*forecast_aggregates())


def ranking_inversions(scores: DataFrame, keys: Sequence[str] = (), metric: str = "wape") -> DataFrame:
    """keys, short, long, better_short, better_long, gap_short, gap_long: models of which one is better at a short horizon and the other at a longer one.

    gaps tell by how much the better one is better. Models without a score at a horizon, and equal scores, make no
    inversion. Models and horizons of a series are few, and meet each other by the series' keys alone.
    """
    own = scores.where(F.col(metric).isNotNull()).select(*keys, "model", "horizon", F.col(metric).alias("score"))
    listed = own.groupBy(*keys).agg(F.collect_list(F.struct("model", "horizon", "score")).alias("all_"))
    first = listed.select("*", F.inline("all_")).withColumnsRenamed({"model": "a_model", "horizon": "a_horizon", "score": "a_score"})
    pairs = first.select("*", F.inline("all_")).where((F.col("a_horizon") == F.col("horizon")) & (F.col("a_score") < F.col("score")))
    pairs = pairs.select(*keys, F.col("horizon"), F.col("a_model").alias("better"), F.col("model").alias("worse"), (F.col("score") - F.col("a_score")).alias("gap"))
    short, long = (pairs.select(*[F.col(k).alias(f"{k}_{side}") if side == "long" else k for k in keys], F.col("horizon").alias(side), F.col("better").alias(f"better_{side}"), F.col("worse").alias(f"worse_{side}"), F.col("gap").alias(f"gap_{side}")) for side in ("short", "long"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_long"))
    turned = same & (F.col("better_short") == F.col("worse_long")) & (F.col("worse_short") == F.col("better_long")) & (F.col("short") < F.col("long"))
    return short.join(long, turned).select(*keys, "short", "long", "better_short", "better_long", F.round("gap_short", 6).alias("gap_short"), F.round("gap_long", 6).alias("gap_long"))


def rankings_agree(scores: DataFrame, keys: Sequence[str] = (), metric: str = "wape") -> DataFrame:
    """keys, inversions, inverted: how many there are for each series, series without one included."""
    counted = ranking_inversions(scores, keys, metric).groupBy(*keys).agg(F.count("*").alias("n"))
    none = scores.groupBy(*keys).agg(F.lit(0).cast("long").alias("n"))
    return none.unionByName(counted).groupBy(*keys).agg(F.sum("n").alias("inversions")).withColumn("inverted", F.col("inversions") > 0)


def backtest(series: DataFrame, keys: Sequence[str] = (), horizons: Sequence[int] = HORIZONS, models: Sequence[str] = tuple(MODELS), least: int = 60) -> DataFrame:
    """keys, model, horizon, metrics and error: each model forecasts each series' last weeks. A model that fails gives its error's text and nulls.

    Series, models and horizons are one grouped map, so fits run side by side.
    """
    kinds = dict(series.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "model string, horizon int, step int, y double, f double, error string"])

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        y, model, horizon = frame["y"].to_numpy(float), frame["model"].iloc[0], int(frame["horizon"].iloc[0])
        head = {k: frame[k].iloc[0] for k in keys}
        try:
            if len(y) <= least + horizon:
                raise ValueError(f"needs more than {least + horizon} weeks")
            forecast, error = run_model(model, y[:-horizon], horizon, _start(frame)), None
        except Exception as e:  # one model's failure is a row, not the end of the run
            return pd.DataFrame([{**head, "model": model, "horizon": horizon, "step": 0, "y": None, "f": None, "error": str(e)}])
        return pd.DataFrame([{**head, "model": model, "horizon": horizon, "step": i + 1, "y": y[len(y) - horizon + i], "f": float(forecast[i]), "error": error} for i in range(horizon)])

    tasks = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(h).alias("horizon")) for m in models for h in horizons]))
    days = [c for c in series.columns if c == "week_start_date"]
    spread = series.select(*keys, "t", "y", *days, tasks.alias("task")).select(*keys, "t", "y", *days, "task.model", "task.horizon")
    steps = spread.groupBy(*keys, "model", "horizon").applyInPandas(fit, schema)
    return steps.groupBy(*keys, "model", "horizon").agg(*forecast_aggregates(), F.max("error").alias("error"))


def select_models(scores: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = tuple(MODELS)) -> DataFrame:
    """The model of least wape for each horizon; rows without one are out of the running, ties go by a fixed order."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    return first_by(scores.where("wape is not null"), [*keys, "horizon"], [F.asc("wape"), place]).select(*keys, "horizon", "model", "wape")


def forecast_paths(series: DataFrame, selected: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, horizon, model, weeks_ahead, forecast: the selected models fitted to every week."""
    kinds = dict(series.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "horizon int, model string, holdout_wape double, weeks_ahead int, forecast double"])
    # without keys there is one row for each horizon; with keys their number grows with the series
    joined = series.join(selected, list(keys)) if keys else series.crossJoin(F.broadcast(selected))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        first = frame.iloc[0]
        path = run_model(first["model"], frame["y"].to_numpy(float), int(first["horizon"]), _start(frame))
        head = {k: first[k] for k in keys}
        return pd.DataFrame([{**head, "horizon": int(first["horizon"]), "model": first["model"], "holdout_wape": first["wape"], "weeks_ahead": i + 1, "forecast": float(v)} for i, v in enumerate(path)])

    return joined.groupBy(*keys, "horizon", "model").applyInPandas(run, schema)


def series_weights(panel: DataFrame, level: str, value: str = "units_sold") -> DataFrame:
    """Each series' share of all history; the total level is one row of share 1."""
    keys = LEVELS[level]
    sums = panel.groupBy(*keys).agg(F.sum(value).cast("double").alias("units"))
    whole = panel.agg(F.sum(value).cast("double").alias("whole"))
    return sums.crossJoin(F.broadcast(whole)).select(*keys, "units", ratio(F.col("units"), F.col("whole")).alias("share"))


def reconcile_down(path: DataFrame, weights: DataFrame, value: str = "forecast") -> DataFrame:
    """Each forecast of the whole, shared out by weights; the parts add up to it. Raises ValueError for a path of over MAX_PATH rows, since it is broadcast."""
    if path.limit(MAX_PATH + 1).count() > MAX_PATH:
        raise ValueError(f"a path of the whole has at most {MAX_PATH} rows")
    return weights.crossJoin(F.broadcast(path)).withColumn("part", F.col(value) * F.col("share"))
