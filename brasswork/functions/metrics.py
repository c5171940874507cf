"""Forecast and ranking metrics. What is undefined is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasswork.functions.numbers import ratio
from brasswork.operators.ranges import running
from brasswork.session import cut


def forecast_aggregates(actual: str = "y", forecast: str = "f") -> list[Column]:
    """Aggregates for one groupBy or agg: wape, mape_nonzero, smape, mae, rmse, bias (actual less forecast), n, n_nonzero."""
    y, f = F.col(actual).cast("double"), F.col(forecast).cast("double")
    error, both = F.abs(y - f), F.abs(y) + F.abs(f)
    part = lambda c, when: ratio(F.sum(F.when(when, c)), F.sum(F.when(when, 1)))
    nonzero = F.sum(F.when(y != 0, 1).otherwise(0))
    return [
        F.round(ratio(F.sum(error), F.sum(F.abs(y))), 6).alias("wape"), F.round(part(error / F.nullif(y, F.lit(0.0)), y > 0), 6).alias("mape_nonzero"), F.round(part(2 * error / F.nullif(both, F.lit(0.0)), both > 0), 6).alias("smape"),
        F.round(F.avg(error), 6).alias("mae"), F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"), F.round(F.avg(y - f), 6).alias("bias"),
        F.count(F.lit(1)).alias("n"), nonzero.cast("long").alias("n_nonzero"),
    ]


def check_pairs(frame: DataFrame, actual: str = "y", forecast: str = "f") -> None:
    """Raises ValueError for an empty frame and for values that are null or not finite."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    row = frame.agg(F.count("*").alias("n"), F.sum(F.when(bad(actual) | bad(forecast), 1).otherwise(0)).alias("bad")).first()
    if not row["n"] or row["bad"]:
        raise ValueError(f"{row['n']} rows, {row['bad'] or 0} of them without finite values")


def seasonal_scale(frame: DataFrame, order: str, value: str, season: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and scale: the mean absolute difference from one season before, by series; null if it is 0 or a series is too short."""
    window = Window.partitionBy(*keys).orderBy(order)
    step = F.abs(F.col(value).cast("double") - F.lag(F.col(value).cast("double"), season).over(window))
    return frame.select(*keys, step.alias("step")).groupBy(*keys).agg(F.nullif(F.avg("step"), F.lit(0.0)).alias("scale"))


def mase(pairs: DataFrame, scales: DataFrame, keys: tuple[str, ...] = (), actual: str = "y", forecast: str = "f") -> DataFrame:
    """keys and mase: the mean absolute error of each series' forecasts over its seasonal scale; null where that is undefined.

    scales is what seasonal_scale gives for the training weeks. A forecast that repeats the season over the very weeks
    that the scale is taken from has 1.
    """
    error = pairs.groupBy(*keys).agg(F.avg(F.abs(F.col(actual).cast("double") - F.col(forecast).cast("double"))).alias("mae_"))
    joined = error.join(scales, list(keys), "left") if keys else error.crossJoin(F.broadcast(scales))
    return joined.select(*keys, F.round(ratio(F.col("mae_"), F.col("scale")), 6).alias("mase"))


def forecast_bundle(pairs: DataFrame, scales: DataFrame, keys: tuple[str, ...] = (), actual: str = "y", forecast: str = "f") -> DataFrame:
    """keys with all forecast metrics, the share of weeks that aren't 0, and mase."""
    whole = pairs.groupBy(*keys).agg(*forecast_aggregates(actual, forecast))
    whole = whole.withColumn("nonzero_share", F.round(ratio(F.col("n_nonzero").cast("double"), F.col("n")), 6))
    scaled = mase(pairs, scales, keys, actual, forecast)
    return whole.join(scaled, list(keys)) if keys else whole.crossJoin(F.broadcast(scaled))


def ranking_metrics(scored: DataFrame, score: str, label: str, tie: str, k: float = 0.2) -> DataFrame:
    """One row: rows, positives, n_top, precision, recall and lift among the rows of highest score.

    n_top is max(1, half-even round of k times rows), ties go by `tie`, null scores come last. As n_top grows with the
    rows, they are ranked in two levels.
    """
    rows = cut(scored.select(F.col(score).cast("double").alias("score"), F.col(label).alias("label"), F.col(tie).alias("tie")))
    ranked, totals = running(rows, [F.col("score").isNull(), -F.col("score"), F.col("tie")])
    inside = F.col("rank") <= max(1, round(k * totals["rank"]))
    out = ranked.agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.count(F.when(inside, 1)).alias("n_top"), F.sum(F.when(inside, F.col("label"))).alias("hits"))
    precision = ratio(F.col("hits").cast("double"), F.col("n_top"))
    base = ratio(F.col("positives").cast("double"), F.col("n"))
    return out.select("n", F.col("positives").cast("long").alias("positives"), "n_top", precision.alias("precision_at_k"), ratio(F.col("hits").cast("double"), F.col("positives")).alias("recall_at_k"), ratio(precision, base).alias("lift_at_k"))


def curve_metrics(scored: DataFrame, score: str, label: str) -> DataFrame:
    """roc_auc (average ranks) and average precision (step sum over distinct scores), from counts by distinct score.

    A real model has about as many scores as rows, so running counts are taken in two levels.
    """
    by_score = cut(scored.groupBy(F.col(score).cast("double").alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p")))
    run, totals = running(by_score, [-F.col("score")], {"n_upto": "n", "p_upto": "p"})
    positives, negatives = F.lit(totals["p_upto"]), F.lit(totals["n_upto"] - totals["p_upto"])
    # a positive beats all negatives below it and half of those level with it
    below = (negatives - (F.col("n_upto") - F.col("p_upto"))) + (F.col("n") - F.col("p")) / F.lit(2.0)
    # the number of pairs is far beyond the counts' own type
    pairs = F.lit(float(totals["p_upto"] * (totals["n_upto"] - totals["p_upto"])))
    auc = ratio(F.sum(F.col("p") * below), pairs)
    precision = F.sum(F.col("p") / F.nullif(positives, F.lit(0)) * F.col("p_upto") / F.col("n_upto"))
    return run.agg(F.round(auc, 8).alias("roc_auc"), F.round(precision, 8).alias("average_precision"))


def confusion(scored: DataFrame, score: str, label: str, cutoff: float) -> DataFrame:
    """tp, fp, fn, tn, f1 where a score of the cutoff or more is positive."""
    hit, positive = F.col(score) >= cutoff, F.col(label) == 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = scored.agg(n(hit & positive).alias("tp"), n(hit & ~positive).alias("fp"), n(~hit & positive).alias("fn"), n(~hit & ~positive).alias("tn"))
    return out.withColumn("f1", ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
