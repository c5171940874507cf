"""Newsvendor reorder plans and their walk-forward replay."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasswork.functions.numbers import normal_quantile, poisson_quantile, poisson_quantiles, ratio
from brasswork.operators.windows import last_rows

#: Margin and cost shares of the price, and yearly holding cost as a share of the cost.
MARGIN, COST, HOLDING = 0.40, 0.60, 0.25
PAIR = ["store_id", "product_id"]


def critical_ratio(price: float, weeks: float = 1.0) -> float:
    """Lost margin over lost margin and holding cost for the lead time. Raises ValueError unless both are positive."""
    margin, holding = price * MARGIN, price * COST * HOLDING * weeks / 52
    if margin <= 0 or holding <= 0:
        raise ValueError("price and weeks must be positive")
    return margin / (margin + holding)


def normal_reorder(mean: Column, deviation: Column, on_hand: Column, weeks: float, z: float) -> Column:
    """struct of point, order and reorder: stock for the lead time's mean and z deviations."""
    point = mean * weeks + z * deviation * math.sqrt(max(weeks, 1.0))
    return F.struct(point.alias("point"), F.greatest(point - on_hand, F.lit(0.0)).alias("order"), (on_hand < point).alias("reorder"))


def poisson_reorder(mean: Column, on_hand: Column, weeks: float, cr: float) -> Column:
    """struct of target, safety, order and reorder: the least stock that meets demand with the critical ratio's probability."""
    expected = F.greatest(mean * weeks, F.lit(1e-9))
    target = poisson_quantiles(F.lit(cr), expected)
    return F.struct(target.alias("target"), F.greatest(target - mean * weeks, F.lit(0.0)).alias("safety"), F.greatest(target - on_hand, F.lit(0.0)).alias("order"), (on_hand < target).alias("reorder"))


def poisson_safety(mean: float, cr: float | None) -> float:
    if cr is None:
        raise ValueError("a critical ratio is needed")
    return max(poisson_quantile(cr, max(mean, 1e-9)) - mean, 0.0)


def poisson_safety_stock(demand: DataFrame, mean: str, cr: float | None) -> DataFrame:
    """demand with target and safety: the least stock that meets a mean's Poisson demand with the critical ratio's probability, and what it is beyond the mean."""
    if cr is None:
        raise ValueError("a critical ratio is needed")
    told = poisson_reorder(F.col(mean), F.lit(0.0), 1.0, cr)
    return demand.withColumn("told_", told).select(*demand.columns, F.col("told_.target").cast("long").alias("target"), F.round("told_.safety", 6).alias("safety"))


def pair_demand(panel: DataFrame, forecast: float | DataFrame, recent: int = 8) -> DataFrame:
    """Each pair's part of a pooled weekly forecast, by its share of all history, with mean and deviation of its last weeks (0 if there is one).

    The forecast is a number, or a frame of one row with a column `forecast`, such as first_week gives.
    """
    whole = panel.agg(F.sum("units_sold").cast("double").alias("whole"))
    share = panel.groupBy(*PAIR).agg(F.sum("units_sold").cast("double").alias("units")).crossJoin(F.broadcast(whole))
    stats = last_rows(panel, PAIR, "week_start_date", recent).groupBy(*PAIR).agg(F.round(F.avg("units_sold"), 8).alias("recent_mean"), F.round(F.coalesce(F.stddev_samp("units_sold"), F.lit(0.0)), 8).alias("recent_std"))
    if isinstance(forecast, DataFrame):
        one = forecast.agg(F.max(F.col("forecast").cast("double")).alias("forecast_"))  # one row, whatever comes in
        share, told = share.crossJoin(F.broadcast(one)), F.col("forecast_")
    else:
        told = F.lit(float(forecast))
    part = ratio(F.col("units"), F.col("whole"))
    return share.join(stats, PAIR, "left").select(*PAIR, part.alias("share"), (part * told).alias("mean"), F.coalesce("recent_mean", F.lit(0.0)).alias("recent_mean"), F.coalesce("recent_std", F.lit(0.0)).alias("recent_std"))


def last_on_hand(panel: DataFrame) -> DataFrame:
    """Mean stock of each pair in the last week."""
    last = panel.agg(F.max("week_start_date").alias("last"))
    return panel.join(F.broadcast(last), F.col("week_start_date") == F.col("last"), "left_semi").groupBy(*PAIR).agg(F.avg("on_hand_end").alias("on_hand"))


def mean_price(panel: DataFrame) -> DataFrame:
    """Mean price of each pair over all weeks, those without sales at 0, and over selling weeks."""
    return panel.groupBy(*PAIR).agg(F.round(F.avg("avg_unit_price"), 6).alias("mean_price"), F.round(F.avg(F.when(F.col("units_sold") > 0, F.col("avg_unit_price"))), 6).alias("mean_selling_price"))


def first_week(paths: DataFrame) -> DataFrame:
    """forecast: of the next week, by the path of the shortest horizon; one row. Raises ValueError if there isn't exactly one such row."""
    shortest = paths.agg(F.min("horizon").alias("horizon"))
    found = paths.where("weeks_ahead = 1").join(F.broadcast(shortest), "horizon", "left_semi").select(F.col("forecast").cast("double").alias("forecast"))
    if (n := found.count()) != 1:
        raise ValueError(f"{n} forecasts of the next week")
    return found


def reorder_plan(panel: DataFrame, forecast: float | DataFrame, weeks: float = 1.0, service_level: float = 0.95) -> DataFrame:
    """All pairs with both methods' decisions. The price cancels out of the critical ratio, so one ratio serves all pairs."""
    cr = critical_ratio(1.0, weeks)
    base = pair_demand(panel, forecast).join(last_on_hand(panel), PAIR).join(mean_price(panel), PAIR)
    normal = normal_reorder(F.col("mean"), F.col("recent_std"), F.col("on_hand"), weeks, normal_quantile(cr))
    poisson = poisson_reorder(F.col("mean"), F.col("on_hand"), weeks, cr)
    out = base.withColumns({"normal": normal, "poisson": poisson})
    return out.select(
        *PAIR, "share", "mean", "recent_std", "on_hand", "mean_price", F.col("normal.point").alias("normal_point"), F.col("normal.order").alias("normal_order"),
        F.col("poisson.target").alias("target"), F.col("poisson.safety").alias("safety"), F.col("poisson.order").alias("order_units"), F.col("poisson.reorder").alias("reorder"),
    )


def plan_summary(plan: DataFrame, weeks: float = 1.0) -> DataFrame:
    value = F.sum(F.when(F.col("reorder"), F.col("order_units") * F.col("mean_price") * COST))
    return plan.agg(F.count("*").alias("pairs"), F.sum(F.col("reorder").cast("int")).cast("long").alias("reorder_pairs"), F.round(F.sum(F.when(F.col("reorder"), F.col("order_units"))), 4).alias("order_units"), F.round(value, 2).alias("order_value"), F.lit(critical_ratio(1.0, weeks)).alias("critical_ratio"))


def largest_orders(plan: DataFrame, n: int = 10) -> DataFrame:
    return plan.where("reorder").orderBy(F.desc("order_units"), *PAIR).limit(n)


def by_store(plan: DataFrame) -> DataFrame:
    return plan.where("reorder").groupBy("store_id").agg(F.count("*").alias("pairs"), F.round(F.sum("order_units"), 4).alias("order_units"))


def replay_weeks(weeks: int, holdout: int = 13, least_train: int = 8) -> int:
    """Weeks of training before the replay; raises ValueError if both together are under ten."""
    train = max(weeks - holdout, least_train)
    if weeks < 10 or train >= weeks:
        raise ValueError(f"{weeks} weeks are too few")
    return train


def replay(panel: DataFrame, holdout: int = 13, lead: float = 1.0) -> DataFrame:
    """week, policy, forecast, safety, cover and errors: what policies would have kept, told only by the weeks before.

    Raises ValueError for histories that are too short (replay_weeks), which takes one small count.

    Policies: the mean of earlier weeks alone, that mean with a normal margin, and with a Poisson margin. Units that
    stocked-out pairs lost are put at the mean of a pair, times their number. One expanding window over the pooled weeks
    replaces a loop.
    """
    train = replay_weeks(panel.select("week_start_date").distinct().count(), holdout)
    pairs = panel.select(*PAIR).distinct().agg(F.count("*").alias("n_pairs"))
    weekly = panel.groupBy("week_start_date").agg(F.sum("units_sold").cast("double").alias("actual"), F.sum((F.col("stockout_count") > 0).cast("int")).cast("long").alias("censored"))
    ordered = Window.orderBy("week_start_date")  # one row a week
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    told = weekly.withColumns({"past_mean": F.avg("actual").over(earlier), "past_std": F.stddev_samp("actual").over(earlier), "place": F.row_number().over(ordered)})
    held = told.where(F.col("place") > train).crossJoin(F.broadcast(pairs))
    cr = critical_ratio(1.0, lead)
    lost = F.col("censored") * F.col("past_mean") / F.col("n_pairs")
    normal = normal_quantile(cr) * F.coalesce("past_std", F.lit(0.0))
    held = held.withColumn("poisson", F.greatest(poisson_quantiles(F.lit(cr), F.greatest("past_mean", F.lit(1e-9))) - F.col("past_mean"), F.lit(0.0)))
    policies = F.array(*[F.struct(F.lit(n).alias("policy"), s.alias("safety_stock")) for n, s in (("mean", F.lit(0.0)), ("normal", normal), ("poisson", F.col("poisson")))])
    out = held.select("week_start_date", "actual", F.col("past_mean").alias("forecast"), lost.alias("unmet"), "censored", F.explode(policies).alias("p"))
    out = out.select("week_start_date", "p.policy", F.round("forecast", 4).alias("forecast_units"), F.round("p.safety_stock", 4).alias("safety_stock"), (F.col("forecast") + F.col("p.safety_stock")).alias("cover"), "actual", F.col("censored").alias("censored_pairs"), F.round("unmet", 4).alias("unmet_units"))
    need = F.col("actual") + F.col("unmet_units")
    return out.withColumns({"overstock_units": F.round(F.greatest(F.col("cover") - need, F.lit(0.0)), 4), "understock_units": F.round(F.greatest(need - F.col("cover"), F.lit(0.0)), 4), "cover_units": F.round("cover", 4)}).drop("cover")


def policy_totals(replayed: DataFrame) -> DataFrame:
    return replayed.groupBy("policy").agg(F.round(F.sum("overstock_units"), 2).alias("overstock"), F.round(F.sum("understock_units"), 2).alias("understock"), F.count("*").alias("weeks"))


def error_reduction(replayed: DataFrame, baseline: str = "mean") -> DataFrame:
    """policy, error, reduction_pct against a baseline policy (0 if that has no error), and whether it lies from 25 to 40 percent."""
    totals = replayed.groupBy("policy").agg(F.sum(F.col("overstock_units") + F.col("understock_units")).alias("error"))
    base = totals.where(F.col("policy") == baseline).select(F.col("error").alias("base"))
    pct = F.when(F.col("base") == 0, 0.0).otherwise(F.round(100 * (F.col("base") - F.col("error")) / F.nullif("base", F.lit(0.0)), 2))
    return totals.crossJoin(F.broadcast(base)).select("policy", F.round("error", 2).alias("error"), pct.alias("reduction_pct")).withColumn("meets_target", F.col("reduction_pct").between(25, 40))
