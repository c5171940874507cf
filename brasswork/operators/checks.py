"""Statistical checks of sales: rhythms, matched comparisons, and the shapes of distributions, as one report.

Lines are read once and summed by day, by month and category, by transaction and by quantity in one pass of grouping sets;
all checks are told from these sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasswork.functions.numbers import ratio
from brasswork.operators.ranges import quantiles
from brasswork.session import cut

#: What each check must reach at least.
BOUNDS = {
    "saturday_over_monday": 1.40, "sunday_over_monday": 1.20, "peak_over_trough_month": 1.40, "festive_over_midyear": 1.15, "campaign_promo_share": 3.0, "campaign_lift": 1.15,
    "category_swing": 1.15, "basket_valley": 0.2, "basket_tail": 1.8, "single_baskets": 0.05, "pack_spike_6": 3.0, "pack_spike_12": 3.0, "pack_spike_24": 3.0,
    "lost_lines": 0.0, "repeat_customers": 0.85, "median_baskets": 5.0,
}
PACKS = (6, 12, 24)
FESTIVE, MIDYEAR = (10, 11), (5, 6, 7)
LEAST_MODE = 0.005  # of all baskets: a smaller peak is no mode


def summed(sales: DataFrame) -> dict[str, DataFrame]:
    """days, mix, baskets and quantities: lines, units and promoted lines by each."""
    named = sales.select(
        F.col("date").alias("day"), F.trunc("date", "month").alias("month"), F.col("product_category").alias("category"), F.col("transaction_id").alias("basket"),
        F.col("customer_id").alias("customer"), F.col("quantity_sold").alias("quantity"), "is_promotion",
    )
    keys = ("day", "month", "category", "basket", "customer", "quantity")
    sets = {"days": ("day",), "mix": ("month", "category"), "baskets": ("basket", "customer"), "quantities": ("quantity",)}
    code = {name: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in own) for name, own in sets.items()}
    grouped = named.groupingSets([[F.col(k) for k in own] for own in sets.values()], *keys)
    found = cut(grouped.agg(F.count("*").alias("lines"), F.sum("quantity").cast("long").alias("units"), F.sum("is_promotion").cast("long").alias("promo"), F.grouping_id().alias("set_")))
    return {name: found.where(F.col("set_") == code[name]).select(*own, "lines", "units", "promo") for name, own in sets.items()}


def _over(a: Column, b: Column) -> Column:
    return F.round(ratio(a.cast("double"), b.cast("double")), 6)


def rhythms(days: DataFrame) -> DataFrame:
    """One row: the checks of weekdays and months, from daily sums."""
    on = lambda k: F.avg(F.when(F.weekday("day") == k, F.col("units")))
    week = days.agg(_over(on(5), on(0)).alias("saturday_over_monday"), _over(on(6), on(0)).alias("sunday_over_monday"))
    monthly = days.groupBy(F.trunc("day", "month").alias("month")).agg(F.avg("units").alias("mean"))
    within = lambda months: F.avg(F.when(F.month("month").isin(*months), F.col("mean")))
    year = monthly.agg(_over(F.max("mean"), F.min("mean")).alias("peak_over_trough_month"), _over(within(FESTIVE), within(MIDYEAR)).alias("festive_over_midyear"))
    return week.crossJoin(F.broadcast(year))  # a row each


def matched_days(days: DataFrame, campaign: Column) -> DataFrame:
    """One row: campaign days against the others. Volumes are compared within each weekday, so that a campaign's weekdays don't count for it."""
    marked = days.withColumn("campaign", campaign)
    share = F.col("promo") / F.col("lines")
    promo = marked.agg(_over(F.avg(F.when(F.col("campaign"), share)), F.avg(F.when(~F.col("campaign"), share))).alias("campaign_promo_share"))
    pairs = marked.groupBy(F.weekday("day").alias("weekday")).agg(F.avg(F.when(F.col("campaign"), F.col("units"))).alias("inside"), F.avg(F.when(~F.col("campaign"), F.col("units"))).alias("outside"))
    return promo.crossJoin(F.broadcast(pairs.agg(F.round(F.avg(ratio(F.col("inside"), F.col("outside"))), 6).alias("campaign_lift"))))  # a row each


def mix_swing(mix: DataFrame) -> DataFrame:
    """One row: the largest of the categories' ratios between their greatest and least share of a calendar month's units."""
    calendar = mix.groupBy(F.month("month").alias("of_year"), "category").agg(F.sum("units").alias("units"))
    shares = calendar.withColumn("share", F.col("units") / F.sum("units").over(Window.partitionBy("of_year")))  # a row for each category
    swings = shares.groupBy("category").agg(ratio(F.max("share"), F.min("share")).alias("swing"))
    return swings.agg(F.round(F.max("swing"), 6).alias("category_swing"))


def valley(sizes: DataFrame, least: float = LEAST_MODE) -> DataFrame:
    """One row: how deep the valley between the two modes of a histogram (size, n) is; 0 if it has one.

    For each size beyond the most frequent one: what part of its height the lowest size between both falls short of. Sizes
    that don't occur are as low as can be, and peaks of less than `least` of all are none.
    """
    whole = sizes.agg(F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("size")).alias("back"))).alias("top"), F.max("size").alias("last"))
    beyond = whole.select("all", (-F.col("top.back")).alias("mode"), F.explode(F.sequence(-F.col("top.back"), F.col("last"))).alias("at"))
    dense = beyond.join(sizes, F.col("at") == F.col("size"), "left").select("all", "at", "mode", F.coalesce("n", F.lit(0)).alias("n"))
    lowest = F.min("n").over(Window.partitionBy("mode").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))  # a row for each size
    depth = F.when((F.col("n") >= least * F.col("all")) & (F.col("at") > F.col("mode")), 1 - ratio(F.col("low").cast("double"), F.col("n")))
    return dense.withColumn("low", lowest).agg(F.round(F.greatest(F.coalesce(F.max(depth), F.lit(0.0)), F.lit(0.0)), 6).alias("basket_valley"))


def basket_shapes(baskets: DataFrame) -> DataFrame:
    """One row: the checks of lines per transaction and of transactions per customer."""
    sizes = cut(baskets.groupBy("basket").agg(F.sum("lines").alias("size")).groupBy("size").agg(F.count("*").alias("n")))
    each = cut(baskets.groupBy("customer").agg(F.count_distinct("basket").alias("size")).groupBy("size").agg(F.count("*").alias("n")))
    at = lambda counted, q: quantiles(counted.withColumn("all_", F.lit(1)), ["all_"], "size", "n", q).select("quantiles")
    tail = at(sizes, (0.9, 0.99)).select(_over(F.col("quantiles")[1], F.col("quantiles")[0]).alias("basket_tail"))
    middle = at(each, (0.5,)).select(F.col("quantiles")[0].cast("double").alias("median_baskets"))
    share = lambda when, name: _over(F.sum(F.when(when, F.col("n")).otherwise(0)), F.sum("n")).alias(name)
    parts = [valley(sizes), tail, sizes.agg(share(F.col("size") == 1, "single_baskets")), each.agg(share(F.col("size") > 1, "repeat_customers")), middle]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))  # a row each
    return out


def pack_spikes(quantities: DataFrame, packs: Sequence[int] = PACKS) -> DataFrame:
    """One row: lines at each pack size over the mean of the two quantities on either side, and the share of lines with none."""
    n = lambda *at: F.sum(F.when(F.col("quantity").isin(*at), F.col("lines")).otherwise(0))
    spikes = [_over(4 * n(p), n(p - 2, p - 1, p + 1, p + 2)).alias(f"pack_spike_{p}") for p in packs]
    return quantities.agg(*spikes, _over(n(0), F.sum("lines")).alias("lost_lines"))


def statistical_checks(sales: DataFrame, campaign: Column, bounds: Mapping[str, float] = BOUNDS) -> DataFrame:
    """measure, value, bound, holds: whether each value is at least its bound (lost_lines: beyond it); null where it is undefined.

    campaign tells campaign days from the daily sums: day, lines, units, promo.
    """
    by = summed(sales)
    parts = [rhythms(by["days"]), matched_days(by["days"], campaign), mix_swing(by["mix"]), basket_shapes(by["baskets"]), pack_spikes(by["quantities"])]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(F.broadcast(part))  # a row each
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), F.col(name).cast("double").alias("value"), F.lit(float(bound)).alias("bound")) for name, bound in bounds.items()]))
    told = row.select(each.alias("x")).select("x.*")
    return told.withColumn("holds", F.when(F.col("measure") == "lost_lines", F.col("value") > F.col("bound")).otherwise(F.col("value") >= F.col("bound")))
