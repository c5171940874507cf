"""Grouped roll-ups of sales lines and panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasswork.functions.dates import monday
from brasswork.functions.numbers import count_if, ratio, total
from brasswork.operators.ranges import running
from brasswork.session import cut

#: A week is kept by `complete_weeks` only if all of its days occur.
DAYS_OF_WEEK = 7


def require(frame: DataFrame, columns: Sequence[str], label: str) -> None:
    """Raises ValueError if a frame lacks columns; sales and panel name their measures differently."""
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError(f"{label} lacks {', '.join(missing)}; it has {', '.join(frame.columns)}")


def before(frame: DataFrame, boundary: str, day: str = "date") -> DataFrame:
    """Rows before a boundary. The raw date is compared, so that the filter reaches the scan."""
    return frame.where(F.col(day) < F.lit(boundary).cast("date"))


def complete_weeks(frame: DataFrame, day: str = "date") -> DataFrame:
    """week: Mondays of weeks all of whose days occur in the whole frame."""
    return frame.groupBy(monday(F.col(day)).alias("week")).agg(F.count_distinct(day).alias("days")).where(F.col("days") == DAYS_OF_WEEK).select("week")


def aggregate(sales: DataFrame, freq: str = "weekly", by: Sequence[str] = (), drop_partial: bool = True) -> DataFrame:
    """Lines, distinct transactions and customers, units, revenue and more by day or Monday week and further columns.

    With drop_partial a week counts only if it has seven distinct dates in all sales, whatever the further columns.
    """
    if freq not in ("daily", "weekly"):
        raise ValueError(f"freq must be daily or weekly, not {freq}")
    period = F.col("date") if freq == "daily" else monday(F.col("date"))
    rows = sales.withColumn("period", period)
    if freq == "weekly" and drop_partial:
        rows = rows.join(complete_weeks(sales).withColumnRenamed("week", "period"), "period", "left_semi")
    discount = "discount_value" if "discount_value" in sales.columns else None
    value = total(discount) if discount else F.sum(F.col("discount") * F.col("quantity_sold"))
    grouped = rows.groupBy("period", *by).agg(
        F.count("*").alias("lines"), F.count_distinct("transaction_id").alias("transactions"), F.count_distinct("customer_id").alias("customers"),
        F.sum("quantity_sold").cast("long").alias("units"), total("sales_amount").alias("revenue"), value.alias("discount_value"),
        count_if(F.col("quantity_sold") == 0).alias("stockout_lines"), F.count_distinct("date").alias("days_covered"),
    )
    return grouped.withColumn("avg_line_value", F.col("revenue") / F.col("lines"))


def weekly_revenue(sales: DataFrame) -> DataFrame:
    grouped = sales.groupBy(monday(F.col("date")).alias("week_start_date")).agg(
        total("sales_amount").alias("revenue"), F.sum("quantity_sold").cast("long").alias("units"),
        F.count_distinct("transaction_id").alias("transactions"), F.count_distinct("customer_id").alias("customers"),
    )
    return grouped.withColumn("avg_basket_value", F.col("revenue") / F.col("transactions"))


def with_share(frame: DataFrame, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds each row's share of the total: of its group, or of the whole frame, whose total is one row joined to all."""
    if by:
        return frame.withColumn(name, ratio(F.col(value), F.sum(value).over(Window.partitionBy(*by))))
    whole = frame.agg(F.sum(value).alias("whole_"))
    return frame.crossJoin(F.broadcast(whole)).withColumn(name, ratio(F.col(value), F.col("whole_"))).drop("whole_")


def sku_mix(sales: DataFrame) -> DataFrame:
    """Revenue, units, mean price and discount by category and product, with the share of all revenue."""
    grouped = sales.groupBy("product_category", "product_id").agg(
        F.sum("sales_amount").alias("exact"), F.sum("quantity_sold").cast("long").alias("units"), F.count("*").alias("lines"),
        F.round(F.avg("unit_price"), 6).alias("avg_unit_price"), F.round(F.avg("discount_pct"), 6).alias("avg_discount_pct"),
    )
    shared = grouped.withColumn("revenue", F.col("exact").cast("double"))
    whole = grouped.agg(F.sum("exact").cast("double").alias("whole"))
    return shared.crossJoin(F.broadcast(whole)).select("product_category", "product_id", "revenue", "units", "lines", "avg_unit_price", "avg_discount_pct", ratio(F.col("revenue"), F.col("whole")).alias("revenue_share"))


def first_by(frame: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in a stated order; ties must be broken by it."""
    window = Window.partitionBy(*by).orderBy(*order)
    return frame.withColumn("rank_", F.row_number().over(window)).where("rank_ = 1").drop("rank_")


def category_seasonality(sales: DataFrame) -> DataFrame:
    """Units and revenue by category and month, shares within the category, and the category's peak month (the first on ties)."""
    monthly = sales.groupBy("product_category", F.month("date").alias("month")).agg(F.sum("quantity_sold").cast("long").alias("units"), total("sales_amount").alias("revenue"))
    shares = with_share(monthly, "units", "unit_share", ["product_category"])
    peaks = first_by(shares, ["product_category"], [F.desc("unit_share"), F.asc("month")])
    peaks = peaks.select("product_category", F.col("month").alias("peak_month"), F.col("unit_share").alias("peak_share"), F.col("units").alias("peak_units"), F.col("revenue").alias("peak_revenue"))
    return shares.join(peaks, "product_category", "left")


def kpis(sales: DataFrame) -> DataFrame:
    """metric, value: the headline numbers, one each row. The repeat rate counts customers with several distinct dates."""
    dates = sales.groupBy("customer_id").agg(F.count_distinct("date").alias("dates"))
    repeat = dates.agg(ratio(count_if(F.col("dates") > 1).cast("double"), F.count("*")).alias("repeat_rate"))
    head = sales.agg(
        total("sales_amount").alias("revenue"), F.sum("quantity_sold").cast("double").alias("units"), F.count_distinct("transaction_id").cast("double").alias("transactions"),
        F.count_distinct("customer_id").cast("double").alias("customers"), F.count_distinct("product_id").cast("double").alias("products"), F.count_distinct("store_id").cast("double").alias("stores"),
        ratio(count_if(F.col("quantity_sold") == 0).cast("double"), F.count("*")).alias("zero_line_share"),
    )
    names = ["revenue", "units", "transactions", "customers", "products", "stores", "zero_line_share", "repeat_rate"]
    row = head.crossJoin(F.broadcast(repeat))
    return row.unpivot([], names, "metric", "value")


def kpi_value(frame: DataFrame, metric: str) -> float:
    """One headline number; raises KeyError if there is none of this name."""
    found = frame.where(F.col("metric") == metric).first()
    if found is None:
        raise KeyError(metric)
    return found["value"]


def promotion_lift(sales: DataFrame) -> DataFrame:
    """Promoted and plain lines beside each other, and the ratios of their means. Lines without units don't count in realised prices."""
    promoted = F.col("is_promotion") == 1
    realised = F.col("sales_amount").cast("double") / F.nullif("quantity_sold", F.lit(0))
    mean = lambda value, side: ratio(F.sum(F.when(side, value)).cast("double"), F.sum(F.when(side & value.isNotNull(), 1)))
    out = sales.agg(
        count_if(promoted).alias("promo_lines"), count_if(~promoted).alias("plain_lines"),
        mean(F.col("quantity_sold"), promoted).alias("promo_units_per_line"), mean(F.col("quantity_sold"), ~promoted).alias("plain_units_per_line"),
        mean(F.col("sales_amount"), promoted).alias("promo_revenue_per_line"), mean(F.col("sales_amount"), ~promoted).alias("plain_revenue_per_line"),
        F.round(mean(realised, promoted), 4).alias("promo_realised_price"), F.round(mean(realised, ~promoted), 4).alias("plain_realised_price"),
        F.count_distinct(F.when(promoted, F.col("date"))).alias("promo_days"),
    )
    return out.withColumn("volume_lift", ratio(F.col("promo_units_per_line"), F.col("plain_units_per_line"))).withColumn("value_lift", ratio(F.col("promo_revenue_per_line"), F.col("plain_revenue_per_line")))


def store_product_matrix(panel: DataFrame, products: Sequence[str]) -> DataFrame:
    """Units by store (rows) and product (columns), 0 where there are none. The products are named, so no job finds them."""
    return panel.groupBy("store_id").pivot("product_id", list(products)).agg(F.sum("units_sold").cast("long")).na.fill(0)


def top_store_products(panel: DataFrame, n: int = 20) -> DataFrame:
    """The n pairs of most units; ties go by store, then product."""
    units = panel.groupBy("store_id", "product_id").agg(F.sum("units_sold").cast("long").alias("units"))
    return units.orderBy(F.desc("units"), "store_id", "product_id").limit(n)


def demand_distribution(panel: DataFrame) -> DataFrame:
    """Pairs from most to least units, with the share of pairs and of units so far.

    The running total is taken in two levels, so that no task sorts all pairs.
    """
    units = panel.groupBy("store_id", "product_id").agg(F.sum("units_sold").cast("long").alias("units"))
    return running_share(units, "units", ["store_id", "product_id"])


def running_share(frame: DataFrame, value: str, ties: Sequence[str]) -> DataFrame:
    """Adds rank, cumulative and row shares in descending order of an integer value; ties go by further columns, in ascending order."""
    out, totals = running(cut(frame), [-F.col(value), *map(F.col, ties)], {"cumulative": value})
    rows, whole = F.lit(float(totals["rank"])), F.lit(totals["cumulative"])
    return out.select(*frame.columns, "rank", F.col("cumulative").cast("long").alias("cumulative"), ratio(F.col("cumulative").cast("double"), whole).alias("value_share"), (F.col("rank").cast("double") / rows).alias("row_share"))


def concentration(distribution: DataFrame, head: float = 0.2) -> DataFrame:
    """The share of value that the leading share of rows holds; with fewer rows, that of the first row."""
    inside = F.max(F.when(F.col("row_share") <= head, F.col("value_share")))
    return distribution.agg(F.coalesce(inside, F.min("value_share")).alias("head_value_share"), F.count("*").alias("rows"))


def rows_for_share(distribution: DataFrame, share: float) -> DataFrame:
    """The fewest leading rows that hold a share of the value."""
    whole = F.max("cumulative")
    needed = distribution.agg((F.sum(F.when(F.col("value_share") < share, 1).otherwise(0)) + 1).alias("needed"), F.count("*").alias("rows"), whole.alias("whole"))
    return needed.select(F.least("needed", "rows").cast("long").alias("rows_needed"), "rows", (F.least("needed", "rows") / F.col("rows")).alias("row_share"))


def monthly_growth(sales: DataFrame) -> DataFrame:
    """Revenue by month, and its ratio to the same month a year before where both are there."""
    monthly = sales.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(total("sales_amount").alias("revenue"), F.sum("quantity_sold").cast("long").alias("units"))
    last = monthly.select((F.col("year") + 1).alias("year"), "month", F.col("revenue").alias("last_revenue"))
    return monthly.join(last, ["year", "month"], "left").withColumn("growth", ratio(F.col("revenue"), F.col("last_revenue")) - 1)


def by_place(sales: DataFrame) -> DataFrame:
    """Revenue, units and transactions by region and by city in one pass, with shares of the whole."""
    grouped = sales.groupingSets([["region"], ["city"]], "region", "city").agg(
        F.sum("sales_amount").alias("exact"), F.sum("quantity_sold").cast("long").alias("units"), F.count_distinct("transaction_id").alias("transactions"), F.grouping("region").alias("no_region")
    )
    whole = F.sum(F.when(F.col("no_region") == 0, F.col("exact"))).over(Window.partitionBy())  # a few places
    named = grouped.withColumn("whole", whole.cast("double"))
    return named.select(F.when(F.col("no_region") == 0, "region").otherwise("city").alias("level"), F.coalesce("region", "city").alias("place"), F.col("exact").cast("double").alias("revenue"), "units", "transactions", ratio(F.col("exact").cast("double"), F.col("whole")).alias("revenue_share"))


def by_category(sales: DataFrame) -> DataFrame:
    selling = count_if(F.col("quantity_sold") > 0)
    out = sales.groupBy("product_category").agg(F.count("*").alias("lines"), selling.alias("selling_lines"), F.sum("quantity_sold").cast("long").alias("units"), total("sales_amount").alias("revenue"), F.count_distinct("sku_id").alias("skus"))
    return out.withColumn("units_per_selling_line", ratio(F.col("units").cast("double"), F.col("selling_lines")))


def weekday_lift(sales: DataFrame) -> DataFrame:
    """By weekday: mean units and revenue of days of strong and of plain promotion, and their ratio; a side without days is null.

    A day counts as a campaign day if most of its lines carry a discount of five percent or more.
    """
    daily = sales.groupBy("date").agg(F.sum("quantity_sold").cast("long").alias("units"), total("sales_amount").alias("revenue"), ratio(count_if(F.col("discount_pct") >= 5).cast("double"), F.count("*")).alias("share"))
    side = F.col("share") > 0.5
    mean = lambda c, which: ratio(F.sum(F.when(which, F.col(c))).cast("double"), F.sum(F.when(which, 1)))
    out = daily.groupBy(F.weekday("date").alias("weekday")).agg(mean("units", side).alias("campaign_units"), mean("units", ~side).alias("plain_units"), count_if(side).alias("campaign_days"), count_if(~side).alias("plain_days"))
    return out.withColumn("lift", ratio(F.col("campaign_units"), F.col("plain_units")))


def mix_by_month(sales: DataFrame) -> DataFrame:
    """Each category's share of a month's units, its strongest and weakest month, and whether its volume is under two percent."""
    monthly = sales.groupBy("product_category", F.month("date").alias("month")).agg(F.sum("quantity_sold").cast("long").alias("units"))
    shares = with_share(monthly, "units", "share", ["month"])
    high = first_by(shares, ["product_category"], [F.desc("share"), F.asc("month")]).select("product_category", F.col("month").alias("peak_month"), F.col("share").alias("peak_share"))
    low = first_by(shares, ["product_category"], [F.asc("share"), F.asc("month")]).select("product_category", F.col("month").alias("trough_month"), F.col("share").alias("trough_share"))
    volume = with_share(monthly.groupBy("product_category").agg(F.sum("units").alias("units")), "units", "volume_share")
    out = volume.join(high, "product_category").join(low, "product_category")
    return out.select("product_category", "units", "volume_share", "peak_month", "peak_share", "trough_month", "trough_share", ratio(F.col("peak_share"), F.col("trough_share")).alias("swing"), (F.col("volume_share") < 0.02).alias("noisy"))


def lost_demand(sales: DataFrame) -> DataFrame:
    """By category: lines without units (lost demand) and sales that took the last unit."""
    left = F.col("inventory_level") == 0
    none = F.col("quantity_sold") == 0
    out = sales.groupBy("product_category").agg(F.count("*").alias("lines"), count_if(none).alias("lost_lines"), count_if(left & ~none).alias("last_unit_lines"))
    return out.withColumn("lost_share", ratio(F.col("lost_lines").cast("double"), F.col("lines")))


def lost_demand_hotspots(panel: DataFrame, n: int = 10) -> DataFrame:
    """Pairs with most stock-out weeks, with units per week."""
    grouped = panel.groupBy("store_id", "product_id").agg(F.sum("stockout_count").cast("long").alias("stockouts"), F.sum("units_sold").cast("long").alias("units"), F.count("*").alias("weeks")).where("stockouts > 0")
    return grouped.withColumn("stockouts_per_week", F.col("stockouts").cast("double") / F.col("weeks")).orderBy(F.desc("stockouts"), "store_id", "product_id").limit(n)


def baskets(sales: DataFrame) -> DataFrame:
    """Lines of each transaction as an array in a fixed order."""
    line = F.struct("sku_id", "quantity_sold", "sales_amount")
    return sales.groupBy("transaction_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))


def basket_sizes(sales: DataFrame) -> DataFrame:
    """Median (the element in the middle, the upper one of two), largest size and the share of baskets of several lines, from counts by size."""
    sizes = sales.groupBy("transaction_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))
    running = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row for each size
    counted = sizes.withColumn("upto", F.sum("n").over(running)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("size")))
    return counted.agg(middle.alias("median_lines"), F.max("size").alias("max_lines"), F.sum("n").alias("baskets"), (F.sum(F.when(F.col("size") > 1, F.col("n")).otherwise(0)).cast("double") / F.sum("n")).alias("multi_share"))


def facts(sales: DataFrame) -> DataFrame:
    """One row of whole-table facts."""
    return sales.agg(
        F.count("*").alias("lines"), F.sum("quantity_sold").cast("long").alias("units"), total("sales_amount").alias("revenue"), total("discount_value").alias("discount_value"),
        F.count_distinct("transaction_id").alias("transactions"), F.count_distinct("customer_id").alias("customers"), F.count_distinct("sku_id").alias("skus"), F.count_distinct("store_id").alias("stores"),
        F.count_distinct("region").alias("regions"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("date").alias("days"),
        count_if(F.col("is_promotion") == 1).alias("promoted_lines"), count_if(F.col("quantity_sold") == 0).alias("lost_lines"), F.max("quantity_sold").alias("max_quantity"),
    )


def value_shares(frame: DataFrame, column: str) -> DataFrame:
    """value, n, share of each value of a column."""
    return with_share(frame.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")), "n", "share")
