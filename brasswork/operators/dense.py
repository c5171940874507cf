"""Dense panels: every key in every week."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weeks_between(frame: DataFrame, first: str, end: str, name: str) -> DataFrame:
    """Mondays from first up to, not including, end."""
    days = f"sequence(DATE '{first}', date_sub(DATE '{end}', 1), INTERVAL 7 DAYS)"
    return frame.sparkSession.range(1).select(F.explode(F.expr(days)).alias(name))


def dense_grid(weekly: DataFrame, keys: list[str], week: str, first: str, end: str) -> DataFrame:
    """Each combination of keys that occurs, in each week; what weekly lacks is null.

    The grid is made by exploding a literal list of weeks beside each key, without a join; the left join then meets
    keys and weeks, and both sides are hashed alike.
    """
    listed = F.expr(f"sequence(DATE '{first}', date_sub(DATE '{end}', 1), INTERVAL 7 DAYS)" if first < end else "CAST(array() AS array<date>)")
    grid = weekly.select(*keys).distinct().select(*keys, F.explode(listed).alias(week))
    return grid.join(weekly, [*keys, week], "left")
