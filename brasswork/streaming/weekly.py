"""An extension: weekly roll-ups of a stream. A week comes out once the watermark has passed it, the streaming form of whole weeks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The epoch was a Thursday: four days later is a Monday.
MONDAY_OFFSET = "4 days"


def weekly_stream(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", late: str = "1 day") -> DataFrame:
    """week_start, kind, n, total by Monday week; rows later than `late` behind the latest are left out."""
    stamped = events.withColumn("time_", F.col(time).cast("timestamp")).withWatermark("time_", late)
    week = F.window("time_", "7 days", "7 days", MONDAY_OFFSET)
    return stamped.groupBy(week.alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("week_start"), "kind", "n", "total")
