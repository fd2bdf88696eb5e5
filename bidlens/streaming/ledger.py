"""An extension: the request ledger and first-seen rows over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Requests a day; a day is done once the watermark has passed it."""
    at = F.col(ts).cast("timestamp")
    windowed = events.withColumn(ts, at).withWatermark(ts, late).groupBy(F.window(ts, "1 day")).agg(F.count("*").alias("used"))
    return windowed.select(F.to_date("window.start").alias("day"), "used")


def first_arrivals(events: DataFrame, key: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each key to arrive; keys are forgotten after `late`."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
