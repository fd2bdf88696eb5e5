"""Gapless numbers within groups, however large a group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 50_000


def numbered(df: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """df with `out`: 0, 1, 2, ... within each value of `group`, which is not null.

    A group is dealt by a hash of `order` into buckets of about ROWS_PER_BUCKET rows; each is numbered by itself
    and shifted by the rows of the buckets before it. Equal rows get different numbers. df is read twice: pass a
    written table.
    """
    buckets = max(1, -(-df.count() // ROWS_PER_BUCKET))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = df.groupBy(group, "_bucket").agg(F.count("*").alias("_n")).select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    rows = df.withColumn("_at", F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)))
    joined = rows.join(shifts, (rows[group] == shifts["_g"]) & (rows["_bucket"] == shifts["_b"]))
    return joined.withColumn(out, F.col("_shift") + F.col("_at") - 1).drop("_bucket", "_at", "_g", "_b", "_shift")
