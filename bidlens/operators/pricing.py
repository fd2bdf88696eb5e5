"""Award prices: summaries, histograms and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bins of a pass towards a median, and passes.
MEDIAN_BINS, MEDIAN_PASSES = 1024, 2


def _medians(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """g and the exact median of x in rows (g, x), bounds having g, lo, hi and n of each.

    A pass counts each group's rows over equal bins between its bounds and narrows these to the bins that hold its middle
    rows; what is left is counted by value. No task holds a group: a group is bins, then the values of one bin.
    """
    state = bounds.withColumns({"before": F.lit(0).cast("long"), "r1": F.floor((F.col("n") + 1) / 2), "r2": F.floor(F.col("n") / 2) + 1})
    until = Window.partitionBy("g").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def middle(groups: DataFrame) -> DataFrame:
        """Of (g, at, n, lo, hi) by group, with the state's columns, those that hold the middle rows."""
        upto = groups.withColumn("upto", F.col("before") + F.sum("n").over(until))
        return upto.where((F.col("upto") >= F.col("r1")) & (F.col("upto") - F.col("n") < F.col("r2")))

    for _ in range(MEDIAN_PASSES):
        inside = rows.join(state.select("g", "lo", "hi", "before", "r1", "r2"), "g").where("x BETWEEN lo AND hi")
        at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * MEDIAN_BINS), F.lit(MEDIAN_BINS - 1))).otherwise(0)
        binned = inside.groupBy("g", at.alias("at"), "before", "r1", "r2").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        state = middle(binned).groupBy("g", "r1", "r2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.col("upto") - F.col("n")).alias("before"))
    values = rows.join(state, "g").where("x BETWEEN lo AND hi").groupBy("g", F.col("x").alias("at"), "before", "r1", "r2").agg(F.count("*").alias("n"))
    return middle(values).groupBy("g").agg(F.avg("at").alias("median"))


def price_summary(awards: DataFrame, by: list[str], amount: str = "amount") -> DataFrame:
    """Per group: rows, priced rows, least, most, mean and exact median; all null but the counts where nothing is priced."""
    x = F.col(amount)
    summed = awards.groupBy(*by).agg(F.count("*").alias("total"), F.count(x).alias("priced"), F.min(x).alias("min_amount"), F.max(x).alias("max_amount"), F.avg(x).alias("mean_amount"))
    group = F.struct(*by) if by else F.lit(0)
    rows = awards.select(group.alias("g"), x.cast("double").alias("x")).where("x IS NOT NULL")
    bounds = summed.where("priced > 0").select(group.alias("g"), F.col("min_amount").cast("double").alias("lo"), F.col("max_amount").cast("double").alias("hi"), F.col("priced").alias("n"))
    whole = summed.select(group.alias("g"), F.struct(*by, "total", "priced", "min_amount", "max_amount", "mean_amount").alias("s"))
    medians = _medians(rows, bounds).select(F.col("g").alias("m"), "median")
    joined = whole.join(medians, F.col("g").eqNullSafe(F.col("m")), "left")
    return joined.select("s.*", F.col("median").alias("median_amount"))


def price_histogram(awards: DataFrame, amount: str = "amount", bins: int = 8) -> DataFrame:
    """bin (from 1), lo, hi and n of equal-width, right-closed bins; empty bins too. Equal amounts make one bin, none make none.

    One scan for the bounds, one for the counts; the bounds are one row.
    """
    x = F.col(amount)
    bounds = awards.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    edge = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / bins

    def inside(i: int) -> Column:
        cond = x.isNotNull()
        if i > 1:
            cond = cond & (x > edge(i - 1))
        return cond & (x <= edge(i)) if i < bins else cond

    counted = awards.select(x).crossJoin(F.broadcast(bounds)).groupBy("lo", "hi").agg(*[F.count_if(inside(i)).alias(f"b{i}") for i in range(1, bins + 1)], F.count(x).alias("priced"))
    rows = F.array(*[F.struct(F.lit(i).alias("bin"), edge(i - 1).alias("lo"), (edge(i) if i < bins else F.col("hi")).alias("hi"), F.col(f"b{i}").alias("n")) for i in range(1, bins + 1)])
    one = F.array(F.struct(F.lit(1).alias("bin"), F.col("lo").alias("lo"), F.col("hi").alias("hi"), F.col("priced").alias("n")))
    return counted.where("lo IS NOT NULL").select(F.explode(F.when(F.col("lo") == F.col("hi"), one).otherwise(rows)).alias("r")).select("r.*")


def ranked_awards(awards: DataFrame, key: str, amount: str = "amount", limit: int = 100) -> DataFrame:
    """The largest amounts first, unpriced ones last, ties by key."""
    return awards.orderBy(F.col(amount).desc_nulls_last(), F.col(key)).limit(limit)
