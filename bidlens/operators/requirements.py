"""Requirements found in solicitation texts, and the sections that answer them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import requirement_category, requirement_rank, requirement_sentences
from .search import first_seen


def requirements(texts: DataFrame, id_col: str, text_col: str, *, words: str = V.REQUIREMENT_WORDS, least: int = 25, most: int = 400) -> DataFrame:
    """id, pos, requirement and category of the distinct requirement sentences of `least` to `most` characters, at their first place."""
    found = texts.select(F.col(id_col).alias("id"), F.posexplode(requirement_sentences(F.col(text_col), words)).alias("pos", "requirement"))
    found = found.where(F.length("requirement").between(least, most)).withColumn("_key", F.lower("requirement"))
    return first_seen(found, ["_key"], ["id", "pos"]).drop("_key").withColumn("category", requirement_category(F.col("requirement")))


def matrix(found: DataFrame, most: int = 15) -> DataFrame:
    """The first `most` requirements by arrival, numbered by the order of their categories."""
    first = found.orderBy("id", "pos").limit(most)
    return first.withColumn("item", F.row_number().over(Window.orderBy(requirement_rank(F.col("category")), "id", "pos")))


def status(score: Column) -> Column:
    a, p, n = V.STATUSES
    return F.when(score >= V.ADDRESSED, a).when(score >= V.PARTIAL, p).otherwise(n)


def mapped(pairs: DataFrame) -> DataFrame:
    """q (requirement), id (section, numbered in order), score: the best section of each requirement, the first of equals, with status."""
    best = pairs.groupBy("q").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("b"))
    return best.select("q", F.col("b.id").alias("section"), F.col("b.score").alias("score"), status(F.col("b.score")).alias("status"))


def status_counts(items: DataFrame, status_col: str = "status") -> DataFrame:
    """Rows of each status, with those that do not occur."""
    spark = items.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in V.STATUSES])).alias("status"))
    counts = items.groupBy(F.col(status_col).alias("status")).agg(F.count("*").alias("n"))
    return names.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
