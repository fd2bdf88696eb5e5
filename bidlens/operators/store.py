"""Tables with a state: responses with a lifetime, request budgets, versions of drafts, the document library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import is_fresh
from .search import first_seen


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    return first_seen(rows, key, order)


def cached(responses: DataFrame, now: Column, ttl: Column | None = None) -> DataFrame:
    """The newest response to each key, if it may still be used; a caller's ttl overrides the stored one."""
    newest = latest(responses, ["key"], [F.desc("created"), F.desc("seq")])
    return newest.where(is_fresh(F.col("created"), F.col("ttl") if ttl is None else ttl, now))


def cache_stats(responses: DataFrame, now: Column) -> DataFrame:
    fresh = is_fresh(F.col("created"), F.col("ttl"), now)
    return responses.agg(F.count("*").alias("entries"), F.count_if(fresh).alias("fresh"), F.count_if(~fresh).alias("stale"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"))


def daily_budget(requests: DataFrame, ts: str, budget: int = 9, days: int = 7) -> DataFrame:
    """day, used and remaining of the last `days` days with a request."""
    used = requests.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("used"))
    return used.orderBy(F.desc("day")).limit(days).withColumn("remaining", F.greatest(budget - F.col("used"), F.lit(0)).cast("long"))


def new_documents(known: DataFrame, incoming: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Incoming documents whose text neither the library nor an earlier one of them has."""
    sha = F.sha2(F.col(text_col), 256)
    first = first_seen(incoming.withColumn("content_sha", sha), ["content_sha"], [id_col])
    return first.join(known.select(sha.alias("content_sha")).distinct(), "content_sha", "left_anti")


def updated(library: DataFrame, changes: DataFrame, id_col: str) -> DataFrame:
    """The library with changed categories, and needs_embedding where one changed."""
    new = changes.select(F.col(id_col).alias("_id"), F.col("category").alias("_category"))
    joined = library.join(new, F.col(id_col) == F.col("_id"), "left")
    changed = F.col("_category").isNotNull() & ~F.col("_category").eqNullSafe(F.col("category"))
    return joined.withColumn("needs_embedding", changed).withColumn("category", F.coalesce("_category", "category")).drop("_id", "_category")


def without(library: DataFrame, deleted: DataFrame, id_col: str) -> DataFrame:
    return library.join(deleted.select(id_col), id_col, "left_anti")


def versions(drafts: DataFrame, key: str, order: list) -> DataFrame:
    """drafts with version, 1, 2, ... by arrival."""
    return drafts.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
