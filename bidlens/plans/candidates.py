"""Candidates from several sources: live requests under a budget, what the cache holds, and a full-text crawl; the first source wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.search import has_all_terms
from ..storage import stored
from .recommend import LEAST_CANDIDATES

#: Live requests of a run, and results that a query brings from a source, at most.
LIVE, PER_QUERY = 3, 25
#: Queries that are widened where there are no broad terms.
WIDENED = 3


def affordable(spark: SparkSession, queries: list[str], left: int, live: int = LIVE, costs: list[int] | None = None) -> DataFrame:
    """no, query and whether it may be asked live: as long as the running sum of the costs is within what is left, and `live` times at most."""
    rows = list(zip(range(len(queries)), queries, costs or [1] * len(queries)))
    asked = spark.createDataFrame(rows, "no int, query string, cost int")
    spent = F.sum("cost").over(Window.orderBy("no"))  # a list of queries, not data
    return asked.select("no", "query", ((spent <= left) & (F.col("no") < live)).alias("live"))


def hits(source: DataFrame, queries: DataFrame, text: Column, order: list[Column], per_query: int = PER_QUERY) -> DataFrame:
    """The first rows of a source for each query (no, query) whose words the text all has, with no and place."""
    found = source.join(F.broadcast(queries.select("no", "query")), has_all_terms(text, F.col("query")))
    place = F.row_number().over(Window.partitionBy("no").orderBy(*order, "notice_id"))
    return found.withColumn("place", place).where(F.col("place") <= per_query)


def relaxed(source: DataFrame, queries: DataFrame, text: Column, order: list[Column], naics: list[str], per_query: int = PER_QUERY) -> DataFrame:
    """`hits` within these industries; for queries that have none there, in all."""
    if not naics:
        return hits(source, queries, text, order, per_query)
    own = stored(hits(source.where(F.col("naics").isin(*naics)), queries, text, order, per_query), "own_hits")
    without = queries.join(own.select("no").distinct(), "no", "left_anti")
    return own.unionByName(hits(source, without, text, order, per_query))


def gathered_candidates(keyed: DataFrame, cached: DataFrame, crawled: DataFrame, queries: list[str], broad: list[str], *, naics: list[str], left: int, top_k: int, order: list[Column], live: int = LIVE, per_query: int = PER_QUERY) -> DataFrame:
    """Each candidate once: its row as the first source to bring it has it, with source, sources (all that brought it), matched (the
    queries, sorted) and arrival (query, source, place).

    A query goes to the keyed service while it is affordable, to the cache and to the crawl, in this order; the next query
    follows. keyed and cached match titles, crawled its column full_text. Where fewer than the least number of candidates were found
    in all, the broad terms are crawled once more in all industries."""
    spark = crawled.sparkSession
    asked = affordable(spark, queries, left, live)
    from_ = lambda df, source, o: df.drop("full_text", "query").withColumns({"source": F.lit(source), "o": F.lit(o)})
    title, text = F.col("title"), F.col("full_text")
    by_query = asked.select("no", "query")
    parts = [
        from_(hits(keyed, asked.where("live"), title, order, per_query), "live", 0),
        from_(hits(cached, by_query, title, order, per_query), "cache", 1),
        from_(relaxed(crawled, by_query, text, order, naics, per_query), "crawl", 2),
    ]
    every = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    every = stored(every, "candidate_hits")
    least = min(LEAST_CANDIDATES, 2 * top_k)
    if every.select("notice_id").distinct().limit(least).count() < least:
        again = broad or queries[:WIDENED]
        wide = spark.createDataFrame([(len(queries) + i, q) for i, q in enumerate(again)], "no int, query string")
        every = every.unionByName(from_(hits(crawled, wide, text, order, per_query), "broadened", 3), allowMissingColumns=True)
    names = spark.createDataFrame(list(enumerate([*queries, *(broad or queries[:WIDENED])])), "no int, query string")
    every = every.join(F.broadcast(names), "no")
    arrival = F.struct("no", "o", "place")
    row = F.struct(*[c for c in every.columns if c not in ("no", "o", "place", "query")])
    once = every.groupBy("notice_id").agg(F.min_by(row, arrival).alias("row"), F.min(arrival).alias("arrival"), F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("query")).alias("matched"))
    return once.select("row.*", "sources", "matched", "arrival")
