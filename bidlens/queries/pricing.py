"""Queries over award prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normalize import agency, currency
from ..operators import pricing as P
from ..registry import query
from ..sources.tables import NOTICES_SQL, notices, table
from ..storage import stored

_SUMMARY = "count(*)::bigint AS total, count(x)::bigint AS priced, min(x) AS min_amount, max(x) AS max_amount, round(avg(x), 4) AS mean_amount, round(median(x), 4) AS median_amount"


def _rounded(df):
    return df.withColumns({c: F.round(c, 4) for c in ("mean_amount", "median_amount")})


@query(f"WITH {NOTICES_SQL} SELECT split_part(path, '.', 1) AS agency, {_SUMMARY} FROM (SELECT *, CASE WHEN type = 'a' THEN amount END AS x FROM notices) GROUP BY 1")
def award_summary_by_agency(spark, d):
    awards = notices(spark, d).select(agency(F.col("path")).alias("agency"), F.when(F.col("type") == "a", F.col("amount")).alias("amount"))
    return _rounded(P.price_summary(stored(awards, "awards"), ["agency"]))


@query(f"SELECT {_SUMMARY} FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS x FROM orders)")
def award_summary(spark, d):
    return _rounded(P.price_summary(table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("amount")), []))


@query("""WITH x AS (SELECT o_totalprice AS v FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT min(v) AS lo, max(v) AS hi FROM x), e AS (SELECT unnest(range(1, 9)) AS i)
SELECT i::int AS bin, round(lo + (hi - lo) * (i - 1) / 8, 4) AS lo, round(CASE WHEN i = 8 THEN hi ELSE lo + (hi - lo) * i / 8 END, 4) AS hi,
  (SELECT count(*) FROM x WHERE (i = 1 OR v > lo + (hi - lo) * (i - 1) / 8) AND (i = 8 OR v <= lo + (hi - lo) * i / 8))::bigint AS n FROM e, b""")
def award_histogram(spark, d):
    h = P.price_histogram(table(spark, d, "orders").where("o_orderstatus = 'F'"), "o_totalprice")
    return h.select("bin", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "n")


@query("SELECT o_orderkey, x AS amount, row_number() OVER (ORDER BY x DESC NULLS LAST, o_orderkey)::int AS rank FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice END AS x FROM orders) ORDER BY rank LIMIT 100")
def award_rank_nulls_last(spark, d):
    from pyspark.sql import Window

    awards = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).alias("amount"))
    top = P.ranked_awards(awards, "o_orderkey")
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("amount").desc_nulls_last(), "o_orderkey")))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN round(o_totalprice, 2) WHEN 1 THEN NULL WHEN 2 THEN 1000.0 WHEN 3 THEN -round(o_totalprice, 2) END AS amount FROM orders")
def currency_parse(spark, d):
    k, x = F.col("o_orderkey") % 4, F.format_number("o_totalprice", 2)
    raw = F.when(k == 0, F.concat(F.lit(" $"), x)).when(k == 1, "TBD").when(k == 2, "1_000").otherwise(F.concat(F.lit("-"), x))
    return table(spark, d, "orders").select("o_orderkey", currency(raw).alias("amount"))


@query("SELECT s_name AS awardee, count(*)::bigint AS awards, round(sum(l_extendedprice), 2) AS amount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name")
def awardee_totals(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    l = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("awards"), F.sum("l_extendedprice").alias("amount"))
    return l.join(s, l.l_suppkey == s.s_suppkey).select(F.col("s_name").alias("awardee"), "awards", F.round("amount", 2).alias("amount"))
