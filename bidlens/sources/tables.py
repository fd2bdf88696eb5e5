"""The benchmark tables as notices, awards, documents and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df over as many tasks as a shuffle has. A row group is read by one task, however long its texts are and whatever is done to them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A notice per order: its customer as title and last office, region and nation above it, its total as the award."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    places = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(places, c.c_nationkey == places.n_nationkey)
    return joined.select(
        F.col("o_orderkey").cast("string").alias("notice_id"),
        F.col("o_orderkey").alias("notice_no"),
        F.col("c_name").alias("title"),
        F.concat_ws(".", "r_name", "n_name", "c_name").alias("path"),
        F.col("o_orderdate").cast("date").alias("posted"),
        F.date_add(F.col("o_orderdate").cast("date"), 30).alias("deadline"),
        F.col("c_mktsegment").alias("naics"),
        F.col("o_orderpriority").alias("set_aside"),
        F.when(F.col("o_orderstatus") == "F", "a").when(F.col("o_orderstatus") == "O", "o").otherwise("k").alias("type"),
        F.col("o_totalprice").alias("amount"),
    )


#: The same in SQL, for oracles.
NOTICES_SQL = """notices AS (
SELECT o_orderkey::varchar AS notice_id, o_orderkey AS notice_no, c_name AS title, r_name || '.' || n_name || '.' || c_name AS path,
       o_orderdate::date AS posted, (o_orderdate::date + 30)::date AS deadline, c_mktsegment AS naics, o_orderpriority AS set_aside,
       CASE o_orderstatus WHEN 'F' THEN 'a' WHEN 'O' THEN 'o' ELSE 'k' END AS type, o_totalprice AS amount
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document library: name, category and the rest of an uploaded document."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("category"), "lang", "text")


LIBRARY_SQL = "library AS (SELECT doc_id, 'doc_' || doc_id AS name, source AS category, lang, text FROM documents)"
