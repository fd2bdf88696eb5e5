"""Responses that are kept: a cache that is written to, and requests that go to it first.

The cache is a folder of Parquet files partitioned by a hash of the key. To set or to invalidate a key appends a row; the last row of a
key counts. Compaction rewrites the buckets that hold more than their last rows, each as one partition that Spark overwrites.
One writer at a time: rows that are appended to a bucket while it is compacted can be lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import is_fresh
from ..storage import deleted, listed, stored
from .store import latest

SCHEMA = "key string, created double, seq long, ttl int, payload string, gone boolean, bucket int"
#: Seconds that a response may be used, where nothing else is said.
TTL = 43_200


@dataclass(frozen=True)
class Cache:
    spark: SparkSession
    path: str
    buckets: int = 64

    def _append(self, rows: DataFrame) -> None:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")).select(*columns)
        dealt.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)

    def set(self, rows: DataFrame) -> None:
        """Adds responses (key, created, seq, payload and, if they have one, ttl). seq orders rows of one moment."""
        ttl = F.coalesce(F.col("ttl").cast("int"), F.lit(TTL)) if "ttl" in rows.columns else F.lit(TTL)
        self._append(rows.withColumns({"ttl": ttl, "gone": F.lit(False)}))

    def invalidate(self, keys: DataFrame) -> None:
        """Takes keys (key, created, seq) out."""
        self._append(keys.withColumns({"ttl": F.lit(0), "payload": F.lit(None).cast("string"), "gone": F.lit(True)}))

    def rows(self) -> DataFrame:
        """All rows that were written and not compacted away."""
        if not listed(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def last(self) -> DataFrame:
        """The last row of each key that is still there."""
        return latest(self.rows(), ["key"], [F.desc("created"), F.desc("seq")]).where(~F.col("gone"))

    def get(self, now: Column, ttl: Column | None = None, *, keys: DataFrame | None = None) -> DataFrame:
        """The responses that may be used now, of all keys or of these; a caller's ttl goes before the stored one."""
        rows = self.rows() if keys is None else self.rows().join(keys.select("key").distinct(), "key", "left_semi")
        last = latest(rows, ["key"], [F.desc("created"), F.desc("seq")]).where(~F.col("gone"))
        return last.where(is_fresh(F.col("created"), F.col("ttl") if ttl is None else ttl, now))

    def compact(self) -> list[int]:
        """Rewrites the buckets that hold rows which no longer count; their numbers."""
        per_key = self.rows().groupBy("bucket", "key").agg(F.count("*").alias("n"), F.bool_or("gone").alias("gone"))
        stale = sorted(r.bucket for r in per_key.where((F.col("n") > 1) | F.col("gone")).select("bucket").distinct().collect())
        if not stale:
            return []
        kept = self.last().where(F.col("bucket").isin(stale))
        full = {r.bucket for r in kept.select("bucket").distinct().collect()}
        kept.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for b in stale:  # a bucket without rows is not overwritten
            if b not in full:
                deleted(self.spark, f"{self.path}/bucket={b}")
        return stale

    def clear(self) -> int:
        """Takes everything out; the number of keys that were there."""
        n = self.last().count()
        deleted(self.spark, self.path)
        return n


def fetched(requests: DataFrame, cache: Cache, source: DataFrame, *, now: float, left: int, ttl: int | None = None, refresh: bool = False, network: bool = True, signed: bool = True) -> DataFrame:
    """requests (key, seq) with payload and status. Those that the cache can answer are `cached`; of the others the first `left` keys by
    seq are `live`: their payload is taken from `source` (key, payload), or is `not_found`, and set in the cache. The rest are
    `over_budget`; without a network all are `offline`, and without a key `unsigned`. `refresh` does not look at the cache first.

    `left` is what remains of the day's budget, the only rows that are numbered in one place. The caller records as many
    requests as there are distinct keys with status live or not_found."""
    spark = requests.sparkSession
    at = F.lit(float(now))
    hits = cache.get(at, None if ttl is None else F.lit(ttl), keys=requests).select(F.col("key").alias("h_key"), F.col("payload").alias("h_payload"))
    if refresh:
        hits = hits.limit(0)
    asked = requests.join(hits, requests["key"] == hits["h_key"], "left")
    told = "offline" if not network else "unsigned" if not signed else "over_budget"
    misses = asked.where("h_key IS NULL").groupBy("key").agg(F.min("seq").alias("first"))
    going = misses.orderBy("first", "key").limit(left if told == "over_budget" else 0)
    rows = [(r.key, r.first) for r in going.collect()]  # at most what is left of a day's budget
    going = spark.createDataFrame(rows, "l_key string, l_seq long")
    live = source.join(F.broadcast(going), source["key"] == going["l_key"]).select("l_key", "l_seq", F.col("payload").alias("l_payload"))
    answered = latest(live, ["l_key"], ["l_payload"])
    sent = going.select(F.col("l_key").alias("s_key"))
    out = asked.join(F.broadcast(answered), asked["key"] == answered["l_key"], "left").join(F.broadcast(sent), asked["key"] == sent["s_key"], "left")
    status = F.when(F.col("h_key").isNotNull(), "cached").when(F.col("l_key").isNotNull(), "live").when(F.col("s_key").isNotNull(), "not_found").otherwise(told)
    done = stored(out.select(*requests.columns, F.coalesce("h_payload", "l_payload").alias("payload"), status.alias("status")), "fetched")
    if rows:
        new = done.where("status = 'live'").groupBy("key").agg(F.min("seq").alias("seq"), F.min("payload").alias("payload"))
        cache.set(new.withColumns({"created": at, "ttl": F.lit(TTL if ttl is None else ttl)}))
    return done
