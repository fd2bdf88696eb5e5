"""A table that is saved whole, version by version: each save is a folder of its own, and a reader takes the newest that is complete.

Complete is what Spark has marked with its _SUCCESS file, so a writer that fails leaves the version before it in place, and a reader
that has begun keeps the folder that it began with. Two writers at once make two versions; that of the larger name is the newer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..storage import deleted, exists, listed


def versions(spark: SparkSession, root: str, *, complete: bool = True) -> list[str]:
    """The names of the versions, the oldest first; also of those that are not complete, if asked for."""
    names = [n for n in listed(spark, root) if n.startswith("v")]
    return [n for n in names if not complete or exists(spark, f"{root}/{n}/_SUCCESS")]


def saved(df: DataFrame, root: str) -> str:
    """Writes a new version; its name."""
    spark = df.sparkSession
    last = max((int(n[1:13]) for n in versions(spark, root, complete=False)), default=0)
    name = f"v{last + 1:012d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{root}/{name}")
    return name


def loaded(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The newest complete version, or the one asked for."""
    found = versions(spark, root)
    if not found or (version and version not in found):
        raise FileNotFoundError(f"no complete version {version or ''} in {root}")
    return spark.read.parquet(f"{root}/{version or found[-1]}")


def pruned(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Deletes all versions older than the last `keep` complete ones; their names. Newer ones may still be being written."""
    if keep < 1:
        raise ValueError("keep at least one version")
    oldest = versions(spark, root)[-keep:][:1]
    gone = [n for n in versions(spark, root, complete=False) if oldest and n < oldest[0]]
    for n in gone:
        deleted(spark, f"{root}/{n}")
    return gone
