"""Searching notices: filters become one predicate, pages a sorted slice."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import agency


@dataclass(frozen=True)
class Filters:
    """What a notice must match; an absent part matches all. Dates are inclusive and at most a year apart."""

    keyword: str | None = None
    naics: tuple[str, ...] = field(default=())
    set_asides: tuple[str, ...] = field(default=())
    types: tuple[str, ...] = field(default=())
    department: str | None = None
    posted_from: date | None = None
    posted_to: date | None = None
    limit: int = 25
    offset: int = 0

    def __post_init__(self):
        for name in ("naics", "set_asides", "types"):
            object.__setattr__(self, name, tuple(x.strip() for x in getattr(self, name) if x and x.strip()))
        if not 1 <= self.limit <= 1000 or self.offset < 0:
            raise ValueError("limit must be 1 to 1000 and offset 0 or more")
        if self.posted_from and self.posted_to and not 0 <= (self.posted_to - self.posted_from).days <= 365:
            raise ValueError("posted_to must be 0 to 365 days after posted_from")

    def predicate(self) -> Column:
        parts = []
        if self.keyword:
            parts.append(F.lower("title").contains(self.keyword.lower()))
        for name, values in (("naics", self.naics), ("set_aside", self.set_asides), ("type", self.types)):
            if values:
                parts.append(F.col(name).isin(*values))
        if self.department:
            parts.append(F.lower(agency(F.col("path"))).contains(self.department.lower()))
        if self.posted_from:
            parts.append(F.col("posted") >= F.lit(self.posted_from))
        if self.posted_to:
            parts.append(F.col("posted") <= F.lit(self.posted_to))
        return reduce(and_, parts, F.lit(True))


    def parameters(self) -> dict[str, str]:
        """What a service is asked for: values that are absent are left out, dates are MM/dd/yyyy, several values are joined by commas."""
        named = {"postedFrom": self.posted_from and self.posted_from.strftime("%m/%d/%Y"), "postedTo": self.posted_to and self.posted_to.strftime("%m/%d/%Y"), "title": self.keyword, "deptname": self.department}
        several = {"ncode": self.naics, "typeOfSetAside": self.set_asides, "ptype": self.types}
        return {"limit": str(self.limit), "offset": str(self.offset)} | {k: v for k, v in named.items() if v} | {k: ",".join(v) for k, v in several.items() if v}


def page(notices: DataFrame, filters: Filters, order: list) -> DataFrame:
    """One page of the matching notices: a top-k, not a sort of them all."""
    return notices.where(filters.predicate()).orderBy(*order).offset(filters.offset).limit(filters.limit)


def pages(notices: DataFrame, filters: Filters, order: list, most: int = 200, page_size: int = 100) -> DataFrame:
    """The first `most` matching notices with their page's number, from 0."""
    first = notices.where(filters.predicate()).orderBy(*order).limit(most)
    return first.withColumn("page", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / page_size).cast("int"))


def within(day: Column, first: Column, last: Column) -> Column:
    """Whether a day lies in a window; undated rows do."""
    return day.isNull() | day.between(first, last)


def has_all_terms(text: Column, query: Column) -> Column:
    """Whether every word of the query occurs in the text, regardless of case."""
    low = F.lower(text)
    return F.forall(F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""), lambda w: low.contains(w))


def first_seen(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key by arrival."""
    return df.withColumn("_seen", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_seen = 1").drop("_seen")


#: Rows of a range of numbered_by, about.
BUCKET = 50_000


def numbered_by(df: DataFrame, group: str, key: str, out: str, bucket: int = BUCKET) -> DataFrame:
    """df with `out`: 1, 2, ... within each group by a whole-number key that no two of its rows share. A group of more than `bucket` rows is
    cut into ranges of the key that hold about as many rows each, however sparse the key is; ranges are numbered by themselves and
    shifted by the rows of the ranges before, so that no task holds a whole group. df is read several times."""
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    ranges = -(-most // bucket)
    large = sizes.where(F.col("_n") > bucket).select("_g")  # no more than rows / bucket
    at = [i / ranges for i in range(1, ranges)] or [0.0]
    cuts = df.join(large, F.col(group).eqNullSafe(F.col("_g")), "left_semi").groupBy(F.col(group).alias("_g")).agg(F.percentile_approx(key, at, 100 * max(ranges, 1)).alias("_cuts"))
    cut = df.join(cuts, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    cut = cut.withColumn("_bucket", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(key))), F.lit(0))).drop("_cuts")
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(F.col(group).alias("_g"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    shifts = counts.select("_g", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    rows = cut.withColumn("_at", F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(key)))
    joined = rows.join(shifts, rows[group].eqNullSafe(shifts["_g"]) & (rows["_bucket"] == shifts["_b"]))
    return joined.withColumn(out, (F.col("_shift") + F.col("_at")).cast("int")).drop("_bucket", "_at", "_g", "_b", "_shift")


def overlaid(latest: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Latest rows, and pooled ones that the latest do not have."""
    return latest.unionByName(pool.join(latest.select(key), key, "left_anti"), allowMissingColumns=True)
