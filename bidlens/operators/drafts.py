"""Saved drafts as JSON lines: each save, update and deletion appends a line, and a draft's last line counts.

A line that is no JSON of a draft is kept apart by Spark as corrupt and leaves the draft as the lines before it have it; a draft
that has corrupt lines alone is null. Changes come as tables, one row a draft.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import listed
from .store import latest

DRAFT = "draft_id string, name string, notice_id string, title string, content string, version int, modified string, gone boolean"
_CORRUPT = "corrupt"
_COLUMNS = [c.split()[0] for c in DRAFT.split(", ")]
UNTITLED = "Untitled draft"


@dataclass(frozen=True)
class Drafts:
    spark: SparkSession
    path: str

    def _append(self, rows: DataFrame) -> None:
        rows.select(*_COLUMNS).write.mode("append").json(self.path)

    def lines(self) -> DataFrame:
        """All lines that were written, with the text of those that are corrupt."""
        schema = f"{DRAFT}, {_CORRUPT} string"
        if not listed(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT).json(self.path)

    def current(self) -> DataFrame:
        """Each draft that is still there, as its last sound line has it."""
        sound = self.lines().where(f"{_CORRUPT} IS NULL AND draft_id IS NOT NULL AND version IS NOT NULL").drop(_CORRUPT)
        return latest(sound, ["draft_id"], [F.desc("version"), F.desc("modified")]).where(~F.coalesce("gone", F.lit(False))).drop("gone")

    def save(self, rows: DataFrame, now: str) -> None:
        """New drafts (draft_id, name, notice_id, title, content) of version 1. A name without letters is replaced."""
        name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit(UNTITLED))
        self._append(rows.withColumns({"name": name, "version": F.lit(1), "modified": F.lit(now), "gone": F.lit(False)}))

    def update(self, changes: DataFrame, now: str) -> DataFrame:
        """Changed drafts (draft_id, title, content) in their next version; what was written. Drafts that are not there stay away."""
        new = changes.select("draft_id", F.col("title").alias("n_title"), F.col("content").alias("n_content"))
        merged = self.current().join(new, "draft_id").withColumns({"title": F.col("n_title"), "content": F.col("n_content"), "version": F.col("version") + 1, "modified": F.lit(now), "gone": F.lit(False)})
        self._append(merged)
        return self.current().join(new.select("draft_id"), "draft_id", "left_semi")

    def delete(self, ids: DataFrame, now: str) -> None:
        """Takes drafts (draft_id) out; those that are not there stay away."""
        ended = self.current().join(ids.select("draft_id").distinct(), "draft_id", "left_semi")
        self._append(ended.withColumns({"version": F.col("version") + 1, "modified": F.lit(now), "gone": F.lit(True)}))

    def listing(self, notice_id: str | None = None) -> DataFrame:
        """The drafts of a notice, or all, the last modified first."""
        rows = self.current() if notice_id is None else self.current().where(F.col("notice_id") == notice_id)
        return rows.orderBy(F.desc("modified"), F.desc("version"), "draft_id")
