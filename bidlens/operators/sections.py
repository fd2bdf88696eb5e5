"""Sections of drafts as what happened to them: each event replaces a section or appends it, and feedback is kept in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVENTS = "draft_id string, seq long, section_id string, title string, content string, feedback string"


def current_sections(events: DataFrame) -> DataFrame:
    """draft_id, place, section_id, title, content, feedback and revisions of each section after all EVENTS.

    An event with a title or content replaces the section's; what it does not have stays. A section stands where its first event
    put it. Feedback is a list in the order of events, its texts with what was changed after them. Events without a section do nothing."""
    own = events.where(F.col("section_id").isNotNull())
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    told = F.when(F.col("feedback").isNotNull(), F.struct("seq", "feedback"))
    each = own.groupBy("draft_id", "section_id").agg(F.min("seq").alias("first"), last("title"), last("content"), F.sort_array(F.collect_list(told)).alias("f"), F.count("content").alias("revisions"))
    place = F.row_number().over(Window.partitionBy("draft_id").orderBy("first", "section_id"))
    return each.select("draft_id", place.alias("place"), "section_id", "title", "content", F.transform("f", lambda x: x["feedback"]).alias("feedback"), "revisions")


def section(sections: DataFrame, section_id: str) -> DataFrame:
    """The section of this id in each draft that has it."""
    return sections.where(F.col("section_id") == section_id)
