"""Notices, chunks and prices as people are shown them: table rows, labels, letters, lists in Markdown."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.normalize import agency, days_left, notice_label, office, set_aside_label
from ..functions.text import non_empty
from .records import notice_url


def filled(template: str, **values: Column) -> Column:
    """A fixed text whose names in braces are replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p or i % 2])


def table_rows(notices: DataFrame, as_of: Column) -> DataFrame:
    """The ten columns of a table of notices; what is absent is empty, but for the days left."""
    deadline = F.col("deadline").cast("timestamp")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return notices.select(
        F.coalesce(non_empty(F.col("title")), F.lit("(untitled)")).alias("Title"),
        empty(agency(F.col("path"))).alias("Agency"),
        empty(office(F.col("path"))).alias("Office"),
        empty(F.coalesce(notice_label(F.col("type")), F.col("type"))).alias("Type"),
        empty(set_aside_label(F.col("set_aside"))).alias("Set-Aside"),
        empty(F.col("naics")).alias("NAICS"),
        empty(F.date_format(deadline, "yyyy-MM-dd HH:mm")).alias("Response Deadline"),
        days_left(deadline, as_of).alias("Days Left"),
        F.col("notice_id").alias("Notice ID"),
        notice_url(F.col("link") if "link" in notices.columns else F.lit(None).cast("string"), F.col("notice_id")).alias("Link"),
    )


def notice_text(title: Column, naics: Column, classification: Column, set_aside: Column, path: Column) -> Column:
    """A notice in one line, as it is embedded: what it has of title, industry, classification, set-aside, office and agency."""
    return F.trim(F.concat_ws(" ", non_empty(title), non_empty(naics), non_empty(classification), non_empty(set_aside_label(set_aside)), office(path), agency(path)))


def notice_block(notices: DataFrame) -> DataFrame:
    """notice_id and block, what a writer is told of a notice (title, number, path, naics, set_aside, deadline): a line each, N/A where nothing is known."""
    known = lambda c, other="N/A": F.coalesce(non_empty(c), F.lit(other))
    lines = [
        F.lit("== OPPORTUNITY METADATA =="),
        F.concat(F.lit("Title: "), known(F.col("title"))),
        F.concat(F.lit("Notice ID: "), F.col("notice_id")),
        F.concat(F.lit("Solicitation #: "), known(F.col("number"))),
        F.concat(F.lit("Agency: "), known(agency(F.col("path"))), F.lit(" / Office: "), known(office(F.col("path")))),
        F.concat(F.lit("NAICS: "), known(F.col("naics"))),
        F.concat(F.lit("Set-aside: "), known(set_aside_label(F.col("set_aside")), "None")),
        F.concat(F.lit("Response deadline: "), known(F.date_format("deadline", "yyyy-MM-dd"))),
    ]
    return notices.select("notice_id", F.concat_ws("\n", *lines).alias("block"))


def citation(name: Column, ordinal: Column, section: Column) -> Column:
    """Where a chunk comes from: its document's name, its number from 1 and the section, if it has one."""
    base = F.concat(name, F.lit(" #"), (ordinal + 1).cast("string"))
    return F.when(non_empty(section).isNotNull(), F.concat(base, F.lit(" · "), section)).otherwise(base)


def histogram_labels(histogram: DataFrame) -> DataFrame:
    """bin, label and n of what `price_histogram` counts. The first bin's label begins a thousandth of the whole range lower, so that it holds the
    least amount; a single bin is labelled by its amount. Edges are cut to whole numbers."""
    span = histogram.agg(F.min("lo").alias("least"), F.max("hi").alias("most"))
    money = lambda x: F.concat(F.when(x < 0, F.lit("$-")).otherwise("$"), F.format_number(F.abs(x), 0))
    whole = lambda x: x.cast("double").cast("long")
    left = F.when(F.col("bin") == 1, F.round(F.col("lo") - (F.col("most") - F.col("least")) * 0.001, 3)).otherwise(F.col("lo"))
    label = F.when(F.col("least") == F.col("most"), money(F.round("lo", 0).cast("long"))).otherwise(F.concat(money(whole(left)), F.lit("–"), money(whole(F.col("hi")))))
    return histogram.crossJoin(F.broadcast(span)).select("bin", label.alias("label"), "n")  # one row beside a few


def letters(notices: DataFrame, profile: dict[str, str]) -> DataFrame:
    """notice_id, to_name, to_email, subject, body and sources of a letter for each notice (title, number, path, naics, deadline, contact_name,
    contact_email). profile: company, sender, sender_title, email, phone, capabilities."""
    c, lit = F.col, {k: F.lit(profile[k]) for k in ("company", "sender", "sender_title", "email", "phone", "capabilities")}
    ref = F.coalesce(non_empty(c("number")), c("notice_id"))
    naics = F.when(non_empty(c("naics")).isNotNull(), F.concat(F.lit(" (NAICS "), c("naics"), F.lit(")"))).otherwise("")
    deadline = F.when(c("deadline").isNotNull(), filled(V.LETTER_DEADLINE, day=F.date_format("deadline", "MMMM dd, yyyy"))).otherwise("")
    name = F.coalesce(non_empty(c("contact_name")), F.lit("Contracting Officer"))
    who = F.coalesce(agency(c("path")), F.lit("your agency"))
    body = filled(V.LETTER, name=name, opportunity=F.coalesce(non_empty(c("title")), ref), ref=ref, agency=who, naics=naics, deadline=deadline, **lit)
    subject = filled(V.LETTER_SUBJECT, title=F.coalesce(non_empty(c("title")), F.lit("your recent opportunity")), ref=ref)
    said = V.LETTER_SOURCES
    sources = F.array(F.lit(said["always"]), F.when(non_empty(c("naics")).isNotNull(), said["naics"]), F.when(c("deadline").isNotNull(), said["deadline"]), F.when(non_empty(c("contact_name")).isNotNull(), said["contact"]))
    return notices.select("notice_id", non_empty(c("contact_name")).alias("to_name"), non_empty(c("contact_email")).alias("to_email"), subject.alias("subject"), body.alias("body"), F.filter(sources, lambda s: s.isNotNull()).alias("sources"))


def checklist_markdown(items: DataFrame, notices: DataFrame) -> DataFrame:
    """notice_id and markdown of each notice's checklist (notice_id, position, action, detail, due, source), a list with boxes to tick."""
    due = F.when(non_empty(F.col("due")).isNotNull(), F.concat(F.lit(" (due "), F.col("due"), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- [ ] **"), "action", F.lit("**"), due, F.lit("\n  - "), "detail", F.lit("\n  - _source: "), "source", F.lit("_"))
    lists = items.groupBy(F.col("notice_id").alias("i_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    head = F.concat(F.lit("# Action checklist — "), F.coalesce(non_empty(F.col("title")), F.col("notice_id")), F.lit("\n\n- Notice ID: "), "notice_id", F.lit("\n- SAM.gov: "), notice_url(F.lit(None).cast("string"), F.col("notice_id")), F.lit("\n"))
    joined = notices.join(lists, notices["notice_id"] == lists["i_id"], "left")
    return joined.select("notice_id", F.concat_ws("\n", head, "lines").alias("markdown"))
