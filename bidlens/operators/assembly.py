"""Documents put together from blocks: title page, contents, tabs with their sections, appendices; and what a writer is given for a section.

A block has a path, an array of numbers by which the blocks of a document are ordered, so that any step can add blocks where they
belong. Nothing but a document's own few blocks is gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import company_line, non_empty, titled_lines

#: Characters of evidence that a section's context takes.
CONTEXT_CHARS = 12_000
_ORIGINS = ("solicitation", "style_exemplar", "knowledge_base")
_HEADS = ("== Requirements of the solicitation ==", "== How the company writes (form only) ==", "== What the company can show (where it applies) ==")
NOTHING = "(Nothing was found to rely on.)"


def numbered_titles(template: Column, word: str, default: list[tuple[str, str]]) -> Column:
    """array<struct<number, title>> of the lines `<word> N title` of a template's text; the default ones where it has none."""
    found = titled_lines(template, word)
    usual = F.array(*[F.struct(F.lit(n).alias("number"), F.lit(t).alias("title")) for n, t in default])
    return F.when(F.size(found) > 0, found).otherwise(usual)


def title_page(notice: dict[str, Column], template: Column) -> Column:
    """The title page of a notice (title, number, notice_id, agency, office), in the name of the company that the template's first lines name."""
    to = F.coalesce(non_empty(notice["agency"]), non_empty(notice["office"]), F.lit("Contracting Officer"))
    subject = F.coalesce(non_empty(notice["title"]), F.lit("Technical Proposal"))
    lines = [company_line(template), *map(F.lit, ("", "Title Page", "", "Volume 1", "", "Technical Proposal", "")), F.concat(F.lit("To: "), to), F.concat(F.lit("Subj: "), subject)]
    return F.concat_ws("\n", *lines, F.concat(F.lit("Ref: "), F.coalesce(non_empty(notice["number"]), notice["notice_id"])), F.lit(""), F.lit(V.RESTRICTION))


def contents(tabs: Column, appendices: Column) -> Column:
    """A table of contents."""
    listed = lambda word, items: F.transform(items, lambda x: F.concat(F.lit(f"{word} "), x["number"], F.lit(" "), x["title"]))
    return F.array_join(F.concat(F.array(F.lit("Table of Contents"), F.lit("")), listed("Tab", tabs), F.array(F.lit("")), listed("Appendix", appendices)), "\n")


def front_blocks(notices: DataFrame) -> DataFrame:
    """document, path and text of the title page and contents of notices with a template's text (template, null where there is none)."""
    tabs = numbered_titles(F.col("template"), "Tab", V.TABS)
    appendices = numbered_titles(F.col("template"), "Appendix", V.APPENDICES)
    page = title_page({c: F.col(c) for c in ("title", "number", "notice_id", "agency", "office")}, F.col("template"))
    blocks = F.array(F.struct(F.array(F.lit(0), F.lit(0)).alias("path"), page.alias("text")), F.struct(F.array(F.lit(1), F.lit(0)).alias("path"), contents(tabs, appendices).alias("text")))
    return notices.select(F.col("notice_id").alias("document"), F.explode(blocks).alias("b")).select("document", "b.path", "b.text")


def tab_blocks(notices: DataFrame, sections: DataFrame) -> DataFrame:
    """document, path and text of the tabs, each with the sections (document, tab, place, title, content) that go there, and the appendices.
    A tab without sections is its heading alone; sections of a tab that the volume does not have follow its tabs."""
    of = notices.select(F.col("notice_id").alias("document"), numbered_titles(F.col("template"), "Tab", V.TABS).alias("tabs"), numbered_titles(F.col("template"), "Appendix", V.APPENDICES).alias("appendices"))
    tabs = of.select("document", F.posexplode("tabs").alias("i", "t")).select("document", (F.col("i") + 2).alias("i"), F.col("t.number").alias("number"), F.col("t.title").alias("title"))
    heads = tabs.select("document", F.array("i", F.lit(0)).alias("path"), F.concat(F.lit("# Tab "), "number", F.lit(" "), "title").alias("text"))
    first = tabs.groupBy("document", "number").agg(F.min("i").alias("i"))
    own = sections.join(first, (sections["document"] == first["document"]) & (sections["tab"] == first["number"]), "left").drop(first["document"])
    body = own.select("document", F.array(F.coalesce("i", F.lit(1_000_000)), F.col("place")).alias("path"), F.concat(F.lit("## "), "title", F.lit("\n\n"), F.trim("content")).alias("text"))
    ends = of.select("document", F.posexplode("appendices").alias("i", "a")).select("document", F.array(F.lit(2_000_000), F.col("i")).alias("path"), F.concat(F.lit("# Appendix "), "a.number", F.lit(" "), "a.title").alias("text"))
    return heads.unionByName(body).unionByName(ends)


def assembled(blocks: DataFrame) -> DataFrame:
    """document, n_blocks and text of the blocks (document, path, text) in the order of their paths, a blank line between two."""
    every = blocks.where("text IS NOT NULL").groupBy("document").agg(F.sort_array(F.collect_list(F.struct("path", "text"))).alias("b"))
    return every.select("document", F.size("b").alias("n_blocks"), F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("text"))


def within_budget(evidence: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """The evidence (no, origin, label, snippet, rank) that a section's context has room for: origins in their order, then ranks, as long
    as the running sum of label and snippet stays within the budget. Every piece takes a character at least, so no more than
    `budget` pieces of a section are ever looked at together."""
    origin = F.array_position(F.array(*map(F.lit, _ORIGINS)), F.col("origin"))
    order = Window.partitionBy("no").orderBy("_origin", "rank", "label")
    size = F.greatest(F.length("label") + F.length("snippet"), F.lit(1))
    first = evidence.withColumn("_origin", origin).withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= budget)
    return first.withColumn("_sum", F.sum(size).over(order)).where(F.col("_sum") <= budget).drop("_origin", "_at", "_sum")


def contexts(sections: DataFrame, evidence: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """no and context of each section (no): the evidence it has room for under a head for each origin, or that there is none. The heads are an
    own template."""
    origin = F.array_position(F.array(*map(F.lit, _ORIGINS)), F.col("origin")) - 1
    line = F.concat(F.lit("["), "label", F.lit("]\n"), "snippet")
    kept = within_budget(evidence, budget).groupBy("no").agg(F.sort_array(F.collect_list(F.struct(origin.alias("o"), "rank", "label", line.alias("line")))).alias("e"))
    block = lambda o: F.filter("e", lambda x: x["o"] == o)
    part = lambda o: F.when(F.size(block(o)) > 0, F.array_join(F.concat(F.array(F.lit(_HEADS[o])), F.transform(block(o), lambda x: x["line"])), "\n\n"))
    return sections.select("no").join(kept, "no", "left").select("no", F.coalesce(non_empty(F.concat_ws("\n\n", *[part(o) for o in range(len(_ORIGINS))])), F.lit(NOTHING)).alias("context"))
