"""Queries over documents that are put together: volumes with their front matter and tabs, contexts within a budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import vocabulary as V
from ..operators import assembly as A
from ..registry import query
from ..sources.tables import NOTICES_SQL, notices, table


def _volumes(spark, d):
    """Notices with the text of a template: every third has tabs of its own, one of them named twice."""
    n = notices(spark, d)
    own = F.concat(F.col("title"), F.lit(" LLC\nTab 1  "), "naics", F.lit("\ntab 2 "), "set_aside", F.lit(" \nTab 1  "), "naics", F.lit("\nAppendix 1 Files\nTabs 3 none"))
    return n.select("notice_id", "title", F.lit("").alias("number"), N.agency(F.col("path")).alias("agency"), N.office(F.col("path")).alias("office"), F.when(F.col("notice_no") % 3 == 0, own).alias("template"))


def _sections(spark, d):
    """Two sections a notice: for its first tab, and for one that only the usual tabs have."""
    n = notices(spark, d)
    two = F.array(F.struct(F.lit("1").alias("tab"), F.lit(1).alias("place"), F.lit("Summary").alias("title"), F.col("naics").alias("content")), F.struct(F.lit("5").alias("tab"), F.lit(2).alias("place"), F.lit("Past").alias("title"), F.lit(" done ").alias("content")))
    return n.select(F.col("notice_id").alias("document"), F.explode(two).alias("s")).select("document", "s.*")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TABS = "[" + ", ".join(_q(f"# Tab {n} {t}") for n, t in V.TABS) + "]"
_NL = "chr(10)"


def _listed(word, items):
    return " || chr(10) || ".join(_q(f"{word} {n} {t}") for n, t in items)


@query(f"""WITH {NOTICES_SQL}, x AS (SELECT *, notice_no % 3 = 0 AS own FROM notices),
b AS (SELECT notice_id, own, CASE WHEN own THEN title || ' LLC' ELSE 'The Offeror' END || {" || ".join([_NL] * 2)} || 'Title Page' || {" || ".join([_NL] * 2)} || 'Volume 1' || {" || ".join([_NL] * 2)} || 'Technical Proposal' || {" || ".join([_NL] * 2)} || 'To: ' || split_part(path, '.', 1) || {_NL} || 'Subj: ' || title || {_NL} || 'Ref: ' || notice_id || {" || ".join([_NL] * 2)} || {_q(V.RESTRICTION)} AS page,
'Table of Contents' || {" || ".join([_NL] * 2)} || CASE WHEN own THEN 'Tab 1 ' || naics || {_NL} || 'Tab 2 ' || set_aside || {" || ".join([_NL] * 2)} || 'Appendix 1 Files' ELSE {_listed("Tab", V.TABS)} || {" || ".join([_NL] * 2)} || {_listed("Appendix", V.APPENDICES)} END AS toc,
'## Summary' || {" || ".join([_NL] * 2)} || naics AS s1, '## Past' || {" || ".join([_NL] * 2)} || 'done' AS s2, naics, set_aside FROM x),
l AS (SELECT notice_id, CASE WHEN own THEN [page, toc, '# Tab 1 ' || naics, s1, '# Tab 2 ' || set_aside, s2, '# Appendix 1 Files']
ELSE list_concat([page, toc], list_concat({_TABS}[1:1], list_concat([s1], list_concat({_TABS}[2:5], list_concat([s2], list_concat({_TABS}[6:6], [{", ".join(_q(f"# Appendix {n} {t}") for n, t in V.APPENDICES)}])))))) END AS blocks FROM b)
SELECT notice_id AS document, len(blocks)::int AS n_blocks, sha256(array_to_string(blocks, {_NL} || {_NL})) AS sha FROM l""")
def volumes_assembled(spark, d):
    """A volume for each notice: title page, contents, tabs with their sections, appendices."""
    n = _volumes(spark, d)
    out = A.assembled(A.front_blocks(n).unionByName(A.tab_blocks(n, _sections(spark, d))))
    return out.select("document", "n_blocks", F.sha2("text", 256).alias("sha"))


@query(f"""WITH e AS (SELECT conv_id AS no, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS o, turn AS rank, 'turn ' || lpad(turn::varchar, 5, '0') AS label, substr(text, 1, 200) AS snippet FROM conversations),
s AS (SELECT *, sum(length(label) + length(snippet)) OVER (PARTITION BY no ORDER BY o, rank, label ROWS UNBOUNDED PRECEDING) AS total FROM e),
k AS (SELECT no, o, string_agg('[' || label || ']' || {_NL} || snippet, {_NL} || {_NL} ORDER BY rank, label) AS t FROM s WHERE total <= 500 GROUP BY no, o),
g AS (SELECT no, string_agg(CASE o WHEN 0 THEN {_q(A._HEADS[0])} WHEN 1 THEN {_q(A._HEADS[1])} ELSE {_q(A._HEADS[2])} END || {_NL} || {_NL} || t, {_NL} || {_NL} ORDER BY o) AS c FROM k GROUP BY no)
SELECT no, coalesce(c, {_q(A.NOTHING)}) AS context FROM (SELECT DISTINCT conv_id AS no FROM conversations) LEFT JOIN g USING (no)""")
def contexts_budgeted(spark, d):
    """Turns of a conversation as evidence of three origins, within 500 characters a conversation."""
    c = table(spark, d, "conversations")
    origin = F.when(F.col("role") == "user", "solicitation").when(F.col("role") == "assistant", "style_exemplar").otherwise("knowledge_base")
    evidence = c.select(F.col("conv_id").alias("no"), origin.alias("origin"), F.concat(F.lit("turn "), F.lpad(F.col("turn").cast("string"), 5, "0")).alias("label"), F.substring("text", 1, 200).alias("snippet"), F.col("turn").alias("rank"))
    return A.contexts(c.select(F.col("conv_id").alias("no")).distinct(), evidence, 500)
