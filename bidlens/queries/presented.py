"""Queries over what people are shown of notices, chunks and prices."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import vocabulary as V
from ..operators import embedding as E
from ..operators import presented as P
from ..operators import pricing
from ..operators import search as S
from ..operators.checklist import checklist
from ..operators.records import NOTICE_URL
from ..registry import query
from ..sources.tables import LIBRARY_SQL, NOTICES_SQL, library, notices, table
from .notices import AS_OF, _map
from .retrieval import _BOTH, _nearest

_LINK = NOTICE_URL.replace("{}", "' || notice_id || '")
PROFILE = {"company": "Acme", "sender": "A. Doe", "sender_title": "Director", "email": "a@acme.example", "phone": "555-0100", "capabilities": "pumps"}


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(f"""WITH {NOTICES_SQL}, x AS (SELECT *, notice_no % 5 = 0 AS bare FROM notices)
SELECT CASE WHEN bare THEN '(untitled)' ELSE title END AS "Title", split_part(path, '.', 1) AS "Agency", split_part(path, '.', -1) AS "Office", {_map(V.NOTICE_TYPES, 'type')} AS "Type", set_aside AS "Set-Aside", naics AS "NAICS", CASE WHEN bare THEN '' ELSE strftime(deadline, '%Y-%m-%d %H:%M') END AS "Response Deadline",
CASE WHEN NOT bare THEN floor((epoch(deadline::timestamp) - epoch(TIMESTAMP '{AS_OF}')) / 86400)::bigint END AS "Days Left", notice_id AS "Notice ID", '{_LINK}' AS "Link" FROM x""")
def notice_table(spark, d):
    """All ten columns; every fifth notice has no title and no deadline."""
    bare = F.col("notice_no") % 5 == 0
    n = notices(spark, d).withColumns({"title": F.when(bare, "").otherwise(F.col("title")), "deadline": F.when(~bare, F.col("deadline"))})
    return P.table_rows(n, F.lit(AS_OF).cast("timestamp"))


@query(f"WITH {NOTICES_SQL} SELECT notice_id, '25' AS lim, '01/01/1997' AS posted_from, 'BUILDING' AS ncode, 'asi' AS deptname FROM notices WHERE contains(lower(split_part(path, '.', 1)), 'asi') AND naics = 'BUILDING' AND posted BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'")
def department_search(spark, d):
    """Notices of a department, beside the parameters that a service would be asked with."""
    f = S.Filters(naics=("BUILDING",), department="ASI", posted_from=date(1997, 1, 1), posted_to=date(1997, 6, 30))
    p = f.parameters()
    return notices(spark, d).where(f.predicate()).select("notice_id", F.lit(p["limit"]).alias("lim"), F.lit(p["postedFrom"]).alias("posted_from"), F.lit(p["ncode"]).alias("ncode"), F.lower(F.lit(p["deptname"])).alias("deptname"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'N' || o_orderkey WHEN 1 THEN lpad(o_orderkey::varchar, 16, '0') END AS notice_id, CASE o_orderkey % 4 WHEN 2 THEN 'not_a_link' WHEN 3 THEN 'empty' END AS error FROM orders")
def notice_links_strict(spark, d):
    """Pasted links and ids: a link, a long id, a short one, and nothing."""
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" https://x.org/workspace/opp/N"), k.cast("string"), F.lit("/view"))).when(k % 4 == 1, F.lpad(k.cast("string"), 16, "0")).when(k % 4 == 2, k.cast("string")).otherwise("  ")
    return table(spark, d, "orders").select("o_orderkey", N.linked_notice(raw).alias("r")).select("o_orderkey", "r.*")


@query("""WITH x AS (SELECT o_totalprice::double AS v FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT min(v) AS lo, max(v) AS hi FROM x), e AS (SELECT unnest(range(1, 9)) AS i),
h AS (SELECT i, CASE WHEN i = 1 THEN round(lo - (hi - lo) * 0.001, 3) ELSE lo + (hi - lo) * (i - 1) / 8 END AS a, CASE WHEN i = 8 THEN hi ELSE lo + (hi - lo) * i / 8 END AS z, (SELECT count(*) FROM x WHERE (i = 1 OR v > lo + (hi - lo) * (i - 1) / 8) AND (i = 8 OR v <= lo + (hi - lo) * i / 8))::bigint AS n FROM e, b)
SELECT i::int AS bin, '$' || format('{:,}', trunc(a)::bigint) || '–$' || format('{:,}', trunc(z)::bigint) AS label, n FROM h""")
def award_histogram_labels(spark, d):
    return P.histogram_labels(pricing.price_histogram(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_totalprice").cast("double").alias("o_totalprice")), "o_totalprice"))


_LETTER = _sql(V.LETTER.format(name="\x01", sender=PROFILE["sender"], sender_title=PROFILE["sender_title"], company=PROFILE["company"], opportunity="\x02", ref="\x03", agency="\x04", naics="\x05", capabilities=PROFILE["capabilities"], deadline="\x06", email=PROFILE["email"], phone=PROFILE["phone"]))
for _mark, _column in (("\x01", "name"), ("\x02", "title"), ("\x03", "ref"), ("\x04", "agency"), ("\x05", "naics_part"), ("\x06", "deadline_part")):
    _LETTER = _LETTER.replace(_mark, f"' || {_column} || '")


@query(f"""WITH {NOTICES_SQL}, x AS (SELECT notice_id, title, notice_no % 3 = 0 AS bare, CASE WHEN notice_no % 3 = 0 THEN 'Contracting Officer' ELSE split_part(path, '.', 3) END AS name, CASE WHEN notice_no % 2 = 0 THEN 'S-' || notice_no ELSE notice_id END AS ref, split_part(path, '.', 1) AS agency, ' (NAICS ' || naics || ')' AS naics_part, CASE WHEN notice_no % 3 = 0 THEN '' ELSE 'We note the response deadline of ' || strftime(deadline, '%B %d, %Y') || '. ' END AS deadline_part FROM notices)
SELECT notice_id, CASE WHEN NOT bare THEN name END AS to_name, 'Question regarding ' || title || ' (' || ref || ')' AS subject, {_LETTER} AS body, CASE WHEN bare THEN 2 ELSE 4 END::int AS n_sources FROM x""")
def letters_written(spark, d):
    """Letters to contacts; every third notice has neither a contact nor a deadline, every second a number of its own."""
    bare = F.col("notice_no") % 3 == 0
    n = notices(spark, d)
    n = n.withColumns({"number": F.when(F.col("notice_no") % 2 == 0, F.concat(F.lit("S-"), F.col("notice_no").cast("string"))), "contact_name": F.when(~bare, N.office(F.col("path"))), "contact_email": F.lit(None).cast("string"), "deadline": F.when(~bare, F.col("deadline"))})
    return P.letters(n, PROFILE).select("notice_id", "to_name", "subject", "body", F.size("sources").alias("n_sources"))


@query(f"""WITH {NOTICES_SQL} SELECT notice_id, '== OPPORTUNITY METADATA ==' || chr(10) || 'Title: ' || title || chr(10) || 'Notice ID: ' || notice_id || chr(10) || 'Solicitation #: N/A' || chr(10) || 'Agency: ' || split_part(path, '.', 1) || ' / Office: ' || split_part(path, '.', 3) || chr(10) || 'NAICS: ' || naics || chr(10) || 'Set-aside: ' || set_aside || chr(10) || 'Response deadline: ' || deadline::varchar AS block,
title || ' ' || naics || ' R425 ' || set_aside || ' ' || split_part(path, '.', 3) || ' ' || split_part(path, '.', 1) AS line FROM notices""")
def notice_blocks(spark, d):
    """What a writer is told of each notice, and the line that is embedded."""
    n = notices(spark, d).withColumn("number", F.lit(""))
    line = n.select(F.col("notice_id").alias("l_id"), P.notice_text(F.col("title"), F.col("naics"), F.lit("R425"), F.col("set_aside"), F.col("path")).alias("line"))
    blocks = P.notice_block(n)
    return blocks.join(line, blocks["notice_id"] == line["l_id"]).select("notice_id", "block", "line")


@query(f"WITH {LIBRARY_SQL} SELECT doc_id, name || ' #' || (doc_id % 7 + 1) || CASE WHEN doc_id % 2 = 0 THEN ' · ' || lang ELSE '' END AS citation FROM library")
def chunk_citations(spark, d):
    """Citations of chunks, half of which stand in a section."""
    section = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return library(spark, d).select("doc_id", P.citation(F.col("name"), F.col("doc_id") % 7, section).alias("citation"))


@query(f"""WITH {NOTICES_SQL}, x AS (SELECT *, floor((epoch(deadline::timestamp) - epoch(TIMESTAMP '{AS_OF}')) / 86400)::bigint AS days FROM notices)
SELECT notice_id, 'Action checklist — ' || title AS head, (1 + (days > 2)::int + CASE type {" ".join(f"WHEN '{k}' THEN {len(v)}" for k, v in V.PLAYBOOK.items())} ELSE 0 END + 1 + {len(V.PLAYBOOK_TAIL)})::int AS boxes, CASE WHEN days > 2 THEN 2 ELSE 1 END::int AS dues FROM x""")
def checklists_rendered(spark, d):
    """Checklists in Markdown, by their heads, boxes and due dates."""
    n = notices(spark, d)
    text = P.checklist_markdown(checklist(n, F.lit(AS_OF).cast("timestamp")), n)
    count = lambda mark: F.size(F.split("markdown", mark)) - 1
    return text.select("notice_id", F.regexp_extract("markdown", "^# (.*)", 1).alias("head"), count(r"- \[ \] ").alias("boxes"), count(r"\(due ").alias("dues"))


@query(f"{_BOTH}, {_nearest('doc_id', 3, 'source IN (SELECT source FROM documents GROUP BY source HAVING count(*) % 2 = 0)')} SELECT q, id, score, rank::int AS rank FROM n")
def library_search_allowed(spark, d):
    """A search among documents that another table allows: a semi-join on what is indexed."""
    docs, backend = table(spark, d, "documents"), E.Hashed()
    allowed = docs.join(docs.groupBy("source").agg(F.count("*").alias("n")).where("n % 2 = 0"), "source", "left_semi").select(F.col("doc_id").alias("id"))
    index = backend.embed(docs, "doc_id", "text").join(allowed, "id", "left_semi")
    return E.nearest(backend.embed(table(spark, d, "benchmark"), "item_id", "text"), index, 3, dimension=backend.dimension)


@query("SELECT event_id, 'GET /search?q=' || event_type || '&api_key=*** done with ***' AS line FROM events")
def log_lines_redacted(spark, d):
    e = table(spark, d, "events")
    line = F.concat(F.lit("GET /search?q="), "event_type", F.lit("&api_key=k-"), F.col("user_id").cast("string"), F.lit(" done with s3cr3t"))
    return e.select("event_id", N.redacted(line, ("s3cr3t",)).alias("line"))
