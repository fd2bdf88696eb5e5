"""Queries over drafts: evidence, scaffolds, outlines and requirement matrices. The documents are both library and solicitation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embedding as E
from ..operators import knowledge as K
from ..operators import proposal as P
from ..registry import query
from ..sources.tables import dealt, library, table
from ..storage import stored
from .documents import VERBS

SECTIONS = [
    P.Section("summary", "Executive Summary", "the and of that for with ing tion", headings=("the",)),
    P.Section("approach", "Technical Approach", "der die und das ist nicht mit", solicitation=2, facts=6),
    P.Section("experience", "Past Performance", "les des une que pour dans est", style=3, categories=("src1", "src2")),
    P.Section("extra", "Appendix", "los las una por con para del", optional=True),
]


def _solicitation(spark, d, backend):
    return stored(P.solicitation_index(dealt(library(spark, d).select("doc_id", "name", "text"), "doc_id"), backend), "solicitation")


def _chunks(spark, d, backend):
    found = K.embedded(K.contextual_chunks(K.described(dealt(library(spark, d).select("doc_id", "name", "category", "text"), "doc_id"))), backend)
    return stored(found.withColumn("citation", F.concat("name", F.lit(" #"), (F.col("ordinal") + 1).cast("string"))), "library_chunks")


def _evidence(spark, d):
    backend, chunks = E.Hashed(), _chunks(spark, d, E.Hashed())
    elected = P.elected_template(library(spark, d), chunks).first()
    return stored(P.gathered(SECTIONS, _solicitation(spark, d, backend), chunks, backend, template=elected and elected.doc_id, written=True), "evidence")


@query()
def section_evidence(spark, d):
    """The evidence of each section, by origin."""
    return _evidence(spark, d).select("no", "origin", "label", F.round("score", 6).alias("score"), "rank")


@query()
def draft_document(spark, d):
    """A draft of the sections that are not optional, as Markdown."""
    asked = [s for s in SECTIONS if not s.optional]
    return P.draft_markdown(P.scaffolds(asked, _evidence(spark, d).where(F.col("no") < len(asked))), "Proposal Draft")


@query()
def compliance_rows(spark, d):
    """Requirements of the chunks that answer the fixed queries best, mapped to scaffolded sections."""
    return _matrix(spark, d)


def _matrix(spark, d):
    backend = E.Hashed()
    evidence = stored(P.compliance_evidence(_solicitation(spark, d, backend), backend, written=True), "compliance_evidence")
    parts = P.sections_table(spark, SECTIONS).select("no", "title", F.col("query").alias("content"))
    return P.compliance_matrix(evidence, parts, backend, words=VERBS)


@query()
def compliance_document(spark, d):
    return P.matrix_markdown(_matrix(spark, d))


@query()
def outlines(spark, d):
    """The first sections of each document."""
    return P.outline(K.numbered_chunks(table(spark, d, "documents")))


def _last(*marks: str) -> str:
    """Where the last of these marks begins in w, from 0."""
    quoted = [m.replace("\n", "' || chr(10) || '") for m in marks]
    return f"greatest({', '.join(f"CASE WHEN contains(w, '{m}') THEN length(w) - {len(k)} + 1 - strpos(reverse(w), reverse('{m}')) ELSE -1 END" for m, k in zip(quoted, marks))})"


@query(f"""WITH l AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '[^\\S\\n]+(\\n|$)', '\\1', 'g') AS t FROM documents), w AS (SELECT *, substr(t, 1, {P.EXEMPLAR_CHARS}) AS w FROM l),
c AS (SELECT *, {_last(chr(10) * 2)} AS p, {_last(". ", "." + chr(10), chr(10))} AS s, {_last(" ")} AS b FROM w), k AS (SELECT *, CASE WHEN p >= {int(0.6 * P.EXEMPLAR_CHARS)} THEN p WHEN s >= {int(0.6 * P.EXEMPLAR_CHARS)} THEN s ELSE b END AS cut FROM c)
SELECT doc_id, CASE WHEN length(t) <= {P.EXEMPLAR_CHARS} THEN t ELSE regexp_replace(substr(t, 1, CASE WHEN cut > 0 THEN cut ELSE {P.EXEMPLAR_CHARS} END), '\\s+$', '') || '…' END AS excerpt FROM k""")
def exemplars(spark, d):
    return table(spark, d, "documents").select("doc_id", P.exemplar(F.col("text")).alias("excerpt"))
