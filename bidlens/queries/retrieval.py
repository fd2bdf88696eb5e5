"""Queries over embeddings: vectors, searches, recommendations, requirements mapped to sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import embedding as E
from ..operators import mining
from ..operators import knowledge as K
from ..operators import requirements as R
from ..plans.recommend import all_queries, recommended
from ..registry import query
from ..sources.tables import notices, table
from .documents import _EMBED, HINTS, STOP


def _vectors(name: str, source: str, key: str, d: int = 1024) -> str:
    """CTE `name` (id, dim, w) of a table's texts."""
    return f"""{name}_c AS (SELECT {key} AS id, md5(token) AS h, count(*) AS n FROM (SELECT {key}, unnest({_EMBED}) AS token FROM {source}) GROUP BY {key}, token),
{name}_s AS (SELECT id, (('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::bigint % {d})::int AS dim, sum((CASE WHEN ('0x' || substr(h, 9, 2))::bigint % 2 = 1 THEN 1 ELSE -1 END) * (1 + ln(n))) AS w FROM {name}_c GROUP BY ALL),
{name} AS (SELECT id, dim, CASE WHEN norm = 0 THEN 0 ELSE w / norm END AS w FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY id)) AS norm FROM {name}_s))"""


def _nearest(items: str, k: int, keep: str = "true") -> str:
    return f"""n AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM
(SELECT b.item_id AS q, d.{items} AS id, coalesce(s.score, 0) AS score FROM benchmark b CROSS JOIN (SELECT * FROM documents WHERE {keep}) d
LEFT JOIN (SELECT qv.id AS q, dv.id AS id, round(sum(qv.w * dv.w), 6) AS score FROM qv JOIN dv USING (dim) GROUP BY ALL) s ON s.q = b.item_id AND s.id = d.{items}) QUALIFY rank <= {k})"""


_BOTH = f"WITH {_vectors('dv', 'documents', 'doc_id')}, {_vectors('qv', 'benchmark', 'item_id')}"


@query(f"WITH {_vectors('dv', 'documents', 'doc_id', 256)} SELECT id, dim, round(w, 6) AS w FROM dv")
def hash_embed_sparse(spark, d):
    return E.Hashed(256).embed(table(spark, d, "documents"), "doc_id", "text").select("id", F.explode_outer("v").alias("x")).where("x IS NOT NULL").select("id", "x.dim", F.round("x.w", 6).alias("w"))


def _search(spark, d, docs, k, **how):
    backend = E.Hashed()
    return E.nearest(backend.embed(table(spark, d, "benchmark"), "item_id", "text"), backend.embed(docs, "doc_id", "text"), k, dimension=backend.dimension, **how)


@query(f"{_BOTH}, {_nearest('doc_id', 5)} SELECT q, id, score, rank::int AS rank FROM n")
def library_search_topk(spark, d):
    return _search(spark, d, table(spark, d, "documents"), 5)


_CATEGORIES = "source IN ('src1', 'src2', 'src3')"


@query(f"{_BOTH}, {_nearest('doc_id', 4, _CATEGORIES)} SELECT q, id, score, rank::int AS rank FROM n WHERE score >= 0.1")
def library_search_category(spark, d):
    """The least score holds after the k best are taken."""
    return _search(spark, d, table(spark, d, "documents").where(_CATEGORIES), 4).where("score >= 0.1")


@query(f"{_BOTH}, {_nearest('doc_id', 3)} SELECT q, round(avg(score), 6) AS relevance, count(*)::bigint AS n_evidence, max(score) < {V.WEAK_EVIDENCE} AS weak FROM n GROUP BY q")
def relevance_mean3(spark, d):
    top = _search(spark, d, table(spark, d, "documents"), 3)
    weak = top.groupBy("q").agg((F.max("score") < V.WEAK_EVIDENCE).alias("weak"))
    return E.relevance(top).join(weak, "q")


@query("SELECT q, id, round(score, 5) AS score FROM (SELECT a.vec_id AS q, b.vec_id AS id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(score, 5) DESC, id) <= 5")
def dense_cosine_topk(spark, d):
    """The query set is every fiftieth vector, in blocks."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    dimension = v.agg(F.max(F.size("v"))).first()[0] or 1
    return E.nearest(v.where("id % 50 = 0"), v, 5, dimension=dimension, digits=5, others=True, normed=False).drop("rank")


@query(f"""{_BOTH}, {_nearest('doc_id', 1)} SELECT q, id AS section, score, CASE WHEN score >= {V.ADDRESSED} THEN 'Addressed' WHEN score >= {V.PARTIAL} THEN 'Partial' ELSE 'Not Addressed' END AS status FROM n""")
def requirement_section_map(spark, d):
    """The best of all sections for each requirement."""
    return R.mapped(_search(spark, d, table(spark, d, "documents"), 1).select("q", "id", "score"))


@query(f"""{_BOTH}, {_nearest('doc_id', 1)} SELECT q, id AS section, score, CASE WHEN score >= {V.ADDRESSED} THEN 'Addressed' WHEN score >= {V.PARTIAL} THEN 'Partial' ELSE 'Not Addressed' END AS status FROM n""")
def requirement_section_map_all(spark, d):
    """The same, by its former name."""
    return requirement_section_map(spark, d)


@query("SELECT s AS status, (SELECT count(*) FROM labels WHERE (quality = 1 AND s = 'Addressed') OR (quality = 0 AND s = 'Not Addressed'))::bigint AS n FROM (VALUES ('Addressed'), ('Partial'), ('Not Addressed')) t(s)")
def status_counts_zero_filled(spark, d):
    a, _, n = V.STATUSES
    return R.status_counts(table(spark, d, "labels").select(F.when(F.col("quality") == 1, a).otherwise(n).alias("status")))


@query()
def recommend_ranked(spark, d):
    """Notices ranked by their likeness to the library's chunks. Candidates come from the mined queries, the broad terms and,
    since the benchmark's titles share no word with its documents, from two words of titles."""
    docs = table(spark, d, "documents")
    mined = mining.chosen_queries(mining.query_candidates(docs, "doc_id", "text", hints=HINTS, stopwords=STOP))
    broad = mining.broad_terms(docs, "doc_id", "text", hints=HINTS).select("term").collect()
    asked = all_queries([r.term for r in mined], [*(r.term for r in broad), "0001", "0012"])
    return recommended(notices(spark, d), K.numbered_chunks(docs), queries=asked, firm_naics=["BUILDING"], as_of="2000-07-01 00:00:00", top_k=20)


@query(f"""WITH {_vectors('qv', 'benchmark', 'item_id')}, {_vectors('dv', 'documents', 'doc_id')}, s AS (SELECT qv.id AS q, dv.id AS id, round(sum(qv.w * dv.w), 6) AS score FROM qv JOIN dv USING (dim) GROUP BY ALL),
x AS (SELECT q, id, round(score + CASE WHEN source = 'src1' THEN {V.HEADING_BONUS} ELSE 0 END + CASE WHEN doc_id % 10 = 0 THEN {V.TEMPLATE_BONUS} ELSE 0 END, 6) AS score FROM s JOIN documents ON doc_id = id)
SELECT q, id, score, (row_number() OVER (PARTITION BY q ORDER BY score DESC, id))::int AS rank FROM x QUALIFY rank <= 4""")
def style_rerank(spark, d):
    """Searches ranked anew: a fitting heading and the template document are worth more. Only what shares a dimension counts."""
    backend = E.Hashed()
    docs = table(spark, d, "documents")
    bonus = F.when(F.col("source") == "src1", V.HEADING_BONUS).otherwise(0.0) + F.when(F.col("doc_id") % 10 == 0, V.TEMPLATE_BONUS).otherwise(0.0)
    both = docs.select("doc_id", F.struct("text", bonus.alias("bonus")).alias("of"))
    items = backend.embed(both.select(F.struct("doc_id", "of.bonus").alias("key"), "of.text"), "key", "text").select(F.col("id.doc_id").alias("id"), "v", "id.bonus")
    return E.nearest(backend.embed(table(spark, d, "benchmark"), "item_id", "text"), items, 4, dimension=backend.dimension, sharing=True)
