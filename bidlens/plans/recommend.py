"""Recommending notices to a firm by what its document library says."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.normalize import agency, days_left, deadline_key, office
from ..functions.text import non_empty
from ..operators import embedding as E
from ..storage import stored

#: Below this many candidates (or twice the number asked for) the industry filter is given up.
LEAST_CANDIDATES = 8
_BLANK = re.compile(r"[ \t\n\x0b\f\r]+")


def all_queries(phrases: list[str], broad: list[str]) -> list[str]:
    """Phrase queries and the broad terms that are not among them, in order."""
    return list(dict.fromkeys([*phrases, *broad]))


def candidates(notices: DataFrame, queries: list[str], firm_naics: list[str], top_k: int) -> DataFrame:
    """Each notice that a query matches, once, with the sorted queries that match it; in the firm's industries, unless these have too few."""
    low = F.lower("title")
    holds = lambda q: reduce(and_, [low.contains(F.lower(F.lit(w))) for w in _BLANK.split(q) if w], low.isNotNull())
    hits = [F.when(holds(q), q) for q in sorted(set(queries))]
    matched = notices.withColumn("matched", F.filter(F.array(*hits), lambda q: q.isNotNull())).where(F.size("matched") > 0)
    own = matched.where(F.col("naics").isin(*firm_naics))
    few = own.limit(min(LEAST_CANDIDATES, 2 * top_k)).count() < min(LEAST_CANDIDATES, 2 * top_k)
    return matched if few or not firm_naics else own


def recommended(notices: DataFrame, chunks: DataFrame, *, queries: list[str], firm_naics: list[str], as_of: str, top_k: int = 5, backend: E.Backend | None = None) -> DataFrame:
    """notice_id, score, matched, evidence (numbers of the three nearest chunks) and why, in order.

    `chunks` has chunk_no (a whole number that names a chunk), doc_id and text. Candidates' texts and chunks are embedded once each;
    notices have a whole number notice_no. Notices of the same text are searched for once.
    """
    backend = backend or E.Hashed()
    found = candidates(notices, queries, firm_naics, top_k)
    text = F.concat_ws(" ", *[non_empty(F.col(c)) for c in ("title", "naics", "set_aside")], office(F.col("path")), agency(F.col("path")))
    found = stored(found.withColumn("text", text), "candidates")
    texts = found.groupBy("text").agg(F.min("notice_no").alias("no"))
    asked = stored(texts.select("no", F.col("text").alias("of_text")), "texts")
    index = backend.embed(chunks.select(F.struct("chunk_no", "doc_id").alias("key"), "text"), "key", "text")
    index = stored(index.select("id.chunk_no", "id.doc_id", "v"), "chunks")
    vectors = stored(backend.embed(asked, "no", "of_text"), "queries")
    near = E.nearest(vectors, index.select(F.col("chunk_no").alias("id"), "v"), 3, dimension=backend.dimension, written=True)
    of = index.select(F.col("chunk_no").alias("c_no"), F.col("doc_id").alias("c_doc"))
    near = near.join(of, near["id"] == of["c_no"], "left")
    scored = near.groupBy("q").agg(F.avg("score").alias("relevance"), F.sort_array(F.collect_list(F.struct("rank", "id", "c_doc"))).alias("e"))
    of_texts = asked.join(scored, asked["no"] == scored["q"], "left").drop("no", "q")
    joined = found.join(of_texts, found["text"] == of_texts["of_text"], "left").withColumn("evidence", F.transform("e", lambda x: x["id"]))
    own = F.col("naics").isin(*firm_naics) if firm_naics else F.lit(False)
    score = F.coalesce("relevance", F.lit(0.0)) + V.QUERY_BONUS * (F.size("matched") - 1) + F.when(own, V.NAICS_BONUS).otherwise(0.0)
    days = days_left(F.col("deadline").cast("timestamp"), F.lit(as_of).cast("timestamp"))
    quoted = F.array_join(F.transform(F.slice("matched", 1, 3), lambda q: F.concat(F.lit("“"), q, F.lit("”"))), ", ")
    document = F.get("e", F.lit(0))["c_doc"].cast("string")
    why = F.concat(F.concat_ws("; ", F.concat(F.lit("Matches your work in document "), document), F.concat(F.lit("surfaced by "), quoted), F.when(own, F.concat(F.lit("in your NAICS "), F.col("naics")))), F.lit("."))
    ranked = joined.select("notice_id", F.round(score, 6).alias("score"), "matched", "evidence", why.alias("why"), deadline_key(days).alias("deadline_key"))
    return ranked.orderBy(F.desc("score"), "deadline_key", "notice_id").limit(top_k)
