"""Keyword queries mined from a document library."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import query_tokens, word_tokens
from ..storage import stored


def terms(docs: DataFrame, id_col: str, tokens) -> DataFrame:
    """id, pos, term of each document's tokens."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(tokens).alias("pos", "term"))


def term_stats(found: DataFrame) -> DataFrame:
    """term, df (documents), tf (occurrences) and first (its first document and place)."""
    per_doc = found.groupBy("term", "id").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"), F.min(F.struct("id", "pos")).alias("first"))


def bigrams(docs: DataFrame, id_col: str, tokens) -> DataFrame:
    """Like terms(), of neighbouring tokens that differ; both are known within a row, so that nothing is shuffled."""
    pair = lambda a, b: F.when(a != b, F.concat_ws(" ", a, b))
    withs = docs.select(F.col(id_col).alias("id"), tokens.alias("t"))
    return withs.select("id", F.posexplode(F.zip_with("t", F.slice("t", F.lit(2), F.size("t")), pair)).alias("pos", "term")).where("term IS NOT NULL")


def query_candidates(docs: DataFrame, id_col: str, text_col: str, *, hints: list[str] | None = None, stopwords: list[str] | None = None) -> DataFrame:
    """Candidate queries: term, kind (0 phrase, 1 word), df, tf, capability, score and rank.

    A term counts that two documents share (one, where there are fewer than three), or that names a capability and occurs three
    times. Ties go to phrases, then to the first place. `first` sorts by document id.
    """
    hints = V.CAPABILITY_HINTS if hints is None else hints
    tokens = query_tokens(F.col(text_col), stopwords)
    floor = F.when(F.col("n_docs") >= 3, 2).otherwise(1)
    known = F.array(*[F.lit(h) for h in hints])
    both = term_stats(bigrams(docs, id_col, tokens)).withColumn("kind", F.lit(0)).unionByName(term_stats(terms(docs, id_col, tokens)).where(F.length("term") >= 4).withColumn("kind", F.lit(1)))
    both = both.withColumn("capability", F.arrays_overlap(F.split("term", " "), known)).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n_docs"))))
    kept = both.where((F.col("df") >= floor) | (F.col("capability") & (F.col("tf") >= 3)))
    phrase = F.col("kind") == 0
    score = F.col("df") * F.when(phrase, 4.0).otherwise(3.0) + F.col("tf") * F.when(phrase, 0.4).otherwise(0.3) + F.when(F.col("capability"), F.when(phrase, 3.0).otherwise(2.5)).otherwise(0.0)
    return kept.select("term", "kind", "df", "tf", "capability", F.round(score, 6).alias("score"), "first")


#: Candidates that come to the driver at once.
AT_ONCE = 64


def chosen_queries(candidates: DataFrame, most: int = 6) -> list[Row]:
    """Candidates (term, kind, score) in order, without those whose words earlier ones already cover.

    The candidates are stored once. The first AT_ONCE that bring a word are taken and gone through, and those that still bring one are
    asked for again until there are enough: what is covered stays covered, so none of those passed over can be chosen later."""
    kept = stored(candidates.select("term", "kind", "score", "first"), "query_candidates")
    chosen: list[Row] = []
    covered: set[str] = set()
    while len(chosen) < most:
        new = kept.where(F.size(F.array_except(F.split("term", " "), F.array(*[F.lit(w) for w in sorted(covered)]))) > 0) if covered else kept
        rows = new.orderBy(F.desc("score"), "kind", "first", "term").limit(AT_ONCE).select("term", "kind", "score").collect()
        for r in rows:
            words = set(r.term.split())
            if len(chosen) < most and not words <= covered:
                chosen.append(r)
                covered |= words
        if len(rows) < AT_ONCE:
            break
    return chosen


def broad_terms(docs: DataFrame, id_col: str, text_col: str, *, hints: list[str] | None = None, most: int = 3) -> DataFrame:
    """The capability words in most documents, then most occurrences; ties by first place."""
    known = F.array(*[F.lit(h) for h in (V.CAPABILITY_HINTS if hints is None else hints)])
    found = terms(docs, id_col, word_tokens(F.col(text_col))).where(F.array_contains(known, F.col("term")))
    return term_stats(found).orderBy(F.desc("df"), F.desc("tf"), "first", "term").limit(most)
