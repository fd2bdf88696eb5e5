"""Queries over the knowledge base: chunks beside their documents, indexes and their changes, texts put together again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import embedding as E
from ..operators import knowledge as K
from ..registry import query
from ..sources.tables import dealt, library, table
from ..storage import scratch_path, stored


def _library(spark, d):
    return K.described(dealt(library(spark, d).select("doc_id", "name", "category", "text"), "doc_id"))


@query()
def contextual_chunks(spark, d):
    """What is embedded for each chunk, by length and hash."""
    return K.contextual_chunks(_library(spark, d)).select("chunk_no", "doc_id", "ordinal", F.sha2("embed_text", 256).alias("embed_sha"))


@query()
def documents_added(spark, d):
    """Documents of odd number come to a library that has those of even number."""
    docs = library(spark, d).select("doc_id", "name", "category", "text")
    told, _ = K.added(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), E.Hashed(256))
    return told.select("doc_id", "doc_type", "status", "chunks")


@query()
def index_reloaded(spark, d):
    """An index of one backend, saved and loaded for another: every row is embedded again. The count of dimensions tells."""
    path = scratch_path(spark, "index")
    K.saved(K.embedded(K.contextual_chunks(_library(spark, d)), E.Hashed(64)), path)
    again = K.loaded(spark, path, E.Hashed(256))
    return again.select("chunk_no", "signature", F.size("v").alias("dims"))


@query()
def library_recategorised(spark, d):
    """Labelled documents move to a category of their own; their chunks are embedded again, others stay."""
    backend = E.Hashed(256)
    docs = _library(spark, d)
    index = stored(K.embedded(K.contextual_chunks(docs), backend), "index")
    changes = table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit("Best").alias("category"))
    told, new = K.recategorised(docs, index, changes, backend)
    counts = new.groupBy(F.col("doc_id").alias("c_id")).agg(F.count("*").alias("chunks"), F.count_if(F.col("embed_text").contains(" — Best")).alias("renamed"))
    return told.join(counts, told["doc_id"] == counts["c_id"], "left").select("doc_id", "category", "changed", "chunks", "renamed")


@query()
def rebuilt_texts(spark, d):
    """Documents cut into overlapping windows and put together again."""
    windows = dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(T.char_windows(F.col("text"), 3600, 400)).alias("ordinal", "text"))
    return K.rebuilt(windows).select("doc_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha"))


@query("SELECT 'search' AS use, count(*)::bigint AS n FROM documents UNION ALL SELECT 'list', 0 UNION ALL SELECT 'one', count(*) FROM documents WHERE source = 'src1' UNION ALL SELECT 'all', count(*) FROM documents")
def category_filters(spark, d):
    """No categories mean all in a search and none in a listing."""
    docs = library(spark, d).select("doc_id", "category")
    count = lambda use, df: df.agg(F.count("*").alias("n")).select(F.lit(use).alias("use"), "n")
    out = count("search", K.in_categories(docs, [], empty_means_all=True)).unionByName(count("list", K.in_categories(docs, [], empty_means_all=False)))
    return out.unionByName(count("one", K.in_categories(docs, ["src1"], empty_means_all=True))).unionByName(count("all", K.in_categories(docs, None, empty_means_all=False)))
