"""From raw documents to packed training sequences: STAGES in order, each written and read again."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidlens.llm.decontaminate import clean_documents
from bidlens.llm.jaccard_join import document_classes
from bidlens.llm.langid import BUCKETS, fitted, with_language
from bidlens.llm.line_dedup import deduped_lines
from bidlens.llm.names import aside, unused
from bidlens.llm.packing import packed_documents
from bidlens.llm.queries import tokenizer_files
from bidlens.llm.scratch import dropped, stored
from bidlens.session import importable
from bidlens.sources.tables import table

#: A prediction below this posterior rejects the document.
LEAST_SCORE = 0.5
#: So does a mean log-probability of its n-grams below that of n-grams at random: the text is in no learned language.
LEAST_LIKENESS = -math.log(BUCKETS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language learned from the labelled ones, with the language found as `lang` (of null and wrong
    labels too). Rejected: null and empty texts and those without a letter, texts whose n-grams are likelier at random than
    in their best language, and those between languages. Rows are independent: repeated ones and those without id are
    judged alike. An empty table stays empty; further columns pass through, whatever their names."""
    importable(spark)
    moved = aside(docs.columns, "lang_pred", "score")
    (likeness,) = unused([*docs.columns, *moved.values()], "likeness")
    known = with_language(docs.withColumnsRenamed(moved), fitted(docs), likeness=likeness)
    kept = known.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) & (F.col(likeness) >= LEAST_LIKENESS))
    return kept.select(*[F.col("lang_pred" if c == "lang" else moved.get(c, c)).alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many other documents hold; no document goes. Null texts become empty ones; of rows that
    share the largest id all keep a line. An empty table stays empty; further columns pass through, whatever their names."""
    importable(spark)
    moved = aside(docs.columns, "kept_text", "n_lines", "n_dropped")
    kept = deduped_lines(docs.withColumnsRenamed(moved)).withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")})
    return kept.select(*[F.col(moved.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group at Jaccard similarity 0.8 on five-word shingles. Null and empty texts
    are near nothing. Rows alike in id and text stay once; rows without an id stay unless a document with an id has the same
    shingles. An empty table stays empty; further columns pass through, whatever their names."""
    importable(spark)
    gone_id, copy = unused(docs.columns, "gone_id", "copy")
    classes = document_classes(docs, k=5, numerator=80)
    gone = classes.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias(gone_id)).distinct()
    kept = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col(gone_id)), "left_anti")
    again = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    kept = kept.withColumn(copy, F.when(F.col("doc_id").isNotNull(), F.row_number().over(again)).otherwise(1))
    return kept.where(F.col(copy) == 1).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item. Null and empty texts hold none; rows are independent, repeated ones and
    those without id too. An empty table stays empty; further columns pass through, whatever their names."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 1024 tokens. Null and empty texts are a piece of the end token alone; every
    row is packed, repeated ones and those without id too. An empty table gives no piece."""
    importable(spark)
    return packed_documents(docs.select("doc_id", "text"), *tokenizer_files(), keep_ids=False)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: SQL can express neither the classifier nor the packing; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
