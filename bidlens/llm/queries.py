"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def tokenizer_files() -> tuple[str, str]:
    """The tokenizers file and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import deduped_lines

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return deduped_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import deduped_substrings

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return deduped_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scratch import scratch_path
    from .warc import read_warc, write_warc

    path = scratch_path(spark, "archives")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_warc(spark, path, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed_documents

    return packed_documents(_documents(spark, sf_dir).select("doc_id", "text"), *tokenizer_files(), keep_ids=False)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, found_pii, span_text

    found = found_pii(_documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    base = F.filter("findings", lambda s: s["kind"] < 4)
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{KINDS[k].name}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("findings")).alias("spans"), F.size("findings").cast("long").alias("n_spans"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fitted, held_out, with_language

    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fitted(docs.where(~held_out()))
    return with_language(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import document_classes

    return document_classes(_documents(spark, sf_dir).select("doc_id", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged_documents

    out = judged_documents(_documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminations

    return contaminations(_documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import sharded_documents

    out = sharded_documents(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives(rows, F.col("id") % 50 == 0)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import aligned_documents

    a, ranks = tokenizer_files()
    out = aligned_documents(_documents(spark, sf_dir), a, public_tokenizers.path("piece_bpe_32k.model"), ranks, keep_groups=False)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scanned

    out = scanned(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("detections").cast("long").alias("n_detections"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_pii": op5_pii,
    "op6_language_id": op6_language_id,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op10_kd_sharding": op10_kd_sharding,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_alignment": op12_token_alignment,
    "op13_license_scan": op13_license_scan,
}
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(table: str, key: str) -> str:
    """key and the words w of texts with words."""
    return f"SELECT {key}, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table} WHERE text IS NOT NULL AND len(w) > 0"


_RUNS = "list_distinct(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' ')))"


ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, octet_length(b)::bigint AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))::bigint) & 31)::bigint, 1)), '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> f THEN f END AS refers_to, 'ok' AS status
FROM q""",
    "op9_decontamination": f"""
WITH d AS ({_words("documents", "doc_id")}), b AS (SELECT *, least(len(w), 5) AS m FROM ({_words("benchmark", "item_id")})),
ds AS (SELECT doc_id, m, unnest({_RUNS}) AS g FROM d JOIN (SELECT DISTINCT m FROM b) ON len(w) >= m),
bs AS (SELECT item_id, m, len(s) AS n, unnest(s) AS g FROM (SELECT item_id, m, {_RUNS} AS s FROM b))
SELECT doc_id, item_id, count(*) / n::double AS containment, n::bigint AS n_item_shingles
FROM ds JOIN bs USING (m, g) GROUP BY doc_id, item_id, n HAVING 10 * count(*) >= 8 * n""",
    "op11_hard_negatives": """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::bigint + 1) % 10 ELSE label END AS label, list_transform(embedding::double[], lambda x: floor(256 * x)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding::double[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, b.id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::bigint AS score FROM e a JOIN e b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor AS anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id)::int AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT * FROM n WHERE rank <= 3""",
    "op3_line_dedup": """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS line FROM l),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*)::bigint AS n_lines, count(*) FILTER (doc_id <> keeper)::bigint AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM k LEFT JOIN h USING (key) GROUP BY doc_id""",
    "op4_substring_dedup": """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, len(w) AS n FROM d),
g AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 19], ' ')) AS a, md5(array_to_string(w[i:i + 19], ' ')) AS b FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, i) > 1 AS again FROM g),
c AS (SELECT x.*, coalesce(max(CASE WHEN again THEN f.i END) OVER (PARTITION BY x.doc_id ORDER BY x.i) > x.i - 20, false) AS gone FROM x LEFT JOIN f USING (doc_id, i)),
k AS (SELECT doc_id, count(*) FILTER (gone)::bigint AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op7_jaccard_join": f"""
WITH RECURSIVE w AS ({_words("documents", "doc_id")}), d AS (SELECT doc_id, {_RUNS} AS s FROM (SELECT *, least(len(w), 4) AS m FROM w)),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM d),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT doc_id, coalesce(len(s), 0)::bigint AS n_shingles, least(doc_id, (SELECT min(y) FROM r WHERE r.x = doc_id)) AS component_id FROM documents LEFT JOIN d USING (doc_id)""",
}
