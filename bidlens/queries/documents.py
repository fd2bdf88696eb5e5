"""Queries over document texts: duplicates, tokens, query mining, clean-up, chunks, requirements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import chunking, mining
from ..operators import requirements as R
from ..operators.proposal import elected_template
from ..operators.search import first_seen, numbered_by
from ..registry import query
from ..sources.tables import library, table

#: The documents' own frequent words, where lists made for English notices would leave nothing over.
STOP = ["the", "and", "that", "for", "with"]
HINTS = ["tion", "ther", "tional", "ing", "mente"]
VERBS = "inth|heis|onan|thth"


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_EMBED = f"list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda t: lower(t)), lambda t: length(t) > 1 AND NOT list_contains({_sql_list(V.EMBED_STOPWORDS)}, t))"
_WORDS = r"list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z\-]{2,}'), lambda t: lower(t))"
_QUERY = f"list_filter({_WORDS}, lambda t: NOT list_contains({_sql_list(STOP)}, t))"


@query("SELECT doc_id, sha256(text) AS content_sha FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def doc_exact_dedupe(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha"))
    return docs.groupBy("content_sha").agg(F.min("doc_id").alias("doc_id"))


def _any(col: str, words) -> str:
    return " OR ".join(f"contains({col}, '{w}')" for w in words)


@query("WITH x AS (SELECT doc_id, lower('doc_' || doc_id || ' ' || source) AS hay, lower(substr(text, 1, 1500)) AS head FROM documents) SELECT doc_id, CASE " + " ".join(f"WHEN {_any('hay', w)} OR {_any('head', w)} THEN '{k}'" for k, w in V.DOC_TYPE_RULES) + " ELSE 'Other' END AS doc_type FROM x")
def doc_type_rules(spark, d):
    return library(spark, d).select("doc_id", T.doc_type(F.col("name"), F.col("category"), F.col("text")).alias("doc_type"))


@query(f"SELECT doc_id, token, count(*)::bigint AS n FROM (SELECT doc_id, unnest({_EMBED}) AS token FROM documents) GROUP BY ALL")
def doc_token_counts(spark, d):
    """Counted within each row, whose tokens are all at hand."""
    return table(spark, d, "documents").select("doc_id", F.explode_outer(T.counted(T.embed_tokens(F.col("text")))).alias("c")).where("c IS NOT NULL").select("doc_id", "c.token", "c.n")


@query(f"SELECT term, count(DISTINCT doc_id)::bigint AS df, count(*)::bigint AS tf FROM (SELECT doc_id, unnest({_QUERY}) AS term FROM documents) GROUP BY term")
def term_df_tf(spark, d):
    docs = table(spark, d, "documents")
    return mining.term_stats(mining.terms(docs, "doc_id", T.query_tokens(F.col("text"), STOP))).select("term", "df", "tf")


_BIGRAMS = f"SELECT doc_id, pos, a || ' ' || b AS term FROM (SELECT doc_id, i AS pos, t[i + 1] AS a, t[i + 2] AS b FROM (SELECT doc_id, t, unnest(range(0, len(t) - 1)) AS i FROM (SELECT doc_id, {_QUERY} AS t FROM documents))) WHERE a <> b"


@query(f"SELECT term, count(DISTINCT doc_id)::bigint AS df, count(*)::bigint AS tf FROM ({_BIGRAMS}) GROUP BY term")
def bigram_df_tf(spark, d):
    docs = table(spark, d, "documents")
    return mining.term_stats(mining.bigrams(docs, "doc_id", T.query_tokens(F.col("text"), STOP))).select("term", "df", "tf")


_CANDIDATES = f"""
WITH t AS (SELECT doc_id, t, unnest(range(0, len(t))) AS i FROM (SELECT doc_id, {_QUERY} AS t FROM documents)),
u AS (SELECT doc_id, i AS pos, t[i + 1] AS term, 1 AS kind FROM t UNION ALL SELECT doc_id, pos, term, 0 FROM ({_BIGRAMS})),
s AS (SELECT term, kind, count(DISTINCT doc_id) AS df, count(*) AS tf, min((doc_id, pos)) AS f FROM u GROUP BY ALL),
c AS (SELECT *, list_has_any(string_split(term, ' '), {_sql_list(HINTS)}) AS capability FROM s WHERE kind = 0 OR length(term) >= 4),
k AS (SELECT term, kind, df, tf, capability, f, CASE kind WHEN 0 THEN df * 4.0::double + tf * 0.4::double + CASE WHEN capability THEN 3.0 ELSE 0 END ELSE df * 3.0::double + tf * 0.3::double + CASE WHEN capability THEN 2.5 ELSE 0 END END AS score FROM c WHERE df >= 2 OR (capability AND tf >= 3))"""


@query(_CANDIDATES + " SELECT term, kind::int AS kind, df::bigint AS df, tf::bigint AS tf, capability, round(score, 6) AS score FROM k")
def query_candidates_ranked(spark, d):
    found = mining.query_candidates(table(spark, d, "documents"), "doc_id", "text", hints=HINTS, stopwords=STOP)
    return found.drop("first")


@query()
def generated_queries(spark, d):
    """The greedy choice; its rows are few whatever the input, its work is the candidates'."""
    found = mining.query_candidates(table(spark, d, "documents"), "doc_id", "text", hints=HINTS, stopwords=STOP)
    return spark.createDataFrame(mining.chosen_queries(found), "term string, kind int, score double")


@query(f"WITH t AS (SELECT doc_id, unnest({_WORDS}) AS term, generate_subscripts({_WORDS}, 1) AS pos FROM documents) SELECT term, count(DISTINCT doc_id)::bigint AS df, count(*)::bigint AS tf FROM t WHERE list_contains({_sql_list(HINTS)}, term) GROUP BY term ORDER BY df DESC, tf DESC, min((doc_id, pos)), term LIMIT 3")
def broad_terms(spark, d):
    return mining.broad_terms(table(spark, d, "documents"), "doc_id", "text", hints=HINTS).select("term", "df", "tf")


_HTML = r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)</p\s*>', chr(10) || chr(10), 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</li\s*>', chr(10), 'g'), '(?i)<li[^>]*>', '• ', 'g'), '<[^>]+>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS t FROM a),
c AS (SELECT page_id, array_to_string(list_transform(string_split(replace(t, chr(13), chr(10)), chr(10)), lambda x: trim(x, chr(32) || chr(9))), chr(10)) AS t FROM b)
SELECT page_id, trim(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(32)) AS text FROM c"""


@query(_HTML)
def html_texts(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '#{1,6}\s*', '', 'g'), '\*\*(.+?)\*\*', '\1', 'g')) = '' AS blank, strpos(text, '#') > 0 AS had_marks FROM documents""")
def prose_marks(spark, d):
    return table(spark, d, "documents").select("doc_id", (T.plain_prose(F.col("text")) == "").alias("blank"), F.col("text").contains("#").alias("had_marks"))


@query(r"SELECT doc_id, c[:320] || CASE WHEN length(c) > 320 THEN '…' ELSE '' END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents)")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query(r"SELECT doc_id, (1 + len(regexp_extract_all(trim(text), '[.!?]\s+[\"''(\[]?[A-Z0-9]')))::int AS n FROM documents WHERE trim(text) <> ''")
def sentence_counts(spark, d):
    return table(spark, d, "documents").where(F.trim("text") != "").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n"))


@query("SELECT doc_id, i::int AS ordinal, substr(text, (i * 3200 + 1)::bigint, 3600) AS window FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 3199) // 3200)) AS i FROM documents)")
def char_windows(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.char_windows(F.col("text"), 3600, 400)).alias("ordinal", "window"))


@query()
def document_chunks(spark, d):
    return chunking.chunks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "ordinal", "section", F.length("text").alias("n_chars"), "chunk_id")


_HEADING = r"""SELECT {key}, length(s) BETWEEN 3 AND 90 AND NOT contains(s, chr(10)) AND (starts_with(s, '#') OR (NOT regexp_matches(s, '[.!?,;]$')
AND (regexp_matches(s, '^(?:\d+(?:\.\d+)*|[IVXLCDM]+)[.)]\s+') OR (len(w) <= 12 AND ((letters > 0 AND capitals >= 0.6 * letters) OR (len(w) > 1 AND titled >= 0.7 * len(w))))))) AS {out}
FROM (SELECT *, len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Lu}}'))) AS titled FROM (SELECT *, regexp_extract_all(s, '\S+') AS w, len(regexp_extract_all(s, '\p{{L}}')) AS letters, len(regexp_extract_all(s, '\p{{Lu}}')) AS capitals FROM ({source})))"""
_LINES = "SELECT doc_id, pos::int AS pos, trim(line, chr(9) || chr(11) || chr(12) || chr(13) || chr(32)) AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


@query(_HEADING.format(key="doc_id", out="heading", source="SELECT doc_id, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(32)) AS s FROM documents"))
def headings(spark, d):
    """Whether a document's whole text is a heading."""
    return table(spark, d, "documents").select("doc_id", T.is_heading(F.col("text")).alias("heading"))


@query(_HEADING.format(key="doc_id, pos", out="heading", source=_LINES))
def heading_lines(spark, d):
    """Every line of every document, and whether it is a heading."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", T.is_heading(F.col("line")).alias("heading"))


@query()
def document_summaries(spark, d):
    return table(spark, d, "documents").select("doc_id", T.summary(F.col("text")).alias("summary"))


_REQ = rf"""
WITH s AS (SELECT doc_id, pos, trim(regexp_replace(m, '\s+', ' ', 'g')) AS requirement FROM (SELECT doc_id, unnest(x) AS m, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '[^.\n]*\.'), lambda m: regexp_matches(regexp_replace(m, '[^\x00-\x7F]', 'x', 'g'), '(?i)\b(?:{VERBS})\b')) AS x FROM documents))),
k AS (SELECT *, row_number() OVER (PARTITION BY lower(requirement) ORDER BY doc_id, pos) AS r FROM s WHERE length(requirement) BETWEEN 25 AND 400),
c AS (SELECT doc_id AS id, pos::int AS pos, requirement, CASE {" ".join(f"WHEN {_any('lower(requirement)', w)} THEN '{n}'" for n, w in V.REQUIREMENT_RULES)} ELSE 'Other' END AS category FROM k WHERE r = 1)"""


def _requirements(spark, d):
    return R.requirements(table(spark, d, "documents"), "doc_id", "text", words=VERBS)


@query(_REQ + " SELECT * FROM c")
def requirement_sentences(spark, d):
    return _requirements(spark, d)


@query(_REQ + f", f AS (SELECT * FROM c ORDER BY id, pos LIMIT 15) SELECT *, row_number() OVER (ORDER BY list_position({_sql_list(V.REQUIREMENT_ORDER)}, category), id, pos)::int AS item FROM f")
def requirement_matrix(spark, d):
    return R.matrix(_requirements(spark, d))


@query("SELECT source AS category, count(*)::bigint AS documents, sum(length(text))::bigint AS total_chars, count(DISTINCT lang)::bigint AS langs FROM documents GROUP BY source")
def doc_category_counts(spark, d):
    return library(spark, d).groupBy("category").agg(F.count("*").alias("documents"), F.sum(F.length("text")).cast("long").alias("total_chars"), F.count_distinct("lang").alias("langs"))


@query("SELECT count(*)::bigint AS documents, sum((length(text) + 3199) // 3200)::bigint AS chunks, sum(length(text))::bigint AS total_chars FROM documents")
def library_stats(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").agg(F.count("*").alias("documents"), F.sum(F.size(T.char_windows(t, 3600, 400))).cast("long").alias("chunks"), F.sum(F.length(t)).cast("long").alias("total_chars"))


@query("SELECT source AS category, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) = 1")
def template_election(spark, d):
    """The longest document of each category, the first of equals."""
    return first_seen(library(spark, d), ["category"], [F.desc(F.length("text")), "doc_id"]).select("category", "doc_id")


@query()
def template_scored(spark, d):
    """The document that best stands for a whole proposal, by additive rules over kind, category, name and chunks; the first of equals, and only with a score above 0."""
    docs = library(spark, d)
    return elected_template(docs, chunking.chunks(docs, "doc_id", "text"))


@query("SELECT conv_id, string_agg('**' || role || '** ' || replace(replace(text, '|', chr(92) || '|'), chr(10), ' '), chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def markdown_render(spark, d):
    c = table(spark, d, "conversations")
    line = F.concat(F.lit("**"), "role", F.lit("** "), F.replace(F.replace("text", F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    parts = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))).alias("p"))
    return parts.select("conv_id", F.array_join(F.transform("p", lambda x: x["l"]), "\n").alias("markdown"))


@query("SELECT page_id, CASE WHEN octet_length(encode(html)) <= 2000 THEN 'ok' ELSE 'too_large' END AS status, (1 + page_id * 500)::bigint AS mb, CASE WHEN (page_id * 500) >= 1000 AND (page_id * 500) % 1000 = 0 THEN (page_id * 500 // 1000) || ' GB' ELSE (page_id * 500) || ' MB' END AS label FROM pages")
def upload_guard(spark, d):
    from ..functions.normalize import upload_label

    p = table(spark, d, "pages")
    mb = F.col("page_id") * 500
    return p.select("page_id", F.when(F.octet_length("html") <= 2000, "ok").otherwise("too_large").alias("status"), (1 + mb).alias("mb"), upload_label(mb).alias("label"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::int AS number, 'doc_' || doc_id || ' #' || (row_number() OVER (PARTITION BY source ORDER BY doc_id)) || ' · ' || source AS citation FROM documents")
def citations(spark, d):
    numbered = numbered_by(library(spark, d).select("doc_id", "name", "category"), "category", "doc_id", "number")
    return numbered.select("doc_id", "number", F.concat("name", F.lit(" #"), F.col("number").cast("string"), F.lit(" · "), "category").alias("citation"))
