"""Queries over tables with a state, and over what is derived from notices for people."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import vocabulary as V
from ..functions.text import non_empty
from ..operators import store as S
from ..operators.checklist import checklist, outreach
from ..registry import query
from ..sources.tables import NOTICES_SQL, library, notices, table

NOW = "2024-01-20 00:00:00"


@query("SELECT day::varchar AS day, n AS used, greatest(900 - n, 0)::bigint AS remaining FROM (SELECT ts::date AS day, count(*)::bigint AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 7)")
def budget_by_day_last7(spark, d):
    return S.daily_budget(table(spark, d, "events"), "ts", 900).withColumn("day", F.col("day").cast("string"))


def _responses(spark, d):
    e = table(spark, d, "events")
    ttl = F.get(F.array(F.lit(-1), F.lit(0), F.lit(43_200), F.lit(864_000)), (F.col("event_id") % 4).cast("int"))
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("created"), ttl.alias("ttl"), F.col("props").alias("payload"))


_RESPONSES = "r AS (SELECT user_id AS key, event_id AS seq, epoch(ts) AS created, list_extract([-1, 0, 43200, 864000], (event_id % 4 + 1)::bigint) AS ttl, props AS payload FROM events), f AS (SELECT *, CASE WHEN ttl < 0 THEN true WHEN ttl = 0 THEN false ELSE epoch(TIMESTAMP '" + NOW + "') < created + ttl END AS fresh FROM r)"


def _now():
    return F.unix_micros(F.lit(NOW).cast("timestamp")) / 1e6


@query(f"WITH {_RESPONSES} SELECT key, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created DESC, seq DESC) AS n FROM f) WHERE n = 1 AND fresh")
def cache_lookup(spark, d):
    return S.cached(_responses(spark, d), _now()).select("key", "seq")


@query(f"WITH {_RESPONSES} SELECT count(*)::bigint AS entries, count(*) FILTER (fresh)::bigint AS fresh, count(*) FILTER (NOT fresh)::bigint AS stale, sum(length(payload))::bigint AS bytes FROM f")
def cache_fresh_stale(spark, d):
    return S.cache_stats(_responses(spark, d), _now())


def _params():
    return F.create_map(F.lit("q"), F.col("event_type"), F.lit("API_KEY"), F.lit("secret"), F.lit("user"), F.col("user_id").cast("string"), F.lit("none"), F.lit(None).cast("string"))


@query("SELECT event_id, 'q,user' AS names, event_type AS q FROM events")
def param_scrub(spark, d):
    return table(spark, d, "events").withColumn("p", N.scrubbed(_params())).select("event_id", F.array_join(F.sort_array(F.map_keys("p")), ",").alias("names"), F.col("p")["q"].alias("q"))


@query("""SELECT event_id, sha256('{"endpoint":"/search","params":{"q":"' || event_type || '","user":"' || user_id || '"}}') AS key FROM events""")
def cache_keys(spark, d):
    return table(spark, d, "events").select("event_id", N.cache_key(F.lit("/search"), _params()).alias("key"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def draft_latest_version(spark, d):
    return S.latest(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")]).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::int AS version FROM conversations")
def draft_versions(spark, d):
    return S.versions(table(spark, d, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "version")


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0) GROUP BY text")
def library_add(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return S.new_documents(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "doc_id", "text").select("doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'src1' ELSE source END AS category, doc_id % 3 = 0 AND source <> 'src1' AS needs_embedding FROM documents")
def library_update(spark, d):
    docs = library(spark, d).drop("text")
    changes = docs.where("doc_id % 3 = 0").select("doc_id", F.lit("src1").alias("category"))
    return S.updated(docs, changes, "doc_id").select("doc_id", "category", "needs_embedding")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def library_delete(spark, d):
    return S.without(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").where("toxic = 1"), "doc_id")


@query("SELECT status, count(*)::bigint AS n FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 THEN 'skipped' WHEN trim(text) = '' THEN 'no_chunks' ELSE 'indexed' END AS status FROM documents) GROUP BY status")
def upload_summary(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), (F.trim("text") == "").alias("empty"))
    firsts = docs.groupBy("sha", "empty").agg(F.count("*").alias("n"))
    rows = firsts.select(F.explode(F.array(F.struct(F.when(F.col("empty"), "no_chunks").otherwise("indexed").alias("status"), F.lit(1).cast("long").alias("n")), F.struct(F.lit("skipped").alias("status"), (F.col("n") - 1).alias("n")))).alias("x"))
    return rows.groupBy("x.status").agg(F.sum("x.n").alias("n")).where("n > 0")


def _case(values) -> str:
    return " ".join(f"WHEN '{k}' THEN {len(v)}" for k, v in values.items())


@query(f"WITH {NOTICES_SQL}, x AS (SELECT *, floor((epoch(deadline::timestamp) - epoch(TIMESTAMP '1998-06-15 12:00:00')) / 86400)::bigint AS days FROM notices) SELECT notice_id, (1 + (days > 2)::int + CASE type {_case(V.PLAYBOOK)} ELSE 0 END + 1 + {len(V.PLAYBOOK_TAIL)})::bigint AS items, CASE WHEN days < 0 THEN 'Deadline has passed — verify if still open' ELSE 'Submit the response before the deadline' END AS first_action FROM x")
def checklist_expand(spark, d):
    items = checklist(notices(spark, d), F.lit("1998-06-15 12:00:00").cast("timestamp"))
    return items.groupBy("notice_id").agg(F.count("*").alias("items"), F.min_by("action", "position").alias("first_action"))


@query(f"""WITH {NOTICES_SQL} SELECT notice_id, 'Inquiry: ' || title AS subject, 'Dear Contracting Officer,' || chr(10) || chr(10) || 'I am writing for Acme about "' || title || '" (' || notice_id || '), posted by ' || split_part(path, '.', 1) || ' (NAICS ' || naics || ').' || chr(10) || chr(10) || 'Acme specializes in pumps. We note the response deadline of ' || strftime(deadline, '%B %d, %Y') || '. Please tell us how responses are to be submitted and whether amendments are expected.' || chr(10) || chr(10) || 'Best regards,' || chr(10) || 'A. Doe' AS body, 'metadata: title, number, agency; metadata: naics; metadata: deadline' AS sources FROM notices""")
def outreach_text(spark, d):
    n = notices(spark, d).withColumn("agency", N.agency(F.col("path")))
    return outreach(n, {"company": "Acme", "capabilities": "pumps", "sender": "A. Doe"})


@query("SELECT conv_id, count(*)::bigint AS sections, bool_or(role = 'user') AS has_user, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END)::bigint AS replies FROM conversations GROUP BY conv_id")
def section_counts(spark, d):
    role = F.col("role")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("sections"), F.bool_or(role == "user").alias("has_user"), F.count_if(role == "assistant").alias("replies"))


@query("SELECT conv_id, turn, CASE WHEN turn = 1 THEN 'edited' ELSE role END AS role FROM conversations")
def section_edits(spark, d):
    """Edits join back by row; what is not edited stays."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    edits = c.where("turn = 1").select("conv_id", "turn", F.lit("edited").alias("edit"))
    return c.join(edits, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce(non_empty(F.col("edit")), F.col("role")).alias("role"))
