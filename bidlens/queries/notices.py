"""Queries over notices: normalisation, search, lookup and ordering."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import vocabulary as V
from ..functions.text import non_empty
from ..operators import search as S
from ..registry import query
from ..sources.tables import NOTICES_SQL, notices, table

AS_OF = "1998-06-15 12:00:00"


def _with(sql: str) -> str:
    return f"WITH {NOTICES_SQL} {sql}"


def _map(values: dict[str, str], key: str) -> str:
    q = lambda s: s.replace("'", "''")
    return f"CASE {key} " + " ".join(f"WHEN '{q(k)}' THEN '{q(v)}'" for k, v in values.items()) + " END"


@query(_with("SELECT notice_id, split_part(path, '.', 1) AS agency, split_part(path, '.', -1) AS office FROM notices"))
def notice_agency_office(spark, d):
    return notices(spark, d).select("notice_id", N.agency(F.col("path")).alias("agency"), N.office(F.col("path")).alias("office"))


@query(_with("SELECT notice_id, title, posted::varchar AS posted FROM notices WHERE lower(title) LIKE '%00001%' AND naics IN ('BUILDING', 'MACHINERY') AND type IN ('o', 'a') AND posted BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' ORDER BY posted DESC, notice_no LIMIT 25 OFFSET 5"))
def notice_search_page(spark, d):
    f = S.Filters(keyword="00001", naics=("BUILDING", " MACHINERY ", ""), types=("o", "a"), posted_from=date(1997, 1, 1), posted_to=date(1997, 12, 31), offset=5)
    return S.page(notices(spark, d), f, [F.desc("posted"), "notice_no"]).select("notice_id", "title", F.col("posted").cast("string").alias("posted"))


@query(_with("SELECT count(*)::bigint AS total, least(25, greatest(count(*) - 50, 0))::bigint AS n, 50 + least(25, greatest(count(*) - 50, 0)) < count(*) AS has_more FROM notices WHERE type = 'a'"))
def notice_page_envelope(spark, d):
    total = notices(spark, d).where(S.Filters(types=("a",)).predicate()).agg(F.count("*").alias("total"))
    n = F.least(F.lit(25), F.greatest(F.col("total") - 50, F.lit(0))).cast("long")
    return total.select("total", n.alias("n"), (50 + n < F.col("total")).alias("has_more"))


@query(_with("SELECT notice_id, title, amount FROM notices WHERE notice_no = (SELECT min(o_orderkey) FROM orders)"))
def notice_by_id(spark, d):
    least = table(spark, d, "orders").agg(F.min("o_orderkey").alias("k"))
    return notices(spark, d).join(F.broadcast(least), F.col("notice_no") == F.col("k")).select("notice_id", "title", "amount").limit(1)


@query(_with("SELECT notice_id, ((row_number() OVER (ORDER BY posted DESC, notice_no) - 1) // 100)::int AS page FROM (SELECT * FROM notices WHERE type = 'k' ORDER BY posted DESC, notice_no LIMIT 250)"))
def notice_pages(spark, d):
    return S.pages(notices(spark, d), S.Filters(types=("k",)), [F.desc("posted"), "notice_no"], most=250).select("notice_id", "page")


@query(_with("SELECT notice_id, title, amount, naics FROM notices WHERE type = 'a' ORDER BY posted DESC, notice_no LIMIT 200"))
def award_search(spark, d):
    return S.pages(notices(spark, d), S.Filters(types=("a",)), [F.desc("posted"), "notice_no"]).select("notice_id", "title", "amount", "naics")


@query(_with(f"""SELECT notice_id AS "Notice ID", CASE WHEN title = '' THEN '(untitled)' ELSE title END AS "Title", split_part(path, '.', 1) AS "Agency", {_map(V.NOTICE_TYPES, 'type')} AS "Type", naics AS "NAICS", set_aside AS "Set-Aside", strftime(deadline, '%Y-%m-%d %H:%M') AS "Deadline", posted::varchar AS "Posted" FROM notices"""))
def notice_table_row(spark, d):
    return notices(spark, d).select(
        F.col("notice_id").alias("Notice ID"),
        F.coalesce(non_empty(F.col("title")), F.lit("(untitled)")).alias("Title"),
        F.coalesce(N.agency(F.col("path")), F.lit("")).alias("Agency"),
        F.coalesce(N.notice_label(F.col("type")), F.col("type")).alias("Type"),
        F.coalesce("naics", F.lit("")).alias("NAICS"),
        F.coalesce(N.set_aside_label(F.col("set_aside")), F.lit("")).alias("Set-Aside"),
        F.coalesce(F.date_format("deadline", "yyyy-MM-dd HH:mm"), F.lit("")).alias("Deadline"),
        F.col("posted").cast("string").alias("Posted"),
    )


@query(_with("SELECT notice_id, CASE WHEN type <> 'k' THEN posted END::varchar AS day FROM notices WHERE type = 'k' OR posted BETWEEN DATE '1996-03-01' AND DATE '1996-05-31'"))
def notice_window_keep_undated(spark, d):
    day = F.when(F.col("type") != "k", F.col("posted"))
    return notices(spark, d).withColumn("day", day).where(S.within(F.col("day"), F.lit(date(1996, 3, 1)), F.lit(date(1996, 5, 31)))).select("notice_id", F.col("day").cast("string").alias("day"))


@query(_with(f"SELECT notice_id, floor((epoch(deadline::timestamp) - epoch(TIMESTAMP '{AS_OF}')) / 86400)::bigint AS days FROM notices"))
def days_left_floor(spark, d):
    return notices(spark, d).select("notice_id", N.days_left(F.col("deadline").cast("timestamp"), F.lit(AS_OF).cast("timestamp")).alias("days"))


@query(_with(f"""SELECT notice_id, k AS deadline_key FROM (SELECT notice_id, notice_no, CASE WHEN x IS NULL THEN 1e9 WHEN x < 0 THEN 1e8 + abs(x) ELSE x END::double AS k
FROM (SELECT *, CASE WHEN type <> 'k' THEN floor((epoch(deadline::timestamp) - epoch(TIMESTAMP '{AS_OF}')) / 86400) END AS x FROM notices))"""))
def deadline_order(spark, d):
    days = F.when(F.col("type") != "k", N.days_left(F.col("deadline").cast("timestamp"), F.lit(AS_OF).cast("timestamp")))
    return notices(spark, d).withColumn("deadline_key", N.deadline_key(days)).select("notice_id", "deadline_key")


@query(_with(f"SELECT type, {_map(V.NOTICE_TYPES, 'type')} AS label, set_aside AS restriction, count(*)::bigint AS n FROM notices GROUP BY ALL"))
def notice_labels(spark, d):
    labelled = notices(spark, d).select("type", N.notice_label(F.col("type")).alias("label"), N.set_aside_label(F.col("set_aside")).alias("restriction"))
    return labelled.groupBy("type", "label", "restriction").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, concat_ws(', ', nullif(c_name, ''), nullif(n_name, ''), nullif(r_name, ''), CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END) AS address FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def address_line(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    segment = F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).otherwise("")
    return joined.select("c_custkey", N.one_line(F.col("c_name"), F.col("n_name"), F.col("r_name"), segment).alias("address"))


@query("SELECT c_nationkey, arg_min(c_custkey, (CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_custkey)) AS contact, arg_min(c_name, (CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_custkey)) AS display FROM customer GROUP BY c_nationkey")
def contact_primary(spark, d):
    """A nation's contacts are its customers, those of one segment primary: the least of each nation, without a list of its people."""
    secondary = F.col("c_mktsegment").eqNullSafe("BUILDING") == F.lit(False)
    first = F.min_by(F.struct("c_custkey", F.col("c_name").alias("name")), F.struct(secondary.alias("secondary"), "c_custkey"))
    people = table(spark, d, "customer").groupBy("c_nationkey").agg(first.alias("first"))
    return people.select("c_nationkey", F.col("first.c_custkey").alias("contact"), N.display_name(F.col("first.name"), F.lit(None).cast("string")).alias("display"))


@query("SELECT c_nationkey, arg_min(c_custkey, (CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_custkey)) AS contact, arg_min(c_name, (CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_custkey)) AS display FROM customer GROUP BY c_nationkey")
def contact_primary_all(spark, d):
    """The same, by its former name."""
    return contact_primary(spark, d)


@query(r"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'ID' || page_id WHEN page_id % 3 = 1 THEN page_id::varchar END AS notice_id, CASE WHEN page_id % 3 = 2 THEN 'no_id_in_link' END AS error FROM pages")
def reference_parse(spark, d):
    k = F.col("page_id")
    raw = F.when(k % 3 == 0, F.concat(F.lit("https://SAM.gov/opp/ID"), k.cast("string"), F.lit("/view?x=1"))).when(k % 3 == 1, F.concat(F.lit("  "), k.cast("string"), F.lit("\t"))).otherwise(F.col("url"))
    return table(spark, d, "pages").withColumn("r", N.notice_reference(raw)).select("page_id", "r.notice_id", "r.error")


@query(_with("SELECT notice_id, concat_ws(' ', nullif(title, ''), nullif(naics, ''), nullif(set_aside, ''), split_part(path, '.', -1), split_part(path, '.', 1)) AS text, 'Title: ' || title || chr(10) || 'NAICS: ' || naics || chr(10) || 'Posted: ' || posted AS block FROM notices"))
def notice_texts(spark, d):
    n = notices(spark, d)
    text = F.concat_ws(" ", *[non_empty(F.col(c)) for c in ("title", "naics", "set_aside")], N.office(F.col("path")), N.agency(F.col("path")))
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(non_empty(F.col(c).cast("string")), F.lit("N/A")))
    return n.select("notice_id", text.alias("text"), F.concat_ws("\n", line("Title", "title"), line("NAICS", "naics"), line("Posted", "posted")).alias("block"))


@query(_with("SELECT notice_id, CASE WHEN posted >= DATE '2000-01-01' THEN 'latest' ELSE 'pool' END AS origin FROM notices WHERE posted >= DATE '2000-01-01' OR type = 'a'"))
def pool_overlay(spark, d):
    n = notices(spark, d)
    latest = n.where("posted >= '2000-01-01'").select("notice_id", F.lit("latest").alias("origin"))
    pool = n.where("type = 'a'").select("notice_id", F.lit("pool").alias("origin"))
    return S.overlaid(latest, pool, "notice_id")


@query("SELECT c_custkey, coalesce(n_name, '') AS org FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0")
def org_lookup(spark, d):
    orgs = table(spark, d, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", "n_name")
    c = table(spark, d, "customer")
    return c.join(orgs, c.c_nationkey == orgs.n_nationkey, "left").select("c_custkey", F.coalesce("n_name", F.lit("")).alias("org"))


@query("SELECT event_id, CASE WHEN s = 200 THEN 'ok' WHEN s IN (401, 403) THEN 'auth' WHEN s = 429 OR d LIKE '%rate limit%' THEN 'rate_limit' ELSE 'error' END AS kind FROM (SELECT event_id, list_extract([200, 401, 403, 429, 400, 500], (event_id % 6 + 1)::bigint) AS s, CASE WHEN event_id % 5 = 0 THEN 'over rate limit' ELSE event_type END AS d FROM events)")
def response_kinds(spark, d):
    e = table(spark, d, "events")
    status = F.get(F.array(*[F.lit(x) for x in (200, 401, 403, 429, 400, 500)]), (F.col("event_id") % 6).cast("int"))
    detail = F.when(F.col("event_id") % 5 == 0, "Over RATE limit").otherwise(F.col("event_type"))
    return e.select("event_id", N.response_kind(status, detail).alias("kind"))


_LINK = "data2 struct<title:string,type:string,organizationId:string,naics:array<struct<code:array<string>,type:string>>,placeOfPerformance:struct<city:struct<code:string,name:string>>,pointOfContact:array<struct<fullName:string,type:string>>>, postedDate string"


@query(_with(f"SELECT notice_id, {_map(V.NOTICE_TYPES, 'type')} AS label, naics, split_part(path, '.', 2) AS city, title AS contact, CASE WHEN notice_no % 7 = 0 THEN 'empty' ELSE 'ok' END AS status, posted::varchar AS posted FROM notices").replace("SELECT notice_id, CASE", "SELECT notice_id, CASE"))
def link_record_parse(spark, d):
    """Nested records, as a notice's page has them, written as JSON and read back."""
    n = notices(spark, d)
    text = F.to_json(F.struct(
        F.struct("title", "type", F.array(F.struct(F.array(F.lit("other")).alias("code"), F.lit("secondary").alias("type")), F.struct(F.array("naics").alias("code"), F.lit("primary").alias("type"))).alias("naics"),
                 F.struct(F.struct(F.lit("X").alias("code"), F.get(F.split("path", "[.]"), 1).alias("name")).alias("city")).alias("placeOfPerformance"),
                 F.array(F.struct(F.col("title").alias("fullName"), F.lit("primary").alias("type"))).alias("pointOfContact")).alias("data2"),
        F.col("posted").cast("string").alias("postedDate"),
    ))
    raw = n.select("notice_id", "notice_no", text.alias("raw")).withColumn("r", F.from_json("raw", _LINK))
    p = F.col("r.data2")
    codes = p["naics"]
    first = F.coalesce(F.get(F.filter(codes, lambda x: x["type"] == "primary"), 0), F.get(codes, 0))
    status = F.when(F.col("notice_no") % 7 == 0, "empty").when(p.isNull(), "not_json").otherwise("ok")
    return raw.select(
        "notice_id",
        N.notice_label(p["type"]).alias("label"),
        F.get(first["code"], 0).alias("naics"),
        F.coalesce(p["placeOfPerformance"]["city"]["name"], p["placeOfPerformance"]["city"]["code"]).alias("city"),
        N.primary(p["pointOfContact"])["fullName"].alias("contact"),
        status.alias("status"),
        F.col("r.postedDate").alias("posted"),
    )


@query("SELECT o_orderkey, l_linenumber AS position, CASE WHEN l_linenumber % 2 = 0 THEN 'https://files.example/' || l_partkey || '/download' ELSE 'link-' || l_suppkey END AS url FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def attachments_listing(spark, d):
    """An order's attachments are its lines; orders without any stay with nulls."""
    o = table(spark, d, "orders").select("o_orderkey")
    items = table(spark, d, "lineitem")
    listed = o.join(items.select("l_orderkey", F.col("l_linenumber").alias("position"), "l_partkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    url = F.when(F.col("position") % 2 == 0, F.concat(F.lit("https://files.example/"), F.col("l_partkey").cast("string"), F.lit("/download"))).otherwise(F.concat(F.lit("link-"), F.col("l_suppkey").cast("string")))
    return listed.select("o_orderkey", "position", url.alias("url"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'ing') AND contains(lower(text), 'and')")
def full_text_search(spark, d):
    return table(spark, d, "documents").where(S.has_all_terms(F.col("text"), F.lit("The  ING and"))).select("doc_id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 2 = 0 THEN 'abcd…' || lpad((event_id % 10000)::varchar, 4, '0') ELSE '****' END AS hidden FROM events")
def masked_keys(spark, d):
    key = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("abcdefgh"), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0"))).otherwise("abcd")
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), N.masked(key).alias("hidden"))


@query("SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age FROM (SELECT event_id, floor(epoch(TIMESTAMP '2024-02-01') - epoch(ts))::bigint AS s FROM events)")
def event_ages(spark, d):
    s = F.floor((F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1_000_000)
    return table(spark, d, "events").select("event_id", N.age_label(s).alias("age"))
