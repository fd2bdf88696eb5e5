"""Queries over records as services send them: rows of the tables written as JSON and read back, files, references by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import vocabulary as V
from ..operators import records as R
from ..registry import query
from ..sources.tables import table
from ..storage import scratch_path
from .documents import _HTML

_AWARD = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN 'flat' ELSE c_name END AS name, CASE o_orderkey % 4 WHEN 0 THEN 'U' || c_custkey END AS uei FROM orders JOIN customer ON o_custkey = c_custkey"


@query(_AWARD)
def award_flatten(spark, d):
    """Awards whose awardee is an object, a name, or beside flat fields."""
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_name")
    k = F.col("o_orderkey") % 4
    name = F.col("c_name")
    full = F.to_json(F.struct(F.struct(name.alias("name"), F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("uei")).alias("awardee")))
    plain = F.to_json(F.struct(name.alias("awardee")))
    flat = F.to_json(F.struct(F.lit("flat").alias("awardee_name"), name.alias("awardee")))
    raw = F.when(k == 0, full).when(k == 1, plain).when(k == 2, flat).otherwise("{}")
    joined = o.join(c, o.o_custkey == c.c_custkey).withColumn("a", R.awardee(raw))
    return joined.select("o_orderkey", "a.name", "a.uei")


@query(f"""SELECT o_orderkey::varchar AS notice_id, CASE WHEN o_orderkey % 3 = 0 THEN 'SAM.gov opportunity ' || o_orderkey ELSE c_name END AS title,
CASE WHEN o_orderstatus = 'F' THEN '{V.NOTICE_TYPES["a"]}' WHEN o_orderstatus = 'O' THEN 'Own label' END AS type, r_name || '.' || CASE WHEN o_orderkey % 2 = 0 THEN n_name || '.' ELSE '' END || c_name AS path,
c_mktsegment AS naics, '{V.SET_ASIDES["SBA"]}' AS set_aside, 'https://sam.gov/opp/' || o_orderkey || '/view' AS url
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderkey % 5 <> 0""")
def search_records(spark, d):
    """Orders as a search's records: ids under one of three keys, or none."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    places = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(places, c.c_nationkey == places.n_nationkey)
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    when = lambda x: F.when(k % 5 == x, key)
    level = lambda i, x: F.struct(F.lit(i).alias("level"), x.alias("name"))
    raw = F.to_json(F.struct(
        when(1).alias("_id"), F.coalesce(when(2), when(3)).alias("id"), when(4).alias("noticeId"),
        F.when(k % 3 != 0, F.col("c_name")).otherwise(" ").alias("title"),
        F.struct(F.when(F.col("o_orderstatus") == "O", "Own label").alias("value"), F.when(F.col("o_orderstatus") == "F", "A").alias("code")).alias("type"),
        F.array(level(3, F.col("c_name")), level(1, F.col("r_name")), level(2, F.when(k % 2 == 0, F.col("n_name")).otherwise(""))).alias("organizationHierarchy"),
        F.array(F.struct(F.array(F.lit("other")).alias("code"), F.lit("secondary").alias("type")), F.struct(F.array("c_mktsegment").alias("code"), F.lit("primary").alias("type"))).alias("naics"),
        F.lit("SBA").alias("typeOfSetAside"),
    ))
    return R.search_notices(rows.select(raw.alias("raw")), "raw").select("notice_id", "title", "type", "path", "naics", "set_aside", "url")


@query(_HTML.replace("SELECT page_id, trim(regexp_replace(t,", "SELECT page_id, substr(trim(regexp_replace(t,").replace("chr(10) || chr(32)) AS text FROM c", f"chr(10) || chr(32)), 1, {R.DESCRIPTION_CHARS}) AS text FROM c"))
def descriptions(spark, d):
    """Pages as descriptions: a list of bodies, one body, or the HTML itself."""
    p, k = table(spark, d, "pages"), F.col("page_id") % 3
    body = F.struct(F.col("html").alias("body"))
    raw = F.when(k == 0, F.to_json(F.array(body))).when(k == 1, F.to_json(body)).otherwise(F.col("html"))
    return p.select("page_id", R.description(raw).alias("text"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'MANUAL-' || page_id WHEN page_id % 4 = 1 THEN 'R' || page_id END AS notice_id, CASE WHEN page_id % 4 = 0 THEN 'file ' || page_id WHEN page_id % 4 = 1 THEN 'Manually loaded opportunity · R' || page_id END AS title, CASE WHEN page_id % 4 >= 2 THEN 'no_id_in_link' END AS error FROM pages")
def manual_notices(spark, d):
    p, k = table(spark, d, "pages"), F.col("page_id")
    key = k.cast("string")
    reference = F.when(k % 4 == 0, " ").when(k % 4 == 1, F.concat(F.lit("https://sam.gov/opp/R"), key, F.lit("/view"))).otherwise(F.col("url"))
    made = R.manual_notice(reference, F.lit(" "), F.when(k % 4 == 0, F.concat(F.lit("in/file "), key, F.lit(".pdf"))), key)
    return p.withColumn("m", made).select("page_id", "m.notice_id", "m.title", "m.error")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'over quota' WHEN 1 THEN 'M' || event_id WHEN 2 THEN 'E7' ELSE '[1, ' || event_id || ']' END AS detail FROM events")
def error_details(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    body = F.when(k % 4 == 0, F.lit('{"description": "x", "error": "over quota"}')).when(k % 4 == 1, F.concat(F.lit('{"message": {"message": "M'), k.cast("string"), F.lit('"}}')))
    body = body.when(k % 4 == 2, F.lit('{"errorMessage": {"code": "E7"}}')).otherwise(F.concat(F.lit("[1, "), k.cast("string"), F.lit("]")))
    return e.select("event_id", R.error_detail(body).alias("detail"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN json_extract_string(props, '$.k') END AS k FROM events")
def tolerant_json(spark, d):
    """Properties within prose, and prose without any."""
    e, k = table(spark, d, "events"), F.col("event_id") % 3
    reply = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Here it is:\n```"), "props", F.lit("``` as asked"))).otherwise("no { object")
    return e.select("event_id", F.get_json_object(R.json_object(reply), "$.k").alias("k"))


@query("SELECT page_id, substr(sha256(url), 1, 16) || '__' || CASE WHEN page_id % 2 = 0 THEN 'a_b_' || page_id || '.pdf' ELSE 'none' END AS name FROM pages")
def attachment_names(spark, d):
    p = table(spark, d, "pages")
    header = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("attachment; filename*=UTF-8''a b("), F.col("page_id").cast("string"), F.lit(".pdf; size=1"))).otherwise("inline")
    return p.select("page_id", R.stored_name(F.col("url"), R.file_name(header, F.lit("none"))).alias("name"))


@query("SELECT p_partkey, 2::bigint AS n, p_brand AS first FROM part")
def comma_lists(spark, d):
    p = table(spark, d, "part").select("p_partkey", R.comma_list(F.concat(F.lit(" "), "p_brand", F.lit(" ,, "), "p_type", F.lit(" ,"))).alias("l"))
    return p.select("p_partkey", F.size("l").cast("long").alias("n"), F.get("l", 0).alias("first"))


@query("""SELECT s, count(*)::bigint AS n FROM (SELECT '{"keyword":null,"naics":["' || least(c_mktsegment, 'M') || '","' || greatest(c_mktsegment, 'M') || '"],"page":' || c_nationkey || '}' AS s FROM customer) GROUP BY s""")
def filter_signatures(spark, d):
    s = R.signature(page=F.col("c_nationkey"), naics=F.sort_array(F.array(F.lit("M"), "c_mktsegment")), keyword=F.lit(None).cast("string"))
    return table(spark, d, "customer").select(s.alias("s")).groupBy("s").agg(F.count("*").alias("n"))


_NAMES = "list_extract(['a.txt', 'b.PDF', 'c.html', 'd.bin', 'e.md'], (doc_id % 5 + 1)::bigint)"


@query(f"SELECT doc_id, CASE WHEN {_NAMES} = 'b.PDF' THEN 'plug_in' WHEN {_NAMES} = 'd.bin' THEN 'unsupported' WHEN t = '' THEN 'empty' ELSE 'ok' END AS status, CASE WHEN doc_id % 5 NOT IN (1, 3) AND t <> '' THEN length(substr(t, 1, {R.PREVIEW_CHARS})) END::int AS chars, doc_id % 5 NOT IN (1, 3) AND length(t) > {R.PREVIEW_CHARS} AS truncated FROM (SELECT *, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS t FROM documents)")
def extracted_texts(spark, d):
    """Documents as files of five kinds."""
    name = F.get(F.array(*[F.lit(x) for x in ("a.txt", "b.PDF", "c.html", "d.bin", "e.md")]), (F.col("doc_id") % 5).cast("int"))
    files = table(spark, d, "documents").select("doc_id", name.alias("name"), F.encode("text", "UTF-8").alias("content"))
    return R.extracted(files, "name", "content").select("doc_id", "status", F.length("text").alias("chars"), "truncated")


@query("SELECT event_id, (m // 60)::int AS hours, (m % 60)::int AS minutes FROM (SELECT event_id, floor((86400 - (epoch(ts) - epoch(date_trunc('day', ts)))) / 60)::int AS m FROM events)")
def budget_resets(spark, d):
    return table(spark, d, "events").withColumn("u", R.until_midnight(F.col("ts").cast("timestamp"))).select("event_id", "u.hours", "u.minutes")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::date BETWEEN DATE '1997-05-16' AND DATE '1997-06-15'")
def posted_lately(spark, d):
    return table(spark, d, "orders").where(R.rolling(F.col("o_orderdate").cast("date"), F.lit("1997-06-15").cast("date"))).select("o_orderkey")


@query("SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer")
def csv_export(spark, d):
    """Customers written as CSV and read back."""
    path = scratch_path(spark, "csv")
    R.exported(table(spark, d, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal")), path)
    return spark.read.option("escape", '"').schema("c_custkey long, c_name string, c_acctbal double").csv(path, header=True)


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name || '.path' WHEN 1 THEN n_name WHEN 2 THEN n_name END AS org FROM nation")
def organisation_replies(spark, d):
    """Replies whose organisation is an object, in a list, has only a name, or is missing."""
    n, k = table(spark, d, "nation"), F.col("n_nationkey") % 4
    whole = F.struct(F.struct(F.concat("n_name", F.lit(".path")).alias("fullParentPathName"), F.lit("x").alias("name")).alias("org"))
    named = F.struct(F.struct(F.col("n_name").alias("name")).alias("org"))
    wrap = lambda x: F.to_json(F.struct(x.alias("_embedded")))
    raw = F.when(k == 0, wrap(F.array(whole))).when(k == 1, wrap(named)).when(k == 2, wrap(F.array(named))).otherwise("{}")
    return n.select("n_nationkey", R.organisation_name(raw).alias("org"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'c' || c_custkey || '@x.org' ELSE c_name END AS display, c_custkey % 3 <> 1 AS reachable FROM customer")
def contact_methods(spark, d):
    k = F.col("c_custkey") % 3
    email = F.when(k == 0, F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@x.org"))).otherwise("")
    phone = F.when(k == 2, F.lit("555"))
    return table(spark, d, "customer").select("c_custkey", N.display_name(F.when(k == 0, "").otherwise(F.col("c_name")), email).alias("display"), N.reachable(email, phone).alias("reachable"))
