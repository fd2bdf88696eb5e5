"""Queries over records of several types and candidates of several sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import links as L
from ..plans.candidates import gathered_candidates
from ..registry import query
from ..sources.tables import NOTICES_SQL, notices
from .notices import _map


def _replies(spark, d):
    """Replies of a linked page for each notice: some are missing, broken or empty, and fields have several types."""
    n, k = notices(spark, d), F.col("notice_no") % 8
    s = lambda *pairs: F.to_json(F.struct(*[v.alias(name) for name, v in pairs]))
    list_ = lambda *items: F.concat(F.lit("["), F.array_join(F.array(*items), ","), F.lit("]"))
    quoted = lambda c: F.to_json(F.array(c))
    person = lambda kind: s(("fullName", F.concat("title", F.lit(" " + kind))), ("type", F.lit(kind)))
    broken = list_(F.lit("5"), F.lit('{"fullName":7,"type":"primary"}'), person("secondary"))
    whole = list_(person("secondary"), person("primary"))
    codes = list_(F.lit('{"type":"other","code":"X"}'), F.concat(F.lit('{"type":"primary","code":'), quoted(F.col("naics")), F.lit("}")))
    city = F.when(k < 6, s(("name", F.col("set_aside")))).otherwise(F.to_json(F.struct(F.col("set_aside").alias("code"))))
    words = F.concat(F.lit("<p>"), "title", F.lit("</p>"))
    plain = F.regexp_replace(quoted(words), r"^\[|\]$", "")
    text = F.when(k == 3, plain).when(k == 4, F.concat(F.lit('{"body":'), plain, F.lit("}"))).otherwise(F.concat(F.lit('[{"body":'), plain, F.lit("}]")))
    page = F.concat(
        F.lit('{"data2":{"title":'), F.regexp_replace(quoted(F.col("title")), r"^\[|\]$", ""), F.lit(',"type":"'), "type", F.lit('","naics":'), codes, F.lit(',"pointOfContact":'), F.when(k == 3, broken).otherwise(whole),
        F.lit(',"placeOfPerformance":{"city":'), city, F.lit('}},"postedDate":"'), F.col("posted").cast("string"), F.lit('","description":'), text, F.lit("}"),
    )
    raw = F.when(k == 1, "<html>").when(k == 2, '{"data2":{}}').otherwise(page)
    return n.select("notice_id", F.when(k == 0, 404).otherwise(200).alias("http"), F.when(k != 0, raw).alias("raw"))


@query(f"""WITH {NOTICES_SQL}, x AS (SELECT *, notice_no % 8 AS k, notice_no % 8 > 2 AS ok FROM notices)
SELECT notice_id, CASE k WHEN 0 THEN 'not_found' WHEN 1 THEN 'not_json' WHEN 2 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN ok THEN title END AS title, CASE WHEN ok THEN {_map(V.NOTICE_TYPES, 'type')} END AS type, CASE WHEN ok THEN naics END AS naics,
CASE WHEN ok THEN posted::varchar END AS posted, CASE WHEN ok THEN CASE WHEN k = 3 THEN 1 ELSE 2 END END::int AS n_contacts, CASE WHEN ok THEN title || CASE WHEN k = 3 THEN ' secondary' ELSE ' primary' END END AS contact, CASE WHEN ok THEN set_aside END AS city, CASE WHEN ok THEN title END AS description FROM x""")
def link_records_typed(spark, d):
    """Linked pages read as VARIANT."""
    r = L.link_records(_replies(spark, d))
    n = F.when(F.col("status") == "ok", F.size("contacts"))
    return r.select("notice_id", "status", "title", "type", "naics", "posted", n.alias("n_contacts"), F.col("contact.fullName").alias("contact"), F.col("place.city").alias("city"), "description")


@query(f"""WITH {NOTICES_SQL} SELECT notice_id, i::int AS position, CASE WHEN i = 0 THEN 'https://x.org/' || notice_id WHEN i = 1 THEN '{L.DOWNLOAD_URL.replace("{}", "' || naics || '")}' ELSE 'https://bare.org/' || notice_id END AS url, CASE i WHEN 0 THEN title WHEN 1 THEN 'f.pdf' END AS name FROM notices, range(0, 3) t(i)""")
def link_attachments(spark, d):
    """Files of linked pages: a link, a download and a bare link, in a list of groups or one group."""
    group = F.to_json(F.struct(
        F.array(F.struct(F.lit("link").alias("type"), F.concat(F.lit("https://x.org/"), "notice_id").alias("uri"), F.lit(None).cast("string").alias("resourceId"), F.col("title").alias("name")), F.struct(F.lit("file").alias("type"), F.lit(None).cast("string").alias("uri"), F.col("naics").alias("resourceId"), F.lit("f.pdf").alias("name"))).alias("attachments"),
        F.array(F.concat(F.lit("https://bare.org/"), "notice_id")).alias("resourceLinks"),
    ))
    groups = F.when(F.col("notice_no") % 2 == 0, group).otherwise(F.concat(F.lit("[null,7,"), group, F.lit("]")))
    raw = F.concat(F.lit('{"_embedded":{"opportunityAttachmentList":'), groups, F.lit("}}"))
    return L.attachments(notices(spark, d).select("notice_id", raw.alias("raw")))


_ASKED, _BROAD, _OWN = ["customer 1", "2 customer", "asia 3", "customer 000", "europe"], ["america"], ["BUILDING"]


@query(f"""WITH {NOTICES_SQL}, q AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{a}', {i < 3})" for i, a in enumerate(_ASKED))}) t(no, query, live)),
n AS (SELECT *, lower(title || ' ' || path) AS full_text FROM notices),
m AS (SELECT no, live, n.*, list_bool_and(list_transform(string_split(query, ' '), lambda w: contains(lower(title), w))) AS in_title, list_bool_and(list_transform(string_split(query, ' '), lambda w: contains(full_text, w))) AS in_text, naics = 'BUILDING' AS own FROM q CROSS JOIN n),
has AS (SELECT no, bool_or(in_text AND own) AS any_own FROM m GROUP BY no),
h AS (SELECT *, 0 AS o, 'live' AS source FROM m WHERE in_title AND live AND no < 2 AND notice_no % 2 = 0 UNION ALL SELECT *, 1, 'cache' FROM m WHERE in_title AND notice_no % 3 = 0 UNION ALL SELECT m.*, 2, 'crawl' FROM m JOIN has USING (no) WHERE in_text AND (own OR NOT any_own)),
p AS (SELECT *, row_number() OVER (PARTITION BY no, o ORDER BY posted DESC, notice_id) AS place FROM h QUALIFY place <= 25)
SELECT notice_id, first(source ORDER BY no, o, place) AS source, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(DISTINCT no)::bigint AS n_queries FROM p GROUP BY notice_id""")
def candidates_gathered(spark, d):
    """Notices from a keyed service, the cache and a crawl, the first source first; two of the live requests are affordable."""
    n = notices(spark, d)
    crawl = n.withColumn("full_text", F.concat_ws(" ", "title", "path"))
    found = gathered_candidates(n.where("notice_no % 2 = 0"), n.where("notice_no % 3 = 0"), crawl, _ASKED, _BROAD, naics=_OWN, left=2, top_k=20, order=[F.desc("posted")])
    return found.select("notice_id", "source", F.array_join("sources", ",").alias("sources"), F.size("matched").cast("long").alias("n_queries"))
