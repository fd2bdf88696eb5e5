"""Notices as a linked page sends them, in JSON whose fields are of several types: read as VARIANT, so that a value's own type decides.

A record that cannot be read has a status instead of fields: not_found, http_error, not_json or empty. What is malformed inside of a record, such as a
contact that is no object or has a number for a name, is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import notice_label, primary, set_aside_label
from ..functions.text import cleaned, html_text
from .records import DESCRIPTION_CHARS

#: Fixed value: where an attached resource is downloaded.
DOWNLOAD_URL = "https://sam.gov/api/prod/opps/v3/opportunities/resources/files/{}/download"
#: Fields of a contact; each is a text or missing.
CONTACT = ("fullName", "title", "email", "phone", "fax", "type")


def kind(v: Column) -> Column:
    """The type of a variant: OBJECT, ARRAY, STRING, BIGINT and so on; null without one."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def said(v: Column, path: str) -> Column:
    """A plain value as stripped text; null for objects, arrays and where nothing is left."""
    return F.when(kind(part(v, path)).isin("OBJECT", "ARRAY"), None).otherwise(cleaned(F.try_variant_get(v, path, "string")))


def every(v: Column, path: str) -> Column:
    """The elements of an array; none where there is something else."""
    return F.when(kind(part(v, path)) == "ARRAY", F.try_variant_get(v, path, "array<variant>")).otherwise(F.expr("cast(array() as array<variant>)"))


def first_code(v: Column, path: str) -> Column:
    """The first code of a list of {type, code}, where primary ones go first and a code is a text or a list of them."""
    entries = F.filter(every(v, path), lambda e: kind(e) == "OBJECT")
    code = lambda e: F.coalesce(F.when(kind(part(e, "$.code")) == "ARRAY", said(e, "$.code[0]")), said(e, "$.code"))
    of = lambda main: F.filter(F.transform(F.filter(entries, lambda e: F.coalesce(said(e, "$.type") == "primary", F.lit(False)) == F.lit(main)), code), lambda c: c.isNotNull())
    return F.coalesce(F.get(of(True), 0), F.get(of(False), 0))


def contacts(v: Column, path: str) -> Column:
    """array<struct> of the contacts that are objects and have nothing but texts in their fields."""
    sound = lambda c: (kind(c) == "OBJECT") & F.forall(F.array(*[F.coalesce(kind(part(c, f"$.{n}")), F.lit("VOID")) for n in CONTACT]), lambda k: k.isin("STRING", "VOID"))
    return F.transform(F.filter(every(v, path), sound), lambda c: F.struct(*[F.try_variant_get(c, f"$.{n}", "string").alias(n) for n in CONTACT]))


def place(v: Column, path: str) -> Column:
    """struct(city, state, zip, country) of a place, whose parts are {name, code} or plain; null where it is no object."""
    name = lambda n: F.coalesce(said(v, f"{path}.{n}.name"), said(v, f"{path}.{n}.code"), said(v, f"{path}.{n}"))
    return F.when(kind(part(v, path)) == "OBJECT", F.struct(*[name(n).alias(n) for n in ("city", "state", "zip", "country")]))


def body(v: Column, path: str) -> Column:
    """The text of a description: a text, an object with a body, or a list of which the first counts."""
    of = kind(part(v, path))
    raw = F.when(of == "ARRAY", F.try_variant_get(v, f"{path}[0].body", "string")).when(of == "OBJECT", F.try_variant_get(v, f"{path}.body", "string")).when(of == "STRING", F.try_variant_get(v, path, "string"))
    return F.substring(html_text(F.coalesce(raw, F.lit(""))), 1, DESCRIPTION_CHARS)


def link_records(replies: DataFrame) -> DataFrame:
    """Notices of replies (notice_id, http int, raw): status, title, number, type, naics, set_aside, posted, deadline, contacts, contact (the
    primary one), place and description. Only those of status ok have fields."""
    v = F.col("v")
    read = replies.withColumn("v", F.try_parse_json("raw"))
    status = F.when(F.col("http") == 404, "not_found").when(F.col("http") >= 400, "http_error").when((F.col("v").isNull()) | ~kind(v).eqNullSafe("OBJECT"), "not_json")
    status = status.when(~kind(part(v, "$.data2")).eqNullSafe("OBJECT") | (F.schema_of_variant(part(v, "$.data2")) == "OBJECT<>"), "empty").otherwise("ok")
    read = read.withColumn("status", status).withColumn("v", F.when(F.col("status") == "ok", F.col("v")))
    aside = F.coalesce(*[said(v, p) for p in ("$.data2.typeOfSetAside", "$.data2.solicitation.setAside", "$.data2.solicitation.setAsideType", "$.data2.setAside")])
    ok = lambda c: F.when(F.col("status") == "ok", c)
    read = read.withColumns({
        "title": ok(F.coalesce(said(v, "$.data2.title"), F.concat(F.lit("SAM.gov opportunity "), "notice_id"))),
        "number": said(v, "$.data2.solicitationNumber"),
        "type": notice_label(F.lower(said(v, "$.data2.type"))),
        "naics": first_code(v, "$.data2.naics"),
        "set_aside": set_aside_label(aside),
        "posted": said(v, "$.postedDate"),
        "deadline": said(v, "$.data2.solicitation.deadlines.response"),
        "contacts": ok(contacts(v, "$.data2.pointOfContact")),
        "place": place(v, "$.data2.placeOfPerformance"),
        "description": ok(body(v, "$.description")),
    })
    return read.withColumn("contact", primary(F.col("contacts"))).drop("v", "raw", "http")


def attachments(replies: DataFrame) -> DataFrame:
    """notice_id, position, url and name of the files that replies (notice_id, raw) list, in their order: groups are a list or one object; a
    link is taken by its address, another file by its number, and bare links follow their group's files."""
    v = F.try_parse_json("raw")
    path = "$._embedded.opportunityAttachmentList"
    groups = F.when(kind(part(v, path)) == "OBJECT", F.array(part(v, path))).otherwise(every(v, path))
    number = lambda a: F.coalesce(said(a, "$.resourceId"), said(a, "$.id"))
    before, after = DOWNLOAD_URL.split("{}")

    def one(a: Column) -> Column:
        link = (said(a, "$.type") == "link") & said(a, "$.uri").isNotNull()
        url = F.when(link, said(a, "$.uri")).otherwise(F.concat(F.lit(before), number(a), F.lit(after)))
        return F.struct(url.alias("url"), F.when(link, F.coalesce(said(a, "$.name"), said(a, "$.uri"))).otherwise(said(a, "$.name")).alias("name"))

    bare = lambda x: F.struct(said(x, "$").alias("url"), F.lit(None).cast("string").alias("name"))
    of = lambda g: F.concat(F.transform(F.filter(every(g, "$.attachments"), lambda a: kind(a) == "OBJECT"), one), F.transform(F.filter(every(g, "$.resourceLinks"), lambda x: kind(x) == "STRING"), bare))
    listed = F.filter(F.flatten(F.transform(F.filter(groups, lambda g: kind(g) == "OBJECT"), of)), lambda f: f["url"].isNotNull())
    return replies.select("notice_id", F.posexplode(listed).alias("position", "f")).select("notice_id", "position", "f.url", "f.name")
