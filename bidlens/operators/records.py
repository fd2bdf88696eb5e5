"""Records as notice services and pages send them, brought into one shape; files into texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import notice_label, notice_reference, set_aside_label
from ..functions.text import cleaned, html_text, non_empty, stripped

#: Where a notice is shown, and the characters that a description and a preview keep.
NOTICE_URL = "https://sam.gov/opp/{}/view"
DESCRIPTION_CHARS, PREVIEW_CHARS = 40_000, 20_000
#: Keys of an error's detail by precedence, suffixes of text files.
DETAIL_KEYS = ("error", "message", "errormessage", "errorMessage", "description")
TEXT_SUFFIXES = (".txt", ".csv", ".md", ".json", ".xml", ".htm", ".html")


def notice_url(link: Column, notice_id: Column) -> Column:
    before, after = NOTICE_URL.split("{}")
    return F.coalesce(non_empty(link), F.concat(F.lit(before), notice_id, F.lit(after)))


def at(json: Column, *paths: str) -> Column:
    """The first of these paths of a JSON text that holds something."""
    return F.coalesce(*[cleaned(F.get_json_object(json, p)) for p in paths])


def awardee(award: Column) -> Column:
    """struct(name, uei) of an award's JSON text; the awardee is an object or a name, and flat fields come first."""
    raw = F.get_json_object(award, "$.awardee")
    inner = F.when(raw.startswith("{"), at(raw, "$.name"))
    return F.struct(F.coalesce(at(award, "$.awardee_name"), inner, F.when(~raw.startswith("{"), cleaned(raw))).alias("name"), F.coalesce(at(award, "$.awardee_uei"), F.when(raw.startswith("{"), at(raw, "$.ueiSAM", "$.uei"))).alias("uei"))


def hierarchy_path(levels: Column) -> Column:
    """The names of array<struct<level, name>> from the top level down, joined by dots; null without a name. Levels without a number come first."""
    placed = F.transform(levels, lambda x, i: F.struct(F.coalesce(x["level"], F.lit(0)).alias("level"), i.alias("i"), cleaned(x["name"]).alias("name")))
    return non_empty(F.array_join(F.transform(F.filter(F.sort_array(placed), lambda x: x["name"].isNotNull()), lambda x: x["name"]), "."))


def organisation_name(reply: Column) -> Column:
    """The path of an organisation in the JSON text of a lookup, whose `_embedded` is an object or a list."""
    return at(reply, "$._embedded.org.fullParentPathName", "$._embedded[0].org.fullParentPathName", "$._embedded.org.name", "$._embedded[0].org.name")


_LEVELS = "array<struct<level:int,name:string>>"
_CODES = "array<struct<code:array<string>,type:string>>"


def search_notices(records: DataFrame, raw: str) -> DataFrame:
    """Notices of the JSON texts of a search's results; records without an id go. Other columns stay before the notice's."""
    r = F.col(raw)
    codes = F.from_json(F.get_json_object(r, "$.naics"), _CODES)
    first = F.coalesce(F.get(F.filter(codes, lambda x: x["type"] == "primary"), 0), F.get(codes, 0))["code"]
    aside = at(r, "$.typeOfSetAside")
    found = records.withColumn("notice_id", at(r, "$._id", "$.id", "$.noticeId")).where("notice_id IS NOT NULL")
    return found.withColumns({
        "title": F.coalesce(at(r, "$.title"), F.concat(F.lit("SAM.gov opportunity "), F.col("notice_id"))),
        "type": F.coalesce(at(r, "$.type.value"), notice_label(F.lower(F.get_json_object(r, "$.type.code")))),
        "path": hierarchy_path(F.from_json(F.get_json_object(r, "$.organizationHierarchy"), _LEVELS)),
        "naics": F.coalesce(cleaned(F.get(first, 0)), at(r, "$.naicsCode")),
        "set_aside": F.coalesce(at(r, "$.typeOfSetAsideDescription"), set_aside_label(aside)),
        "posted": at(r, "$.publishDate"),
        "deadline": at(r, "$.responseDate"),
        "url": notice_url(F.lit(None).cast("string"), F.col("notice_id")),
    })


def description(raw: Column) -> Column:
    """The text of a description: JSON of a list of bodies, of one body, or HTML as it is; its first characters."""
    body = F.coalesce(F.get_json_object(raw, "$[0].body"), F.get_json_object(raw, "$.body"), F.when(~raw.rlike(r"^\s*[\[{]"), raw), F.lit(""))
    return F.substring(html_text(body), 1, DESCRIPTION_CHARS)


def manual_notice(reference: Column, title: Column, file_name: Column, fallback: Column) -> Column:
    """struct(notice_id, title, link, error) of a notice entered by hand: its id from a reference, else MANUAL- and the fallback;
    its title as given, else the file's name without suffix, else one that says so."""
    parsed = notice_reference(reference)
    none = non_empty(stripped(F.coalesce(reference, F.lit("")))).isNull()
    notice_id = F.when(none, F.concat(F.lit("MANUAL-"), fallback)).otherwise(parsed["notice_id"])
    stem = non_empty(F.regexp_extract(F.coalesce(file_name, F.lit("")), r"([^/]+?)(?:\.[^./]*)?$", 1))
    named = F.coalesce(cleaned(title), stem, F.concat(F.lit("Manually loaded opportunity · "), notice_id))
    error = F.when(~none, parsed["error"])
    return F.struct(notice_id.alias("notice_id"), F.when(error.isNull(), named).alias("title"), parsed["link"].alias("link"), error.alias("error"))


def error_detail(body: Column) -> Column:
    """What an error reply says: the first of its known keys, an object's message or code; else the start of the reply."""
    told = [c for k in DETAIL_KEYS for c in (at(body, f"$.{k}.message"), at(body, f"$.{k}.code"), F.when(~F.coalesce(F.get_json_object(body, f"$.{k}"), F.lit("")).startswith("{"), at(body, f"$.{k}")))]
    return F.coalesce(*told, F.substring(stripped(body), 1, 300))


def json_object(reply: Column) -> Column:
    """The JSON object in a reply: all of it, or from its first brace to its last; null where that is none."""
    inner = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    whole = F.when(F.try_parse_json(reply).isNotNull(), reply)
    return F.coalesce(whole, F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner))


def file_name(disposition: Column, fallback: Column) -> Column:
    """A file's name in a Content-Disposition header, without an encoding's prefix; else the fallback."""
    found = stripped(F.regexp_extract(F.coalesce(disposition, F.lit("")), r'filename\*?="?([^";]+)"?', 1))
    return F.coalesce(non_empty(F.regexp_replace(found, "^.*?''", "")), fallback)


def stored_name(url: Column, name: Column) -> Column:
    """A name for a file's content by where it came from."""
    return F.concat(F.substring(F.sha2(url, 256), 1, 16), F.lit("__"), F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"))


def comma_list(raw: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), stripped), lambda x: x != "")


def signature(**parts: Column) -> Column:
    """JSON of named parts in the order of their names, lists sorted and nulls kept: equal for equal filters."""
    return F.to_json(F.struct(*[parts[n].alias(n) for n in sorted(parts)]), {"ignoreNullFields": "false"})


def extracted(files: DataFrame, name: str, content: str) -> DataFrame:
    """files with suffix, status (ok, empty, unsupported or plug_in for PDF and DOCX), text and truncated.

    Text files are UTF-8 with what is none replaced; HTML stays as it is, as the reader may want its marks. A preview's
    characters are kept; nothing is collected."""
    suffix = F.lower(F.regexp_extract(F.col(name), r"(\.[^./]+)$", 1))
    text = stripped(F.make_valid_utf8(F.col(content).cast("string")))
    plain = suffix.isin(*TEXT_SUFFIXES)
    status = F.when(suffix.isin(".pdf", ".docx"), "plug_in").when(~plain, "unsupported").when(F.coalesce(text, F.lit("")) == "", "empty").otherwise("ok")
    out = files.withColumns({"suffix": suffix, "status": status})
    ok = F.col("status") == "ok"
    return out.withColumns({"text": F.when(ok, F.substring(text, 1, PREVIEW_CHARS)), "truncated": ok & (F.length(text) > PREVIEW_CHARS)})


def extracted_files(spark: SparkSession, path: str) -> DataFrame:
    """path, status, text and truncated of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return extracted(files.select("path", "content"), "path", "content").drop("content")


def exported(rows: DataFrame, path: str) -> None:
    """Writes a table as CSV with a header."""
    rows.write.mode("overwrite").option("escape", '"').csv(path, header=True)


def until_midnight(now: Column) -> Column:
    """struct(hours, minutes) until the session's next midnight."""
    minutes = F.floor((F.unix_micros(F.date_trunc("day", now) + F.expr("INTERVAL 1 DAY")) - F.unix_micros(now)) / 60_000_000).cast("int")
    return F.struct(F.floor(minutes / 60).cast("int").alias("hours"), (minutes % 60).alias("minutes"))


def rolling(day: Column, as_of: Column, days: int = 30) -> Column:
    """Whether a day lies in the last `days` days."""
    return day.between(F.date_sub(as_of, days), as_of)
