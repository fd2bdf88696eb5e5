"""Column functions that bring raw notice fields into shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import non_empty, stripped


def agency(path: Column) -> Column:
    """The first segment of a dotted path; null for an empty one."""
    return non_empty(stripped(F.get(F.split(non_empty(path), "[.]"), 0)))


def office(path: Column) -> Column:
    return non_empty(stripped(F.element_at(F.split(non_empty(path), "[.]"), -1)))


def currency(raw: Column) -> Column:
    """A number in text with $ and thousands separators; null where it is none. Underscores between digits pass, suffixes do not."""
    bare = stripped(F.regexp_replace(raw, "[$,]", ""))
    ok = bare.rlike(r"(?i)^[+-]?(?:(?:\d+(?:_\d+)*)?(?:\.(?:\d+(?:_\d+)*)?)?(?:e[+-]?\d+(?:_\d+)*)?|nan|inf(?:inity)?)$") & bare.rlike(r"(?i)\d|nan|inf")
    named = F.when(bare.rlike("(?i)nan"), "NaN").when(bare.rlike("(?i)^-inf"), "-Infinity").when(bare.rlike("(?i)inf"), "Infinity")
    return F.when(ok, F.coalesce(named, F.replace(bare, F.lit("_"))).try_cast("double"))


def moment(raw: Column) -> Column:
    """A timestamp (UTC session) in one of the notice formats, or null."""
    text = F.regexp_replace(stripped(raw), "Z", "+00:00")
    text = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:[+-]\d{2}:\d{2})?)?$"), text.try_cast("timestamp"))
    return F.coalesce(iso, F.try_to_timestamp(F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), text), F.lit("M/d/yyyy")))


def days_left(deadline: Column, as_of: Column) -> Column:
    """Whole days until the deadline, rounded down: an hour late is -1."""
    return F.floor((F.unix_micros(deadline) - F.unix_micros(as_of)) / F.lit(86_400_000_000)).cast("long")


def deadline_key(days: Column) -> Column:
    """The order of deadlines: future ones first, then past ones, then none."""
    return F.when(days.isNull(), 1e9).when(days < 0, 1e8 + F.abs(days)).otherwise(days.cast("double"))


def notice_label(code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in V.NOTICE_TYPES.items() for x in kv]), code)


def set_aside_label(code: Column) -> Column:
    """The description of a set-aside code; an unknown code stands for itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in V.SET_ASIDES.items() for x in kv]), code), code)


def one_line(*parts: Column) -> Column:
    return F.concat_ws(", ", *[non_empty(p) for p in parts])


def primary(contacts: Column) -> Column:
    """The first contact of type primary, else the first."""
    return F.coalesce(F.get(F.filter(contacts, lambda c: F.lower(c["type"]) == "primary"), 0), F.get(contacts, 0))


def display_name(name: Column, email: Column) -> Column:
    return F.coalesce(non_empty(name), non_empty(email), F.lit("(unnamed contact)"))


def reachable(email: Column, phone: Column) -> Column:
    """Whether a contact has an address or a number."""
    return non_empty(email).isNotNull() | non_empty(phone).isNotNull()


def linked_notice(raw: Column) -> Column:
    """struct(notice_id, error) of a pasted link, or of a bare id of 16 letters and digits or more: nothing else will do."""
    text = stripped(F.coalesce(raw, F.lit("")))
    found = F.coalesce(non_empty(F.regexp_extract(text, "/opp/([A-Za-z0-9]+)", 1)), F.when(text.rlike("^[A-Za-z0-9]{16,}$"), text))
    return F.struct(found.alias("notice_id"), F.when(text == "", "empty").when(found.isNull(), "not_a_link").alias("error"))


def redacted(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    """A line of a log without what it must not tell: the values of parameters with a secret's name, and these secrets wherever they are."""
    out = F.regexp_replace(text, rf"(?i)\b({'|'.join(SECRET_NAMES)})=[^&\s]+", "$1=***")
    for secret in secrets:
        if secret:
            out = F.replace(out, F.lit(secret), F.lit("***"))
    return out


def notice_reference(raw: Column) -> Column:
    """struct(notice_id, link, error) of a pasted notice link or bare id."""
    text = stripped(F.coalesce(raw, F.lit("")))
    url = F.lower(text).contains("sam.gov") | F.lower(text).startswith("http")
    found = non_empty(F.regexp_extract(text, r"(?i)/opp/([A-Za-z0-9]+)", 1))
    bad = text.rlike(r"(?U)\s|/")
    error = F.when(text == "", "empty").when(url & found.isNull(), "no_id_in_link").when(~url & bad, "not_an_id")
    return F.struct(F.when(error.isNotNull(), None).when(url, found).otherwise(text).alias("notice_id"), F.when(error.isNull() & url, text).alias("link"), error.alias("error"))


def response_kind(status: Column, detail: Column) -> Column:
    """How a response is taken: ok, auth, rate_limit or error. The status is looked at before the text."""
    return F.when(status == 200, "ok").when(status.isin(401, 403), "auth").when((status == 429) | F.lower(detail).contains("rate limit"), "rate_limit").otherwise("error")


def masked(key: Column) -> Column:
    """A key with all but its ends hidden."""
    return F.when(F.length(key) <= 8, F.repeat(F.lit("*"), F.length(key))).otherwise(F.concat(F.substring(key, 1, 4), F.lit("…"), F.right(key, F.lit(4))))


SECRET_NAMES = ("api_key", "apikey", "key", "token")


def scrubbed(params: Column) -> Column:
    """A parameter map without secrets and nulls."""
    return F.map_filter(params, lambda k, v: ~F.lower(k).isin(*SECRET_NAMES) & v.isNotNull())


def _escaped(x: Column) -> Column:
    """A text inside JSON of ASCII alone: other characters by their UTF-16 code units."""
    plain = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    short = F.create_map(*[F.lit(v) for pair in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")) for v in pair])
    each = F.transform(F.split(plain, ""), lambda c: F.when(c.rlike(r"\A[ -~]?\z"), c).otherwise(F.coalesce(F.try_element_at(short, c), units(c))))
    return F.when(plain.rlike("[^ -~]"), F.array_join(each, "")).otherwise(plain)


def cache_key(endpoint: Column, params: Column) -> Column:
    """SHA-256 of endpoint and scrubbed parameters as compact JSON with sorted keys, whatever their characters."""
    pairs = F.array_sort(F.map_entries(scrubbed(params)))
    quote = lambda x: F.concat(F.lit('"'), _escaped(x), F.lit('"'))
    body = F.array_join(F.transform(pairs, lambda e: F.concat(quote(e["key"]), F.lit(":"), quote(e["value"]))), ",")
    return F.sha2(F.concat(F.lit('{"endpoint":'), quote(endpoint), F.lit(',"params":{'), body, F.lit("}}")), 256)


def is_fresh(created: Column, ttl: Column, now: Column) -> Column:
    """Whether a cached response may be used: always below a ttl of 0, never at 0."""
    return F.when(ttl < 0, True).when(ttl == 0, False).otherwise(now < created + ttl)


def age_label(seconds: Column) -> Column:
    unit = lambda n, u: F.concat(F.floor(seconds / n).cast("string"), F.lit(u + " ago"))
    return F.when(seconds < 60, "just now").when(seconds < 3600, unit(60, "m")).when(seconds < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def upload_label(mb: Column) -> Column:
    gb = F.floor(mb / 1000).cast("string")
    return F.when((mb >= 1000) & (mb % 1000 == 0), F.concat(gb, F.lit(" GB"))).otherwise(F.concat(mb.cast("string"), F.lit(" MB")))
