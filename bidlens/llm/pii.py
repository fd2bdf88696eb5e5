"""Personal data in whole texts: patterns propose spans, checksums confirm them, words nearby move their score.

DataFrame functions only. A kind's matches are its pattern's leftmost non-overlapping ones; a match that its check
refuses is dropped, without another try within it. Offsets are code points, the end exclusive: the pieces that the
text falls into between the matches add up to them.

The patterns are written to run in linear time on any text: a match can begin only where a run of its characters
does, or where the last match ended (\\G), and runs are possessive. That changes no match.

Four kinds (email, ip, card, phone) are the base and always stay. The method adds iban, confirmed by mod 97; ssn,
which has no checksum and so needs a context word; and secrets: a value of 16 characters or more, with letters and
digits, that a word such as token or password is given, and keys known by their form. Null and empty texts have no
spans. Every row is a document by itself, repeated ones and those without id too; other columns pass through,
whatever their names, but for `findings`, which is replaced. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import unused

_LOCAL = "[A-Za-z0-9._%+-]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Characters on either side of a match in which context words count.
CONTEXT_CHARS = 40
#: Matches that so many characters can hold, and one: none is shorter than four.
CONTEXT_MATCHES = 11
#: What an added span's score must reach.
LEAST_SCORE = 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    context: str
    base: bool = True
    gate: str = ""  # a fixed string without which the pattern can't match


KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|kontakt|correo|courriel", gate="@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", 0.6, "address|host|server|adresse|login", gate="."),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", 0.8, "card|visa|master|credit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, "phone|call|tel|fax|mobile|anruf", gate="+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.8, "iban|bank|account|konto|cuenta|compte", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social security|tax id|sozialvers|seguridad social", base=False, gate="-"),
    Kind("secret", r"(?i)(?<![A-Za-z0-9])(?:token|secret|password|passwd|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?[A-Za-z0-9+/_=-]{16,}+", 0.7, "key|auth|login", base=False),
    Kind("key", r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}+)|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0.9, "key|auth|login", base=False),
)
_FOUND = "array<struct<start:int,end:int,kind:int,score:double>>"


def _mod97(m: Column) -> Column:
    """Whether the letters and digits of m are an IBAN by ISO 13616's check."""
    bare = F.replace(m, F.lit(" "))
    turned = F.split(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4)), "")
    digit = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(c.between("0", "9"), 10).otherwise(100) + digit(c)) % 97).cast("int")
    return F.length(bare).between(15, 34) & (F.aggregate(turned, F.lit(0), step) == 1)


def _confirmed(kind: Kind, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    return {
        "ip": m.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$"),
        "card": F.call_function("luhn_check", digits),
        "phone": F.length(digits).between(10, 15),
        "iban": _mod97(m),
        "secret": m.rlike("[=:].*[0-9]") & m.rlike("[=:].*[A-Za-z]"),
        "ssn": ~m.rlike("^(?:000|666|9)|-00-|0000$"),
    }.get(kind.name, F.lit(True))


def _spans(k: int, kind: Kind, m: Column, g: Column) -> Column:
    """The confirmed spans of a kind, from its matches m and the pieces between them g; _FOUND."""
    left = lambda c: F.left(c, F.lit(CONTEXT_CHARS))
    right = lambda c: F.right(c, F.lit(CONTEXT_CHARS))
    piece = lambda i: F.zip_with(F.slice(g, i + 2, CONTEXT_MATCHES), F.slice(m, i + 2, CONTEXT_MATCHES), lambda p, q: F.concat(left(p), F.coalesce(left(q), F.lit(""))))
    after_each = F.transform(m, lambda _, i: left(F.array_join(piece(i), "")))
    around = F.arrays_zip(m.alias("m"), F.slice(g, F.lit(1), F.size(m)).alias("b"), after_each.alias("a"))

    def step(acc: Column, x: Column) -> Column:
        match, before, after = x["m"], x["b"], x["a"]
        start = acc["at"] + F.length(before)
        lead = right(F.concat(acc["tail"], before))
        near = F.lower(F.concat(lead, F.lit(" "), after))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), 0.2).otherwise(0.0)
        score = F.least(score, F.lit(1.0))
        ok = _confirmed(kind, match) & (F.lit(kind.base) | (score >= LEAST_SCORE))
        span = F.struct(start.cast("int").alias("start"), (start + F.length(match)).cast("int").alias("end"), F.lit(k).alias("kind"), score.alias("score"))
        tail = right(F.concat(lead, match))
        return F.struct((start + F.length(match)).cast("int").alias("at"), tail.alias("tail"), F.when(ok, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.expr(f"cast(array() as {_FOUND})").alias("out"))
    return F.when(F.size(m) > 0, F.aggregate(around, begin, step)["out"]).otherwise(F.expr(f"cast(array() as {_FOUND})"))


def found_pii(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with findings: array<struct<start int, end int, kind int, score double>>, by start and kind (an index of KINDS)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    docs = docs.drop("findings")
    names = unused(docs.columns, *[f"matches{k}" for k in range(len(KINDS))], *[f"pieces{k}" for k in range(len(KINDS))])
    m, g = names[: len(KINDS)], names[len(KINDS) :]
    columns = {}
    for k, kind in enumerate(KINDS):
        may = text.rlike(kind.pattern)
        if kind.gate:
            may = text.contains(kind.gate) & may
        columns[m[k]] = F.when(may, F.regexp_extract_all(text, F.lit(kind.pattern), 0)).otherwise(none)
        columns[g[k]] = F.when(may, F.split(text, kind.pattern, -1)).otherwise(none)
    turned = lambda a, b: lambda s: F.struct(s["start"].alias("start"), s[a].alias(a), s[b].alias(b), s["score"].alias("score"))
    every = F.concat(*[_spans(k, kind, F.col(m[k]), F.col(g[k])) for k, kind in enumerate(KINDS)])
    out = docs.withColumns(columns).withColumn("findings", F.transform(F.array_sort(F.transform(every, turned("kind", "end"))), turned("end", "kind")))
    return out.drop(*columns)


def span_text(findings: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    names = F.array(*[F.lit(kind.name) for kind in KINDS])
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """found_pii with redacted_text: each finding is replaced by its kind in angle brackets; of overlapping ones, the first."""
    names = F.array(*[F.lit(f"<{kind.name}>") for kind in KINDS])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(F.col("findings"), begin, step)
    found = found_pii(docs, text_col=text_col)
    (name,) = unused(found.columns, "done")
    found = found.withColumn(name, done)
    return found.withColumn("redacted_text", F.concat(F.col(name)["out"], F.substring(text, F.col(name)["at"] + 1, F.length(text)))).drop(name)
