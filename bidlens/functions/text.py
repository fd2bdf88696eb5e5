"""Column functions over texts."""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

#: Unicode white space, as Java's classes have it; str.strip() takes off the same but for \x1c to \x1f.
_BLANKS = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def stripped(c: Column) -> Column:
    """Without white space at both ends, which are looked at alone."""
    return F.btrim(c, F.lit(_BLANKS))


def non_empty(c: Column) -> Column:
    """c, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def cleaned(c: Column) -> Column:
    """Stripped, and null where nothing is left."""
    return non_empty(stripped(c))


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, ends off."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def snippet(c: Column, limit: int = 320) -> Column:
    one = collapsed(c)
    return F.concat(F.substring(one, 1, limit), F.when(F.length(one) > limit, "…").otherwise(""))


def normalized_lines(c: Column) -> Column:
    """LF line ends, no trailing white space in a line, at most one blank line in a row, ends off."""
    lf = F.regexp_replace(c, "\r\n?", "\n")
    return stripped(F.regexp_replace(F.regexp_replace(lf, r"(?U)[^\S\n]+(?=\n|$)", ""), "\n{3,}", "\n\n"))


def embed_tokens(c: Column) -> Column:
    """Lower-case alphanumeric runs of two characters and more that are no stop words."""
    stop = F.array(*[F.lit(w) for w in V.EMBED_STOPWORDS])
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), 0), F.lower), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def word_tokens(c: Column) -> Column:
    """Lower-case words of three letters and hyphens and more."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z\-]{2,}"), 0), F.lower)


def query_tokens(c: Column, stopwords: list[str] | None = None) -> Column:
    """word_tokens that may make queries, in their order."""
    stop = F.array(*[F.lit(w) for w in (stopwords if stopwords is not None else V.QUERY_STOPWORDS + V.PLACE_STOPWORDS)])
    return F.filter(word_tokens(c), lambda t: ~F.array_contains(stop, t))


def counted(tokens: Column) -> Column:
    """array<struct<token, n>> of an array's distinct values: it is sorted once, and a run begins where its neighbour differs."""
    ordered = F.transform(F.array(F.sort_array(tokens)), lambda s: F.filter(F.transform(s, lambda x, i: F.struct(x.alias("token"), F.when((i == 0) | (x != F.get(s, F.greatest(i - 1, F.lit(0)))), i).alias("at"))), lambda r: r["at"].isNotNull()))
    runs = F.transform(ordered, lambda r: F.zip_with(r, F.slice(r, F.lit(2), F.size(r)), lambda a, b: F.struct(a["token"].alias("token"), (F.coalesce(b["at"], F.size(tokens)) - a["at"]).cast("long").alias("n"))))
    return F.get(runs, F.lit(0))


def sentences(c: Column) -> Column:
    """Split after . ! or ? where white space and a capital or digit follow."""
    return F.filter(F.transform(F.split(c, V.SENTENCE_GAP), stripped), lambda s: s != "")


def _contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | c.contains(w), words, F.lit(False))


def doc_type(name: Column, category: Column, text: Column) -> Column:
    """The kind of a document by the first rule whose words occur in name, category or the first 1500 characters."""
    hay = F.lower(F.concat_ws(" ", name, category))
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 1500))
    mapping = F.create_map(*[F.lit(x) for kv in V.DOC_TYPE_BY_CATEGORY.items() for x in kv])

    def ruled(x: Column) -> Column:
        rules = [(_contains_any(x["hay"], w) | _contains_any(x["head"], w), kind) for kind, w in V.DOC_TYPE_RULES]
        return reduce(lambda other, r: F.when(r[0], r[1]).otherwise(other), reversed(rules), F.lit(None).cast("string"))

    # Both are bound as a lambda's variable, so that they are worked out once and not for each word.
    found = F.get(F.transform(F.array(F.struct(hay.alias("hay"), head.alias("head"))), ruled), F.lit(0))
    return F.coalesce(found, F.try_element_at(mapping, category), F.lit("Other"))


def requirement_category(c: Column) -> Column:
    low = F.lower(c)
    return reduce(lambda other, r: F.when(_contains_any(low, r[1]), r[0]).otherwise(other), reversed(V.REQUIREMENT_RULES), F.lit("Other"))


def requirement_rank(category: Column) -> Column:
    return reduce(lambda other, r: F.when(category == r[1], r[0]).otherwise(other), enumerate(V.REQUIREMENT_ORDER), F.lit(9))


def requirement_sentences(c: Column, words: str = V.REQUIREMENT_WORDS) -> Column:
    """White-space-collapsed runs that end in a full stop, cross neither stop nor line, and hold one of `words`.

    Runs are cut first, each from where it begins, and then searched: both in linear time, whatever the text.
    """
    runs = F.regexp_extract_all(c, F.lit(r"(?:^|(?<=[.\n]))[^.\n]*+\."), 0)
    return F.transform(F.filter(runs, lambda x: x.rlike(rf"(?iU)\b(?:{words})\b")), collapsed)


def resolved(c: Column) -> Column:
    """c with HTML character references resolved once: decimal and hexadecimal ones, all named ones of HTML 5, and of these
    the old ones without a semicolon too. What stands for no character is U+FFFD, as browsers have it."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")  # folded into one constant
    old = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
    windows = F.create_map(*[F.lit(x) for i in range(0x80, 0xA0) if (ch := bytes([i]).decode("cp1252", "ignore")) for x in (i, ch)])

    def one(part: Column) -> Column:
        """A piece of text that an ampersand preceded."""
        ref = F.regexp_extract(part, rf"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|{old})", 0)
        digits = F.regexp_replace(ref, "^#[xX]?|;$", "")
        number = F.when(F.length(digits) > 12, F.lit(-1)).when(ref.rlike("^#[xX]"), F.conv(digits, 16, 10).cast("long")).otherwise(digits.try_cast("long"))
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.when(valid, F.coalesce(F.try_element_at(windows, number.cast("int")), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))).otherwise("\ufffd")
        found = F.when(ref.startswith("#"), char).when(ref != "", F.try_element_at(names, ref))
        return F.when(found.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(found, F.substr(part, F.length(ref) + 1)))

    parts = F.split(c, "&")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(one(p))), "")


def html_text(c: Column) -> Column:
    """Readable text of HTML: block ends become line breaks, items bullets, other tags go, entities are resolved once,
    lines are stripped and blank ones collapsed. Contents of script and style stay."""
    steps = [(r"(?i)</p\s*>", "\n\n"), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</li\s*>", "\n"), (r"(?i)<li[^>]*>", "• "), (r"<[^>]+>", "")]
    out = resolved(reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c))
    out = F.regexp_replace(F.replace(out, F.lit("\u00a0"), F.lit(" ")), "\r\n?|[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")
    lines = F.array_join(F.transform(F.split(out, "\n"), stripped), "\n")
    return stripped(F.regexp_replace(lines, "\n{3,}", "\n\n"))


def plain_prose(c: Column, export: bool = False) -> Column:
    """Prose without a trailing block of sources or references and without Markdown marks; for export without citations too.

    Marks go in one pass over the text, and those that stood inside other ones in a second."""
    body = reduce(lambda x, block: F.regexp_replace(x, block, ""), V.TRAILING_BLOCKS, stripped(F.coalesce(c, F.lit(""))))
    marks = r"#{1,6}\s*|\*\*(.+?)\*\*|(?<!\*)\*([^*]+?)\*(?!\*)|_(.+?)_" + (f"|{V.CITATION}" if export else "")
    for _ in range(2):
        body = F.regexp_replace(body, marks, "$1$2$3")
    return normalized_lines(body)


def template_score(kind: Column, category: Column, name: Column, n_chunks: Column) -> Column:
    """How well a document stands for a whole proposal: technical and past-performance volumes over line cards and price forms."""
    low = F.lower(name)
    holds = lambda *words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    rules = [(kind == k, worth) for k, worth in V.TEMPLATE_KINDS.items()] + [
        ((kind == "Past Performance") & (n_chunks >= V.TEMPLATE_PAST_CHUNKS), V.TEMPLATE_PAST_PERFORMANCE),
        (category.isin(*V.TEMPLATE_CATEGORIES), V.TEMPLATE_CATEGORY),
        (holds(*V.TEMPLATE_NAMES), V.TEMPLATE_NAME),
        (kind.isin(*V.TEMPLATE_SHORT_KINDS) & (n_chunks <= V.TEMPLATE_SHORT_CHUNKS), V.TEMPLATE_SHORT),
        (holds(*V.TEMPLATE_CARDS), V.TEMPLATE_CARD),
    ]
    return reduce(lambda a, r: a + F.when(r[0], r[1]).otherwise(0.0), rules, F.least(n_chunks, F.lit(V.TEMPLATE_MOST_CHUNKS)) * V.TEMPLATE_CHUNK)


def is_heading(line: Column) -> Column:
    """Whether a line of fitting length starts with # or a number, or is mostly capitals or capitalised words, and ends no sentence."""
    s = stripped(line)
    words, capitalised = F.regexp_count(s, F.lit(r"(?U)\S+")), F.regexp_count(s, F.lit(r"(?U)(?<!\S)\p{Lu}"))
    letters, capitals = F.regexp_count(s, F.lit(r"\p{L}")), F.regexp_count(s, F.lit(r"\p{Lu}"))
    loud = (letters > 0) & (capitals >= V.CAPITAL_LETTERS * letters)
    titled = (words > 1) & (capitalised >= V.CAPITAL_WORDS * words)
    by_form = s.rlike("^" + V.HEADING_NUMBER) | ((words <= V.HEADING_WORDS) & (loud | titled))
    one_line = F.length(s).between(*V.HEADING_LENGTHS) & ~s.contains("\n")
    return one_line & (s.startswith("#") | (by_form & ~s.rlike("[.!?,;]$")))


def heading_label(line: Column) -> Column:
    """A heading without its marks, number and final colon, cut to a heading's length; empty where nothing else is there."""
    bare = F.regexp_replace(stripped(line), rf"^(?:#{{1,6}}\s*|{V.HEADING_NUMBER})", "")
    return F.substring(stripped(F.regexp_replace(stripped(bare), ":+$", "")), 1, V.HEADING_LENGTHS[1])


def char_windows(c: Column, size: int, overlap: int) -> Column:
    """Windows of `size` characters, each beginning size - overlap after the last."""
    step = max(1, size - overlap)
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c), F.lit(step)), lambda i: F.substring(c, i, F.lit(size)))).otherwise(F.expr("cast(array() as array<string>)"))


def summary(c: Column, most: int = 280) -> Column:
    """Whole sentences, up to `most` characters, of the first paragraph with 40 characters or more; else the text's start.

    Of all runs of first sentences the longest that fits; a first sentence that is longer is cut. Sentences of collapsed text stand one
    space apart, so a run is the text up to a sentence's end, and no more is looked at than shows the last end that fits."""
    text = F.coalesce(c, F.lit(""))
    paras = F.filter(F.transform(F.split(text, "\n\n"), collapsed), lambda p: F.length(p) >= 40)
    gap = V.SENTENCE_GAP.replace(r"\s+(?=", r"(?=\s+")

    def first_of(para: Column) -> Column:
        run = F.regexp_extract(F.substring(para, 1, most + 3), rf"(?s)^.{{1,{most}}}{gap}", 0)  # a gap, a bracket and a capital beside
        return F.when(F.length(para) <= most, para).otherwise(F.coalesce(non_empty(run), F.substring(para, 1, most)))

    # The paragraph is bound as a lambda's variable, so that it is worked out once.
    return stripped(F.coalesce(F.get(F.transform(F.slice(paras, 1, 1), first_of), 0), F.substring(collapsed(text), 1, most)))


def titled_lines(c: Column, word: str) -> Column:
    """Distinct (number, title) of lines `<word> N title`, in order."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?im)^{word}\s+\d+\s+.+?\s*$"), 0)
    part = lambda i: (lambda x: stripped(F.regexp_extract(x, rf"(?is)^{word}\s+(\d+)\s+(.+?)\s*$", i)))
    return F.array_distinct(F.transform(found, lambda x: F.struct(part(1)(x).alias("number"), part(2)(x).alias("title"))))


def company_line(c: Column) -> Column:
    """The first of a text's first 12 lines that names a company by its legal form; else The Offeror."""
    head = F.array_join(F.slice(F.split(F.coalesce(c, F.lit("")), "\n"), 1, 12), "\n")
    line = rf"(?im)^[^\S\n]*(?!(?:{V.NO_COMPANY}))(?=\S[^\n]{{2,}}\S)[^\n]*\b(?:{V.LEGAL_FORMS})\b[^\n]*$"
    return F.coalesce(cleaned(F.regexp_substr(head, F.lit(line))), F.lit("The Offeror"))
