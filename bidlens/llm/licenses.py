"""License scans by ordered signature rules, in DataFrame functions only.

A text becomes its lower-case words joined by single spaces, so that a rule is one regular expression over words. Which rules are
tried follows from the words that the text shares with the rules' keywords; most texts share none and are done. Where a rule
matches, marks are put around its matches and the words that carry marks are their places. Matches are leftmost and do not overlap
within a rule. A match is suppressed if one of a better or the same class holds it: longer, or of the same words by a better class or
an earlier rule. Matches of the base phrases stay in any case.

Null texts are empty: no words, no labels, score 0. Every row is a document by itself, repeated ones and those without id too. An
empty table gives no rows. Other columns pass through, whatever their names, but for those that are added, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import RULES, SCORES
from .names import unused

ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
#: Characters that no word has, put around matches.
_OPEN, _CLOSE = "\x01", "\x02"
_FOUND = "array<struct<start:int,end:int,rank:int,rule:int>>"


def spaced_words(text: Column) -> Column:
    """The text's words in lower case, with a space before, between and after them; a single space without words."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _rules() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r.rank).alias("rank"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern")) for i, r in enumerate(RULES)])


def _places(words: Column, rule: Column) -> Column:
    """A rule's matches, by the words that carry the marks around them."""
    marked = F.regexp_replace(words, rule["pattern"], F.lit(f"{_OPEN}$0{_CLOSE}"))
    numbered = F.transform(F.split(marked, " "), lambda w, i: F.struct(w.alias("w"), i.alias("i")))  # what precedes the first space is no word
    starts = F.filter(numbered, lambda x: F.startswith(x["w"], F.lit(_OPEN)))
    ends = F.filter(numbered, lambda x: F.endswith(x["w"], F.lit(_CLOSE)))
    place = lambda a, b: F.struct((a["i"] - 1).cast("int").alias("start"), b["i"].cast("int").alias("end"), rule["rank"].alias("rank"), rule["rule"].alias("rule"))
    return F.zip_with(starts, ends, place)


def _unsuppressed(found: Column) -> Column:
    """Matches that no match of their class or a better one holds. In order of start, the longest and best first, whatever holds a
    match comes before it, so the furthest end of each class so far decides."""
    order = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["rank"].alias("rank"), x["rule"].alias("rule"))))
    n = len(SCORES)
    begin = F.struct(F.array_repeat(F.lit(-1), n).alias("furthest"), F.expr(f"cast(array() as {_FOUND})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = -x["back"]
        held = F.get(acc["furthest"], x["rank"]) >= end
        furthest = F.transform(acc["furthest"], lambda e, i: F.when(i >= x["rank"], F.greatest(e, end)).otherwise(e))
        own = F.struct(x["start"].alias("start"), end.cast("int").alias("end"), x["rank"].alias("rank"), x["rule"].alias("rule"))
        return F.struct(furthest.alias("furthest"), F.when(held, acc["out"]).otherwise(F.concat(acc["out"], F.array(own))).alias("out"))

    return F.aggregate(order, begin, step)["out"]


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scanned(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with n_words; the base's number of places n_base, its first_word and last_word (null without places) and base_labels; labels,
    all distinct ones; score, that of the best match; and detections: array<struct<start int, end int, label string, score
    double>>, words from 0 with the end exclusive, by start."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.withColumn((held := unused(docs.columns, "held_text")[0]), text).drop(*[c for c in docs.columns if c.lower() in ADDED and c != text_col])
    words, found, kept = unused([*docs.columns, *ADDED], "words", "found", "kept")
    none = F.expr(f"cast(array() as {_FOUND})")
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in RULES})])
    names = F.array(*[F.lit(r.label) for r in RULES])
    scores = F.array(*[F.lit(s) for s in SCORES])
    base = [i for i, r in enumerate(RULES) if r.base]
    label = lambda x: F.get(names, x["rule"])

    shared = F.array_intersect(F.split(F.col(words), " "), keywords)
    tried = lambda hits: F.filter(_rules(), lambda r: F.array_contains(hits, r["keyword"]) & F.regexp_like(F.col(words), r["pattern"]))
    hits, matching = unused([*docs.columns, *ADDED, words, found, kept], "hits", "matching")
    docs = docs.withColumn(words, spaced_words(F.col(held))).withColumn(hits, shared)
    docs = docs.withColumn(matching, F.when(F.size(hits) > 0, tried(F.col(hits))))
    docs = docs.withColumn(found, F.when(F.size(matching) > 0, F.flatten(F.transform(F.col(matching), lambda r: _places(F.col(words), r)))).otherwise(none))
    docs = docs.withColumn(kept, F.when(F.size(found) > 1, _unsuppressed(F.col(found))).otherwise(F.col(found)))
    of_base = F.filter(F.col(found), lambda x: x["rule"].isin(base))
    every = F.concat(F.col(kept), F.filter(of_base, lambda x: ~F.array_contains(F.col(kept), x)))
    starts = F.transform(of_base, lambda x: x["start"])
    told = F.transform(F.array_sort(every), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), label(x).alias("label"), F.get(scores, x["rank"]).alias("score")))
    out = docs.withColumns(
        {
            "n_words": (F.length(words) - F.length(F.replace(F.col(words), F.lit(" "))) - 1).cast("long"),
            "n_base": F.size(of_base).cast("long"),
            "first_word": F.array_min(starts).cast("long"),
            "last_word": F.array_max(starts).cast("long"),
            "base_labels": _joined(F.transform(of_base, label)),
            "labels": _joined(F.transform(every, label)),
            "score": F.coalesce(F.array_max(F.transform(every, lambda x: F.get(scores, x["rank"]))), F.lit(0.0)),
            "detections": told,
        }
    )
    return out.drop(held, words, hits, matching, found, kept)
