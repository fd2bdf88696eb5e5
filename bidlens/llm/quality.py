"""Quality rules: statistics of whole texts and a decision list learned from labelled ones.

DataFrame functions only. Sequential covering grows one rule at a time, a conjunction of thresholds that finds bad
documents, by the best information gain over growing rows; prunes its last conditions while that raises its worth on
pruning rows; and leaves the rows it covers out of what follows. Every step is one aggregation over all labelled rows
still in play; the driver sees a count for each threshold. The list becomes one ordered CASE expression.

Words are `[^\\x20\\x09-\\x0D]+`. Null and empty texts have no word; every statistic of theirs is 0. Documents whose label is
null are not learned from. Without labels of both kinds the list is empty and keeps what the base rule keeps. Every row is a
document by itself; an id with several labels is learned from with each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import unused
from .scratch import stored

BLANKS = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
#: Thresholds tried for each feature.
CUTS = 24
MOST_RULES = 12
MOST_CONDITIONS = 4
#: Bad rows a rule must cover, as a share of all labelled rows and at least in number.
LEAST_SHARE, LEAST_ROWS = 0.002, 5
#: The share of bad rows that a rule must have among those it covers.
LEAST_PRECISION = 0.8

#: SQL expressions over the statistics.
FEATURES = {
    "n_words": "cast(n_words AS double)",
    "word_length": "try_divide(word_chars, n_words)",
    "symbol_share": "try_divide(n_symbols, n_words)",
    "dup_line_share": "try_divide(n_dup_lines, n_lines)",
    "repeat_share": "try_divide(n_repeat_words, n_words)",
    "capital_share": "try_divide(n_capitals, word_chars)",
    "exclaim_share": "try_divide(n_exclaims, n_words)",
    "digit_share": "try_divide(n_digits, word_chars)",
}


_STEPS = ("words", "lines", "marks", "hashes", "two", "four", "eight", "windows", "sorted", "at")


def with_stats(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_exclaims and n_digits (long)
    instead of any such columns; others pass through, whatever their names."""
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclaims", "n_digits")
    own = dict(zip(_STEPS, unused(docs.columns, *_STEPS)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.withColumns({
        own["words"]: F.array_remove(F.split(text, BLANKS), ""),
        own["lines"]: F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        own["marks"]: F.regexp_replace(text, "[^A-Z0-9!?#*$%&|<>]+", ""),
    })
    words, marks = F.col(own["words"]), F.col(own["marks"])
    count = lambda chars: (F.length(marks) - F.length(F.translate(marks, chars, ""))).cast("long")
    df = df.withColumn(own["hashes"], F.transform(words, lambda w: F.xxhash64(w)))
    pairs = lambda c, k: F.zip_with(c, F.slice(c, F.lit(k + 1), F.greatest(F.size(c) - k, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    # Hashes of 2, 4 and 8 words; the last entries of each meet nulls and are cut off.
    df = df.withColumn(own["two"], pairs(F.col(own["hashes"]), 1)).withColumn(own["four"], pairs(F.col(own["two"]), 2)).withColumn(own["eight"], pairs(F.col(own["four"]), 4))
    df = df.withColumn(own["windows"], F.slice(own["eight"], F.lit(1), F.greatest(F.size(own["eight"]) - (WINDOW - 1), F.lit(0))))
    # Windows by hash and place: those with a neighbour of the same hash are found twice or more.
    repeats = F.size(own["windows"]) > F.size(F.array_distinct(own["windows"]))
    df = df.withColumn(own["sorted"], F.when(repeats, F.sort_array(F.transform(own["windows"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = F.transform(own["sorted"], lambda x, i: F.when((x["h"] == F.get(F.col(own["sorted"]), i - 1)["h"]) | (x["h"] == F.get(F.col(own["sorted"]), i + 1)["h"]), x["i"]))
    df = df.withColumn(own["at"], F.sort_array(F.filter(at, lambda i: i.isNotNull())))
    reach = F.zip_with(own["at"], F.slice(own["at"], F.lit(2), F.size(own["at"])), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long"))
    df = df.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": count("#*$%&|<>"),
        "n_lines": F.size(own["lines"]).cast("long"),
        "n_dup_lines": (F.size(own["lines"]) - F.size(F.array_distinct(own["lines"]))).cast("long"),
        "n_capitals": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_exclaims": count("!?"),
        "n_digits": count("0123456789"),
    })
    return df.drop(*own.values())


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float
    step: int  # the cut's place among its feature's cuts

    def holds(self) -> Column:
        f = F.coalesce(F.col(self.feature), F.lit(0.0))
        return f > self.cut if self.above else f <= self.cut

    def in_bins(self) -> Column:
        """The same, of rows that have, for each feature, the number of its cuts below the value."""
        b = F.get(F.col("bins"), list(FEATURES).index(self.feature))
        return b > self.step if self.above else b <= self.step

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _all(rule: Rule, bins: bool = False) -> Column:
    return reduce(and_, [c.in_bins() if bins else c.holds() for c in rule], F.lit(True))


def learned(rows: DataFrame, label: str = "bad") -> list[Rule]:
    """The decision list of rows with FEATURES as columns, a boolean label (true: bad) and a boolean `pruning`.

    Rows are kept as bins, the number of cuts below each feature's value. A step counts bad and good rows by
    feature and bin, features x (CUTS + 1) numbers, whose running sums are the counts for every threshold.
    """
    names = list(FEATURES)
    value = lambda f: F.coalesce(F.col(f), F.lit(0.0))
    found = rows.agg(*[F.percentile_approx(value(f), [i / CUTS for i in range(1, CUTS)], 10_000).alias(f) for f in names]).first()
    cuts = [sorted({float(c) for c in found[f] or []}) for f in names]
    below = [_below(value(f), own) for f, own in zip(names, cuts)]
    binned = stored(rows.select(F.col(label).alias("bad"), "pruning", F.array(*below).alias("bins")), "quality_bins")
    total = binned.count()
    least = max(LEAST_ROWS, LEAST_SHARE * total)
    rules: list[Rule] = []
    sums = (F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))

    def count(df: DataFrame) -> tuple[int, int]:
        return tuple(df.agg(*sums).first())

    def thresholds(df: DataFrame) -> list[tuple[Condition, tuple[int, int]]]:
        got = {(r.f, r.b): (r.p, r.n) for r in df.select("bad", F.posexplode("bins").alias("f", "b")).groupBy("f", "b").agg(*sums).collect()}
        out = []
        for i, own in enumerate(cuts):
            every = [got.get((i, b), (0, 0)) for b in range(len(own) + 1)]
            p, n = (sum(x[k] for x in every) for k in (0, 1))
            a = b = 0
            for step, cut in enumerate(own):
                a, b = a + every[step][0], b + every[step][1]
                out += [(Condition(names[i], False, cut, step), (a, b)), (Condition(names[i], True, cut, step), (p - a, n - b))]
        return out

    while len(rules) < MOST_RULES:
        left = binned.where(~reduce(lambda a, r: a | _all(r, True), rules, F.lit(False)))
        growing, pruning = left.where(~F.col("pruning")), left.where("pruning")
        p, n = count(growing)
        rule: Rule = ()
        while p and n and len(rule) < MOST_CONDITIONS:
            gain = lambda pn: pn[0] * (math.log2(pn[0] / sum(pn)) - math.log2(p / (p + n))) if pn[0] else -1.0  # noqa: E731, B023
            best = max(thresholds(growing.where(_all(rule, True))), key=lambda x: gain(x[1]), default=None)
            if best is None or gain(best[1]) <= 0:
                break
            rule, (p, n) = (*rule, best[0]), best[1]
        if not rule:
            break
        worth = [((a - b) / (a + b) if a + b else -1.0) for a, b in (count(pruning.where(_all(rule[: k + 1], True))) for k in range(len(rule)))]
        rule = rule[: max(range(len(rule)), key=lambda k: (worth[k], -k)) + 1]
        p, n = count(left.where(_all(rule, True)))
        if p < least or p < LEAST_PRECISION * (p + n):
            break
        rules.append(rule)
    return rules


def _below(x: Column, cuts: list[float]) -> Column:
    """How many of the cuts are below x."""
    return reduce(lambda a, b: a + b, [F.when(x > c, 1).otherwise(0) for c in cuts], F.lit(0))


def verdict(rules: list[Rule]) -> Column:
    """The name of the first rule that holds, or null."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(_all(rule), F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def judged_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> DataFrame:
    """id_col, the statistics, base_failed, rule (of the list; null: none holds) and kept. A label of 0 is bad."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    stats = stored(with_stats(slim).drop("text"), "quality_stats")
    featured = stats.withColumns({f: F.expr(x) for f, x in FEATURES.items()} | {"n_words_": F.col("n_words")})
    marks = labels.select(F.col(id_col).alias("l_id"), (F.col(quality_col) == 0).alias("bad")).where("bad IS NOT NULL")
    rows = featured.join(marks, featured["id"] == marks["l_id"]).select("bad", (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("pruning"), *FEATURES)
    rules = learned(stored(rows, "quality_rows"))
    out = featured.withColumn("rule", verdict(rules)).withColumn("n_words", F.col("n_words_")).withColumn("base_failed", base_failed())
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return out.select(F.col("id").alias(id_col), *[c for c in stats.columns if c != "id"], "base_failed", "rule", "kept")
