from pyspark.sql import functions as F

from bidlens.llm.decontaminate import clean_documents, contaminations
from bidlens.llm.langid import fitted, with_language
from bidlens.llm.queries import ORACLE_SQL, QUERIES

from . import brute
from .oracle import compare

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = QUERIES["op6_language_id"](spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out and docs[r.doc_id].lang]
    assert len(held) > 100 and sum(held) / len(held) > 0.97


def test_language_edges(spark):
    df = spark.createDataFrame([(1, "the cat sat", "en"), (2, "der hund lief über", "de"), (3, None, "en"), (4, "123 !?", "de"), (5, "the cat", None), (None, "", "xx"), (6, "Über " * 30_000, "de"), (1, "the cat sat", "en")], "doc_id long, text string, lang string").withColumn("score", F.lit("s"))
    model = fitted(df)
    got = sorted((r.doc_id or 0, r.lang_pred, r.score == 0) for r in with_language(df, model).collect())
    assert got == [(0, "und", True), (1, "en", False), (1, "en", False), (2, "de", False), (3, "und", True), (4, "und", True), (5, "en", False), (6, "de", False)]
    nothing = fitted(df.limit(0))
    assert {r.lang_pred for r in with_language(df, nothing).collect()} == {"und"} and with_language(df.limit(0), model).count() == 0


def test_like_naive_bayes_by_hand(spark):
    """Posteriors from dictionaries of n-grams; no two of these few n-grams share a bucket."""
    import math
    from collections import Counter

    texts = [("en", "the cat sat on the mat"), ("en", "A dog, and the cats!"), ("de", "der Hund lief über die Straße"), ("de", "die Katze"), ("fr", "le chat  -- est là")]

    def grams(t):
        c = " " + " ".join("".join(x if x.isalpha() else " " for x in t.lower()).split()) + " "
        return Counter(c[i : i + n] for n in (1, 2, 3) for i in range(len(c) - n + 1))

    total = {lang: sum((grams(t) for own, t in texts if own == lang), Counter()) for lang, _ in texts}

    def posterior(t):
        logs = {}
        for lang, counts in total.items():
            of = sum(counts.values()) + 0.5 * 65536
            logs[lang] = math.log(sum(x == lang for x, _ in texts) / len(texts)) + sum(n * math.log((counts[g] + 0.5) / of) for g, n in grams(t).items())
        best = max(sorted(logs), key=logs.get)
        return best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())

    df = spark.createDataFrame([(lang, t) for lang, t in texts], "lang string, text string")
    asked = ["the", "Katze über", "chat", "cat", "12 cats", "STRASSE straße"]
    got = with_language(spark.createDataFrame(list(enumerate(asked)), "i int, text string"), fitted(df)).orderBy("i").collect()
    assert [(r.lang_pred, round(r.score, 9)) for r in got] == [(b, round(p, 9)) for b, p in map(posterior, asked)]


def test_decontamination_oracle(spark):
    assert compare(spark, "op9_decontamination", QUERIES["op9_decontamination"], ORACLE_SQL["op9_decontamination"], SF) > 10


def brute_contaminations(docs, items, k=5):
    words = lambda t: [x.translate(brute.LOWER) for x in brute.WORD.findall(t or "")]
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = []
    for i, b in items:
        if not (w := words(b)):
            continue
        n = min(k, len(w))
        want = grams(w, n)
        out += [(d, i, len(grams(words(a), n) & want), len(want)) for d, a in docs if 10 * len(grams(words(a), n) & want) >= 8 * len(want)]
    return sorted(out)


def test_decontamination_edges(spark):
    item = " ".join(f"w{i}" for i in range(24))
    part = lambda n: " ".join(f"w{i}" for i in range(n))
    docs = [(1, "pre " + item + " post"), (2, part(20)), (3, part(19)), (4, None), (5, ""), (6, "z " * 40_000 + item.upper()), (7, "two words"), (8, "x two words y"), (9, item), (9, item)]
    items = [(1, item), (2, "two words"), (3, None), (4, ""), (5, item), (6, "one two three four five six"), (7, "Y"), (8, "w3 w4 w5 w6"), (9, "words two")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    want = brute_contaminations(docs, items)
    assert (8, 2, 1, 1) in want and (7, 2, 1, 1) in want and (8, 7, 1, 1) in want and (9, 8, 1, 1) in want  # short items inside longer documents
    for how in ({}, {"block_bytes": 200}):
        got = sorted((r.doc_id, r.item_id, round(r.containment * r.n_item_shingles), r.n_item_shingles) for r in contaminations(d, b, **how).collect())
        assert got == want
        assert {r.doc_id for r in clean_documents(d, b, **how).collect()} == {x for x, _ in docs} - {x[0] for x in want}
    assert contaminations(d.limit(0), b).count() == 0 and contaminations(d, b.limit(0)).count() == 0
