import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bidlens.llm.components import components
from bidlens.llm.jaccard_join import document_classes
from bidlens.llm.queries import QUERIES
from corpus_pipeline import near_duplicates

from . import brute


def brute_classes(rows, k=4, num=85, den=100):
    sets = {}
    for d, t in rows:
        w = [x.translate(brute.LOWER) for x in brute.WORD.findall(t or "")]
        n = min(k, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    for a, b in {(a, b) for v in by.values() for a in v for b in v if a < b}:
        both = len(sets[a] & sets[b])
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return sorted((d, len(s), top(d)) for d, s in sets.items())


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in QUERIES["op7_jaccard_join"](spark, sf).collect()) == brute_classes(rows)


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80), (2, 60)])
def test_chains_of_copies(spark, k, num):
    """Copies of copies, whose ends share too little, and texts at the threshold."""
    r = random.Random(num)
    rows, words = [], [f"w{i}" for i in range(300)]
    for c in range(6):
        text = [r.choice(words) for _ in range(r.choice([8, 40, 120]))]
        for _ in range(25):
            rows.append(" ".join(text))
            if r.random() < 0.8:
                text = list(text)
                for _ in range(r.randint(1, max(1, len(text) // 50))):
                    text[r.randrange(len(text))] = r.choice(words)
    rows += ["a b c d e f g h i j k l"] * 3 + ["a b c", "A B c", "a b", None, "", "x " * 3000]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("id", F.lit(0)).repartition(3)
    got = sorted(tuple(x) for x in document_classes(df, k=k, numerator=num).collect())
    assert got == brute_classes(rows, k, num)


def test_edges(spark):
    text = "one two three four five six"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text.upper()), (3, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in document_classes(df).collect()), key=repr)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (None, 3, 1), (2, 3, 1), (3, 0, 3)], key=repr)
    assert document_classes(df.limit(0)).count() == 0


def test_copy_without_id_beside_near_copies(spark):
    words = [f"w{i}" for i in range(60)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    df = spark.createDataFrame([(None, text), (7, text), (9, near)], "doc_id long, text string")
    assert sorted((tuple(r) for r in document_classes(df).collect()), key=repr) == [(7, 57, 7), (9, 57, 7), (None, 57, 7)]
    assert [r.doc_id for r in near_duplicates(spark, df, "").collect()] == [7]


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randint(100, 200), r.randint(100, 200)) for _ in range(60)] + [(500, 400), (None, 3)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {x: top(x) for x in up}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_texts_that_share_an_id(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "un deux trois quatre cinq"
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (7, c), (9, None), (4, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in document_classes(df).collect())
    assert got == [(3, 3), (4, 4), (5, 3), (5, 3), (7, 7), (9, 3), (9, 3)]


def test_groups_beyond_one_bucket(spark, monkeypatch):
    """Hot keys dealt into many small buckets: links between groups come from opening them."""
    monkeypatch.setattr("bidlens.llm.jaccard_join.GROUP", 3)
    monkeypatch.setattr("bidlens.llm.jaccard_join.OFFERS", 2)
    r = random.Random(11)
    words, rows = [f"w{i}" for i in range(500)], []
    for c in range(4):
        base = [r.choice(words) for _ in range(90)]
        for _ in range(40):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append(" ".join(t))
    rows = list(enumerate(rows))
    got = sorted(tuple(x) for x in document_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_classes(rows)


def test_blocks_of_common_tokens_like_brute_force(spark, monkeypatch):
    """Near copies in many groups, whose common tokens are dealt into several blocks: no pair of blocks may be missed."""
    from bidlens.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "LIGHT", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK_GROUPS", 4)
    r = random.Random(7)
    base = [f"w{i}" for i in range(70)]
    texts = []
    for n in range(150):
        words = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 6])):
            words[r.randrange(len(words))] = f"x{r.randrange(40)}"
        texts.append((n, " ".join(words[: r.randrange(55, 71)])))
    rows = texts + [(200 + i, f"other words number {i} stand here alone") for i in range(20)]
    got = document_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted(brute_classes(rows))
