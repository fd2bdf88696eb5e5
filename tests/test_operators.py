"""Operators on small frames."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from bidlens.operators import checklist, chunking, embedding, mining, pricing, requirements, search, store
from bidlens.streaming import ledger


def test_prices(spark):
    df = spark.createDataFrame([("a", 100.0), ("a", 300.0), ("a", None), ("b", None)], "g string, amount double")
    got = {r.g: r for r in pricing.price_summary(df, ["g"]).collect()}
    assert (got["a"].total, got["a"].priced, got["a"].median_amount, got["b"].priced, got["b"].mean_amount) == (3, 2, 200.0, 0, None)
    bins = lambda xs: [r.n for r in pricing.price_histogram(spark.createDataFrame([(x,) for x in xs], "amount double")).orderBy("bin").collect()]
    assert bins([100.0, 200.0, 300.0, 900.0]) == [2, 1, 0, 0, 0, 0, 0, 1] and bins([5.0, 5.0]) == [2] and bins([]) == [] and bins([None]) == []
    assert [r.amount for r in pricing.ranked_awards(df, "g").collect()] == [300.0, 100.0, None, None]


def test_filters():
    with pytest.raises(ValueError):
        search.Filters(posted_from=date(2026, 1, 1), posted_to=date(2025, 1, 1))
    with pytest.raises(ValueError):
        search.Filters(posted_from=date(2025, 1, 1), posted_to=date(2026, 1, 2))
    search.Filters(posted_from=date(2025, 1, 1), posted_to=date(2026, 1, 1))
    assert search.Filters(naics=(" a ", "", None)).naics == ("a",)
    for bad in ({"limit": 0}, {"limit": 1001}, {"offset": -1}):
        with pytest.raises(ValueError):
            search.Filters(**bad)


def test_window_and_overlay(spark):
    df = spark.createDataFrame([(1, None), (2, date(2026, 1, 1)), (3, date(2026, 1, 31)), (4, date(2026, 2, 1))], "i int, day date")
    assert [r.i for r in df.where(search.within(F.col("day"), F.lit(date(2026, 1, 1)), F.lit(date(2026, 1, 31)))).orderBy("i").collect()] == [1, 2, 3]


def test_mining(spark):
    texts = ["power line construction and power line repair", "construction of power line towers", "substation power line work"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = mining.query_candidates(df, "doc_id", "text")
    chosen = mining.chosen_queries(found, 2)
    assert chosen[0].term == "power line" and "construction" in chosen[1].term
    assert mining.chosen_queries(mining.query_candidates(df.limit(0), "doc_id", "text")) == []
    assert [r.term for r in mining.broad_terms(df, "doc_id", "text").collect()] == ["power", "line", "construction"]
    one = spark.createDataFrame([(1, "alpha beta alpha beta")], "doc_id int, text string")
    assert mining.chosen_queries(mining.query_candidates(one, "doc_id", "text"), 6)[0].term in ("alpha beta", "beta alpha")


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "power power line"), (2, "the a"), (3, "line power power"), (4, "pump")], "id int, text string")
    backend = embedding.Hashed(64)
    vectors = backend.embed(df, "id", "text")
    norms = {r.id: sum(x.w * x.w for x in r.v) for r in vectors.collect()}
    assert set(norms) == {1, 2, 3, 4} and norms[2] == 0 and all(abs(norms[i] - 1) < 1e-9 for i in (1, 3, 4))
    q = spark.createDataFrame([(9, "power line"), (8, "zzz unknown")], "id int, text string")
    top = embedding.nearest(backend.embed(q, "id", "text"), vectors, 3, dimension=64).orderBy("q", "rank").collect()
    assert [r.id for r in top if r.q == 9][:2] == [1, 3] and len([r for r in top if r.q == 8]) == 3


def test_requirement_matrix_caps_before_it_sorts(spark):
    rows = [(i, f"The contractor shall perform task number {i} in full.") for i in range(16)] + [(99, "Award is by Section M factors and offerors shall comply with it.")]
    found = requirements.requirements(spark.createDataFrame(rows, "id int, text string"), "id", "text")
    m = requirements.matrix(found).collect()
    assert len(m) == 15 and all(r.category == "SOW (shall)" for r in m)
    twice = spark.createDataFrame([(1, "It SHALL be done as was said. It shall be done as was said.")], "id int, text string")
    assert requirements.requirements(twice, "id", "text").count() == 1
    counts = {r.status: r.n for r in requirements.status_counts(spark.createDataFrame([("Partial",)], "status string")).collect()}
    assert counts == {"Addressed": 0, "Partial": 1, "Not Addressed": 0}


def cut(spark, text, size, overlap):
    rows = chunking.chunks(spark.createDataFrame([(1, text)], "doc_id int, text string"), "doc_id", "text", size=size, overlap=overlap).orderBy("ordinal").collect()
    return [(r.text, r.section) for r in rows]


def test_chunks(spark):
    text = "\n\n".join(" ".join(f"w{p}x{i}" for i in range(40)) for p in range(20))
    got = cut(spark, text, 500, 80)
    assert all(len(t) <= 580 for t, _ in got) and len(got) > 5
    assert len(cut(spark, "x" * 5000, 1000, 100)) >= 5 and cut(spark, "", 100, 10) == [] and cut(spark, "# A\n\n# B", 100, 10) == []
    with pytest.raises(ValueError):
        chunking.chunks(spark.createDataFrame([(1, "a")], "doc_id int, text string"), "doc_id", "text", size=10, overlap=10)
    got = cut(spark, "# One\n\n" + "alpha beta gamma. " * 8 + "\n\n# Two\n\nshort text.", 200, 20)
    assert [s for _, s in got] == ["One", "Two"] and "One" not in got[0][0]
    df = spark.createDataFrame([(1, text), (2, None), (3, "# Only")], "doc_id int, text string")
    rows = chunking.chunks(df, "doc_id", "text", size=500, overlap=80).collect()
    assert {r.doc_id for r in rows} == {"1"} and sorted(r.ordinal for r in rows) == list(range(len(rows))) and len({r.chunk_id for r in rows}) == len(rows)


def test_chunks_word_for_word(spark):
    """Overlaps are whole sentences, long paragraphs are packed by sentences, long sentences cut into windows."""
    assert cut(spark, "Aaa bbb. Ccc ddd.\n\nEee fff. Ggg hhh.\n\nIii.", 30, 10) == [("Aaa bbb. Ccc ddd.", None), ("Ccc ddd.\n\nEee fff. Ggg hhh.", None), ("Ggg hhh.\n\nIii.", None)]
    assert cut(spark, "abcdefghij" * 3, 12, 2) == [("abcdefghijab", None), ("abcdefghijab", None), ("abcdefghij", None)]
    assert chunking.ending("One. Two  three. Four", 10) == "Four" and chunking.ending("One. Two  three.  Four", 16) == "Two  three. Four" and chunking.ending("abcdef", 3) == "def" and chunking.ending("a", 0) == ""


def brute_chunks(paras, size, overlap):
    """By the definition, a character at a time where that is possible: grows each chunk until the next piece would not fit."""
    import re

    gap = re.compile(r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])")

    def tail(t):
        if len(t) <= overlap:
            return t
        parts = gap.split(t)
        fitting = [" ".join(parts[i:]) for i in range(len(parts)) if len(" ".join(parts[i:])) <= overlap]
        return max(fitting, key=len) if fitting else t[len(t) - overlap :].lstrip()

    out, open_ = [], ["", None]

    def close():
        if open_[0]:
            out.append(tuple(open_))

    for text, section in paras:
        if open_[0] and section != open_[1] and len(open_[0]) >= size / 2:
            close()
            open_[:] = [tail(open_[0]), section]
        pieces = [(text, "\n\n")]
        if len(text) > size:
            close()
            open_[:] = ["", section]
            pieces = [(p, " ") for p in gap.split(text)]
        for piece, joint in pieces:
            if len(piece) > size:
                close()
                out.extend((piece[i : i + size].strip(), section) for i in range(0, len(piece), size - overlap) if piece[i : i + size].strip())
                open_[:] = ["", section]
            elif not open_[0]:
                open_[:] = [piece, section]
            elif len(open_[0] + joint + piece) <= size:
                open_[0] += joint + piece
            else:
                close()
                open_[:] = [tail(open_[0]) + joint + piece, section]
        if len(text) > size:
            close()
            open_[:] = ["", None]
    close()
    return out


def test_chunks_like_brute_force():
    r = random.Random(5)
    for _ in range(300):
        paras, section = [], None
        for _ in range(r.randint(1, 8)):
            section = r.choice([section, section, "A", "B"])
            words = ["".join(r.choice("abc") for _ in range(r.randint(1, 9))) + r.choice(["", "", ".", "!"]) for _ in range(r.randint(1, 40))]
            paras.append((" ".join(w.capitalize() if r.random() < 0.5 else w for w in words), section))
        size = r.randint(20, 120)
        overlap = r.randint(1, size - 1)
        assert list(chunking.Packing(size, overlap).packed(paras)) == brute_chunks(paras, size, overlap)
    blank = [("abcdefghi jklmnop  qrstuvwxyz abc" + " " * 30 + "d", None)]
    got = [t for t, _ in chunking.Packing(10, 2).packed(blank)]
    assert got[:3] == ["abcdefghi", "i jklmnop", "p  qrstuvw"] and all(t == t.strip() and t for t in got) and list(chunking.Packing(10, 2).packed(blank)) == brute_chunks(blank, 10, 2)


def test_checklists(spark):
    df = spark.createDataFrame([("1", "o", "SBA", date(2026, 6, 10)), ("2", "Sources Sought", None, None), ("3", None, "", date(2026, 5, 1)), ("4", "u", "X", date(2026, 6, 2))], "notice_id string, type string, set_aside string, deadline date")
    by = {}
    for r in checklist.checklist(df, F.lit("2026-06-01 00:00:00").cast("timestamp")).orderBy("notice_id", "position").collect():
        by.setdefault(r.notice_id, []).append(r)
    assert [len(by[k]) for k in "1234"] == [2 + 4 + 1 + 2, 3 + 2, 1 + 2, 1 + 1 + 2]
    assert by["3"][0].action.startswith("Deadline has passed") and by["3"][0].priority == "high" and by["1"][0].priority == "normal" and by["4"][0].priority == "high"
    assert by["1"][1].due == "2026-06-08" and by["3"][1].source == "rules engine"


def test_store(spark):
    r = spark.createDataFrame([("k", 1, 100.0, 10, "a"), ("k", 2, 105.0, 10, "b"), ("z", 3, 100.0, 0, "c")], "key string, seq int, created double, ttl int, payload string")
    assert [x.payload for x in store.cached(r, F.lit(112.0)).collect()] == ["b"] and store.cached(r, F.lit(120.0)).count() == 0
    assert store.cached(r, F.lit(1e9), F.lit(-1)).count() == 2
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "id int, text string")
    assert [x.id for x in store.new_documents(docs.where("id = 1"), docs, "id", "text").collect()] == [2]


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ledger.daily_counts(stream).writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.day, r.used) for r in spark.table("days").collect()} == {(r.d, r.n) for r in events.groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n")).collect()}
    q = ledger.first_arrivals(stream, ["event_id"]).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("firsts").count() == events.select("event_id").distinct().count()
