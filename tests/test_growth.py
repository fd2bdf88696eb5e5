"""What must not grow faster than its input."""

import hashlib
import math
import random
import re
import time
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from bidlens.functions import text as T
from bidlens.functions import vocabulary as V
from bidlens.operators import embedding as E
from bidlens.operators import knowledge as K
from bidlens.operators import proposal as P
from bidlens.plans.recommend import recommended
from bidlens.registry import ORACLE_SQL, QUERIES
from bidlens.storage import stored
from bidlens.streaming import budget

from . import oracle


def test_notices_of_the_same_text_are_searched_for_once(spark, monkeypatch):
    sent = []

    def crossed(queries, items, work, schema, **how):
        sent.append((queries.count(), how["query_rows"]))
        return real(queries, items, work, schema, **how)

    real = E.crossed
    monkeypatch.setattr(E, "crossed", crossed)
    kind = F.when(F.col("id") % 3 == 0, "pump").otherwise("valve")
    n = spark.range(6000).select(
        F.col("id").cast("string").alias("notice_id"), F.col("id").alias("notice_no"), F.concat(F.lit("Repair "), kind).alias("title"), F.lit("A.B.C").alias("path"),
        F.lit("N").alias("naics"), F.lit("S").alias("set_aside"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("deadline"),
    )
    chunks = spark.createDataFrame([(7, 1, "A pump"), (8, 1, "roads"), (9, 2, "pump repair")], "chunk_no long, doc_id long, text string")
    got = recommended(n, chunks, queries=["REPAIR", "no such"], firm_naics=[], as_of="2023-12-31 00:00:00", top_k=3).collect()
    assert [r.notice_id for r in got] == ["0", "3", "6"] and all(r.evidence == [9, 7, 8] and r.matched == ["REPAIR"] for r in got)
    assert len(sent) == 1 and sent[0][0] == 2 and sent[0][1] > 6000


def test_blocks_of_many_short_queries(spark, monkeypatch):
    """Slices of queries, of which each is multiplied by the dimensions that it has, give what all pairs give."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = lambda n, most: [(i, " ".join(r.choice(words) for _ in range(r.randint(0, most)))) for i in range(n)]
    backend = E.Hashed(128)
    rows = lambda n, most: backend.embed(spark.createDataFrame(texts(n, most), "id long, text string").repartition(3), "id", "text").localCheckpoint()
    q, x = rows(500, 4), rows(90, 20)
    monkeypatch.setattr(E, "QUERY_ROWS", 50)
    monkeypatch.setattr(E, "BATCH", 40)
    got = {}
    for row in E.nearest(q, x, 3, dimension=128, item_rows=60).collect():
        got.setdefault(row.q, []).append((row["rank"], row.id, row.score))
    vectors = {i.id: dict(map(tuple, i.v)) for i in x.collect()}
    for row in q.collect():
        own = dict(map(tuple, row.v))
        best = sorted((-(round(sum(w * v.get(d, 0.0) for d, w in own.items()), 6) + 0.0), i) for i, v in vectors.items())[:3]
        assert [(i, s) for _, i, s in sorted(got[row.id])] == [(i, -s) for s, i in best]


def test_a_budget_of_many_keys_has_few_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(budget, "AT_ONCE", 30)
    r = random.Random(3)
    rows = [(r.choice([None, *(f"k{i}" for i in range(700))]), i, datetime(2024, 1, r.randint(1, 2), 0, 0, r.randint(0, 59))) for i in range(4000)] + [(None, 4000 + i, datetime(2024, 1, 1)) for i in range(5)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, "key string, request long, ts timestamp").repartition(5).write.parquet(source)
    stream = spark.readStream.schema("key string, request long, ts timestamp").parquet(source)
    q = budget.admitted(stream, 2).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    want, n = {}, {}
    for key, request, ts in sorted(rows, key=lambda x: (x[2], x[1])):
        n[key, ts.day] = n.get((key, ts.day), 0) + 1
        want[request] = (key, f"2024-01-0{ts.day}", n[key, ts.day] <= 2, min(n[key, ts.day], 2))
    assert {x.request: (x.key, x.day, x.admitted, x.used) for x in spark.read.parquet(out).collect()} == want
    assert 0 < max(p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators) < 700


def test_summaries_look_at_no_more_than_they_keep(spark):
    """A paragraph of many sentences; the sentences were once found anew for each of them."""
    para = "Offers are due. " * 1500
    df = spark.range(2000).select(F.concat(F.lit("Head\n\n"), F.col("id").cast("string"), F.lit(". " + para)).alias("text")).localCheckpoint()
    began = time.monotonic()
    got = {r.s for r in df.select(T.summary(F.col("text")).alias("s")).collect()}
    assert time.monotonic() - began < 20
    assert len(got) == 2000 and "7. " + ("Offers are due. " * 17).strip() in got and max(map(len, got)) <= 280


def _library(spark):
    rows = [(i, f"d{i}.txt", "General", ("SCOPE\n\n" if i % 2 else "") + f"Generators of kind {i} are repaired. " * 20) for i in range(8)]
    return K.described(spark.createDataFrame([*rows, (8, "h.txt", "General", "Only A Heading"), (9, "i.txt", "General", "")], "doc_id long, name string, category string, text string"))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_contextual_chunks_take_their_document_with_them(spark):
    found = K.contextual_chunks(_library(spark), size=300, overlap=20)
    assert "Join" not in _plan(found) and _plan(found).count("MapInArrow") == 1
    rows = found.collect()
    assert {r.doc_id for r in rows} == set(range(8)) and all(r.name == f"d{r.doc_id}.txt" and r.embed_text.endswith(r.text) and r.summary in r.embed_text for r in rows)


def test_rows_are_embedded_where_they_are(spark, tmp_path):
    backend = E.Hashed(32)
    index = K.embedded(K.contextual_chunks(_library(spark), size=300, overlap=20), backend)
    assert "Join" not in _plan(index) and _plan(index).count("MapInArrow") == 2  # chunks and vectors, once each
    K.saved(index, str(tmp_path / "index"))
    again = K.loaded(spark, str(tmp_path / "index"), E.Hashed(64))
    assert "Join" not in _plan(again) and again.columns == index.columns
    want = {r.id: r.v for r in E.Hashed(64).embed(index, "chunk_no", "embed_text").collect()}
    assert {r.chunk_no: r.v for r in again.collect()} == want and want


def test_moved_chunks_are_made_once(spark):
    backend, docs = E.Hashed(32), _library(spark)
    index = K.embedded(K.contextual_chunks(docs, size=300, overlap=20), backend).localCheckpoint()
    told, new = K.recategorised(docs, index, spark.createDataFrame([(3, "Best")], "doc_id long, category string"), backend)
    assert _plan(new).count("MapInArrow") == 1
    assert {(r.doc_id, " — Best" in r.embed_text) for r in new.collect()} == {(i, i == 3) for i in range(8)} and new.count() == index.count()


def test_documents_without_prose_are_gone_through_once(spark):
    docs = _library(spark)
    index, todo = K.rechunked(docs, K.embedded(K.contextual_chunks(docs.limit(0)), E.Hashed(32)), E.Hashed(32))
    assert {r.doc_id for r in index.collect()} == set(range(8)) and todo.count() == 10
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 2, "Another text.").otherwise(F.col("text")))
    again, todo = K.rechunked(changed, index.localCheckpoint(), E.Hashed(32), known=K.fingerprints(docs))
    assert [r.doc_id for r in todo.collect()] == [2] and {r.doc_id for r in again.collect()} == set(range(8))
    _, todo = K.rechunked(docs, index.where("doc_id <> 1").localCheckpoint(), E.Hashed(32), known=K.fingerprints(docs.where("doc_id <> 1")))
    assert [r.doc_id for r in todo.collect()] == [1]


def test_headings_alone_count_as_kept(spark, tmp_path, monkeypatch):
    texts = ["Some words of prose here.", "Only A Heading", "", "Two words more."]
    spark.createDataFrame([(i, texts[i % 4], "en", "src1", 0) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(oracle, "TABLES", ["documents"])
    assert oracle.compare(spark, "index_rechunked", QUERIES["index_rechunked"], ORACLE_SQL["index_rechunked"], str(tmp_path))


def test_an_index_that_is_made_anew_is_not_read(spark):
    docs = _library(spark)
    old = K.embedded(K.contextual_chunks(docs.withColumn("text", F.raise_error(F.lit("read")))), E.Hashed(32))
    assert K.rechunked(docs, old, E.Hashed(32))[0].count() >= 8


def test_texts_are_rebuilt_in_the_time_of_their_length(spark):
    r = random.Random(2)
    text = "".join(r.choice("ab ") for _ in range(30_000))
    rows = [(d, i, text[at : at + 3600]) for d in range(150) for i, at in enumerate(range(0, len(text), 3200))]
    df = spark.createDataFrame([*rows, (200, 0, "x"), (200, 1, None), (200, 2, "y" * 30), (200, 3, "y" * 40)], "doc_id int, ordinal int, text string").repartition(4).localCheckpoint()
    began = time.monotonic()
    got = {r.doc_id: r.text for r in K.rebuilt(df).collect()}
    assert time.monotonic() - began < 15
    assert got.pop(200) == "x\n\n" + "y" * 30 + "\n\n" + "y" * 10 and len(got) == 150
    assert set(got.values()) == {text[:3600] + "".join("\n\n" + text[at + 400 : at + 3600] for at in range(3200, len(text), 3200))}


def test_evidence_reads_tables_as_they_are(spark, monkeypatch):
    """A solicitation is chunked and embedded once, and its written chunks are not stored again for a search."""
    backend = E.Hashed(64)
    files = spark.createDataFrame([(7, "sow.txt", "Offerors must repair generators. " * 9), (8, "none.txt", "")], "doc_id long, name string, text string")
    index = P.solicitation_index(files, backend, size=100, overlap=10)
    assert "Join" not in _plan(index) and _plan(index).count("MapInArrow") == 2
    chunks, names, real = stored(index, "solicitation"), [], E.stored
    monkeypatch.setattr(E, "stored", lambda df, name: names.append(name) or real(df, name))
    asked = spark.createDataFrame([(0, "generators"), (1, "roads")], "no long, query string")
    rows = P.searched(asked, chunks, 2, backend, written=True).collect()
    assert "items" not in names and {r.q for r in rows} == {0, 1}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, P.searched(asked, index, 2, backend).collect())) and "items" in names


def test_white_space_of_ends(spark):
    texts = ["", " \t\n\x0b\f\r\x85\xa0       　", *(f"{a}x y{a}" for a in " \xa0 　\n")]
    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(T.stripped(F.col("t")).alias("s")).collect()]
    assert got == [t.strip() for t in texts]


def test_vectors_like_word_by_word():
    r = random.Random(4)
    texts = ["", None, "the of", "K É1a2 İx ſet 12 a", *(" ".join(r.choice(["Pump", "pump", "Valve", "roads9", "x", "été"]) for _ in range(r.randint(1, 30))) for _ in range(50))]
    got = E._vectors([t if t is None else t.encode() for t in texts], 5).to_pylist()
    for text, v in zip(texts, got):
        own = {}
        for word, n in Counter(t.lower() for t in re.findall("[A-Za-z0-9]{2,}", text or "")).items():
            if word not in V.EMBED_STOPWORDS:
                h = hashlib.md5(word.encode()).digest()
                own.setdefault(int.from_bytes(h[:4], "little") % 5, []).append((1.0 if h[4] % 2 else -1.0) * (1 + math.log(n)))
        sums = {d: sum(sorted(w)) for d, w in own.items()}
        norm = math.sqrt(sum(w * w for w in sums.values()))
        assert {x["dim"]: round(x["w"], 12) for x in v} == {d: round(w / norm, 12) if norm else 0.0 for d, w in sums.items()}
