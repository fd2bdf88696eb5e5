"""State that is written: caches, versions, drafts, pages as a source, budgets of streams, rechunked indexes."""

import json
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from bidlens.operators import embedding as E
from bidlens.operators import knowledge as K
from bidlens.operators import snapshots
from bidlens.operators.drafts import Drafts
from bidlens.operators.responses import Cache, fetched
from bidlens.sources import pages as P
from bidlens.streaming.budget import admitted

ROWS = "key string, created double, seq long, ttl int, payload string"


def test_cache_like_a_dictionary(spark, tmp_path):
    """Rounds of sets and invalidations against a plain dictionary, with compactions between them."""
    r = random.Random(2)
    cache, want, seq = Cache(spark, str(tmp_path / "cache"), 4), {}, 0
    assert cache.get(F.lit(0.0)).count() == 0 and cache.compact() == [] and cache.clear() == 0
    for turn in range(4):
        sets, gone = [], []
        for key in r.sample([f"k{i}" for i in range(12)], 7):
            seq += 1
            if r.random() < 0.6:
                want[key] = (100.0 * turn, r.choice([-1, 0, 50, 1000]), f"p{seq}")
                sets.append((key, 100.0 * turn, seq, *want[key][1:]))
            else:
                want.pop(key, None)
                gone.append((key, 100.0 * turn, seq))
        cache.set(spark.createDataFrame(sets, ROWS))
        cache.invalidate(spark.createDataFrame(gone, "key string, created double, seq long"))
        for now in (100.0 * turn, 100.0 * turn + 60):
            fresh = {k: p for k, (c, ttl, p) in want.items() if ttl < 0 or (ttl > 0 and now < c + ttl)}
            assert {x.key: x.payload for x in cache.get(F.lit(now)).collect()} == fresh
            assert {x.key for x in cache.get(F.lit(now), F.lit(-1), keys=spark.createDataFrame([("k1",), ("k2",)], "key string")).collect()} == want.keys() & {"k1", "k2"}
        if turn % 2:
            before = cache.rows().count()
            assert cache.compact() and cache.rows().count() == len(want) < before and cache.compact() == []
            assert {x.key: x.payload for x in cache.last().collect()} == {k: v[2] for k, v in want.items()}
    assert cache.clear() == len(want) and cache.last().count() == 0


def test_buckets_without_rows_go(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "cache"), 2)
    cache.set(spark.createDataFrame([("a", 1.0, 1, 5, "x")], ROWS))
    cache.invalidate(spark.createDataFrame([("a", 1.0, 2)], "key string, created double, seq long"))
    assert cache.compact() and cache.rows().count() == 0


def test_requests_go_to_the_cache_first(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "cache"), 2)
    source = spark.createDataFrame([(k, f"page {k}") for k in "abcde"], "key string, payload string")
    ask = lambda keys, **how: {(x.key, x.seq): (x.status, x.payload) for x in fetched(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, seq long"), cache, source, **how).collect()}
    assert ask("abza", now=10, left=3) == {("a", 0): ("live", "page a"), ("b", 1): ("live", "page b"), ("z", 2): ("not_found", None), ("a", 3): ("live", "page a")}
    assert ask("abcd", now=20, left=1) == {("a", 0): ("cached", "page a"), ("b", 1): ("cached", "page b"), ("c", 2): ("live", "page c"), ("d", 3): ("over_budget", None)}
    assert ask("ad", now=20, left=5, network=False) == {("a", 0): ("cached", "page a"), ("d", 1): ("offline", None)}
    assert ask("d", now=20, left=5, signed=False) == {("d", 0): ("unsigned", None)} and ask("d", now=20, left=0) == {("d", 0): ("over_budget", None)}
    assert ask("a", now=20, left=5, refresh=True) == {("a", 0): ("live", "page a")}
    assert ask("a", now=20 + 43_200, left=0) == {("a", 0): ("over_budget", None)} and ask("a", now=20 + 43_200, left=0, ttl=-1) == {("a", 0): ("cached", "page a")}


def test_a_failed_writer_leaves_the_version_before(spark, tmp_path):
    root = str(tmp_path / "index")
    df = spark.range(10)
    with pytest.raises(FileNotFoundError):
        snapshots.loaded(spark, root)
    first = snapshots.saved(df, root)
    reader = snapshots.loaded(spark, root)
    with pytest.raises(Exception, match="stop here"):
        snapshots.saved(df.select(F.when(F.col("id") == 7, F.raise_error(F.lit("stop here"))).otherwise(F.col("id")).alias("id")), root)
    assert snapshots.versions(spark, root) == [first] and snapshots.loaded(spark, root).count() == 10
    names = [snapshots.saved(spark.range(n), root) for n in (20, 30)]
    assert reader.count() == 10 and snapshots.loaded(spark, root).count() == 30 and snapshots.loaded(spark, root, names[0]).count() == 20
    gone = snapshots.pruned(spark, root, 1)
    assert first in gone and names[0] in gone and snapshots.versions(spark, root, complete=False) == [names[1]]
    assert snapshots.loaded(spark, root).count() == 30


class Counting(E.Hashed):
    """Vectors under a name of their own, which tells rows that were embedded with it."""

    def signature(self):
        return "counting"


def test_only_changed_documents_are_chunked_anew(spark):
    rows = [(i, f"d{i}.txt", "General", f"Generators of kind {i} are repaired. " * 30) for i in range(6)]
    docs = lambda rows: K.described(spark.createDataFrame(rows, "doc_id long, name string, category string, text string"))
    index, todo = K.rechunked(docs(rows), K.embedded(K.contextual_chunks(docs(rows[:0])), E.Hashed(32)), E.Hashed(32), size=300, overlap=20)
    index = index.cache()
    assert todo.count() == 6 and index.count() > 12
    changed = [*rows[:2], (2, "d2.txt", "General", "Something else. " * 20), *rows[3:5], (9, "d9.txt", "General", "A new one. " * 30), (10, "e.txt", "General", "")]
    new, todo = K.rechunked(docs(changed), index, Counting(32), size=300, overlap=20)
    by = {}
    for r in new.collect():
        by.setdefault(r.doc_id, set()).add(r.signature)
    assert {r.doc_id for r in todo.collect()} == {2, 9, 10} and by == {0: {"hashing:32"}, 1: {"hashing:32"}, 2: {"counting"}, 3: {"hashing:32"}, 4: {"hashing:32"}, 9: {"counting"}}
    whole, _ = K.rechunked(docs(changed), spark.createDataFrame([], index.schema), E.Hashed(32), size=300, overlap=20)
    key = lambda df: sorted((r.chunk_no, r.text, [tuple(x) for x in r.v]) for r in df.collect())
    assert key(new) == key(whole)
    other, todo = K.rechunked(docs(rows), index, Counting(32), size=200, overlap=20)  # another way of cutting
    assert todo.count() == 6 and other.where("signature <> 'counting'").count() == 0


def test_drafts(spark, tmp_path):
    path = str(tmp_path / "drafts")
    drafts = Drafts(spark, path)
    assert drafts.current().count() == 0
    rows = spark.createDataFrame([("1", " ", "n1", "t", "a"), ("2", "Two", "n2", "t", "b"), ("3", "Three", "n1", "t", "c")], "draft_id string, name string, notice_id string, title string, content string")
    drafts.save(rows, "2024-01-01")
    changes = spark.createDataFrame([("1", "T", "aa"), ("9", "T", "x")], "draft_id string, title string, content string")
    assert [(r.draft_id, r.version, r.content, r.name) for r in drafts.update(changes, "2024-01-02").collect()] == [("1", 2, "aa", "Untitled draft")]
    (tmp_path / "drafts" / "broken.json").write_text('{"draft_id": "2", "version": 9, "content":\n{"draft_id": "7", "name": 5\n\nnonsense\n[1, 2]\n' + json.dumps({"draft_id": "3", "version": 5, "content": "later", "modified": "2024-01-05", "notice_id": "n1"}) + "\n")
    assert len(drafts.lines().where("corrupt IS NOT NULL").collect()) >= 3
    now = {r.draft_id: (r.version, r.content) for r in drafts.current().collect()}
    assert now == {"1": (2, "aa"), "2": (1, "b"), "3": (5, "later")}
    assert [r.draft_id for r in drafts.listing("n1").collect()] == ["3", "1"] and [r.draft_id for r in drafts.listing().collect()] == ["3", "1", "2"]
    drafts.delete(spark.createDataFrame([("1",), ("1",), ("8",)], "draft_id string"), "2024-01-06")
    assert {r.draft_id for r in drafts.current().collect()} == {"2", "3"}
    assert drafts.update(changes, "2024-01-07").count() == 0


def test_pages_as_a_source(spark, tmp_path):
    path = str(tmp_path / "pages")
    rows = [(f"n{i}", f"Pump {i}", "AB"[i % 2], None if i % 5 == 0 else "SBA", "oak"[i % 3], i % 4 != 0, None if i % 7 == 0 else date(2024, 1 + i % 6, 1 + i % 28)) for i in range(200)]
    n = spark.createDataFrame(rows, "notice_id string, title string, naics string, set_aside string, type string, is_active boolean, posted date")
    P.written(n, path, page=9)
    every = P.pages(spark, path)
    assert sorted(map(tuple, every.drop("page").collect()), key=str) == sorted(map(tuple, n.collect()), key=str)
    assert every.groupBy("posted", "page").count().count() > 6
    some = every.where((F.col("naics") == "A") & F.col("type").isin("o", "a") & (F.col("is_active") == F.lit(True)) & (F.col("posted") > F.lit(date(2024, 3, 10))))
    plain = n.where((F.col("naics") == "A") & F.col("type").isin("o", "a") & F.col("is_active") & (F.col("posted") > F.lit(date(2024, 3, 10))))
    assert sorted(r.notice_id for r in some.collect()) == sorted(r.notice_id for r in plain.collect())
    plan = some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    left = next(line for line in plan.splitlines() if line.startswith("Condition"))
    assert "naics" not in left and "type" not in left and "is_active" not in left and "posted" in left
    reader = P.PagesReader({"path": path})
    assert len(reader.partitions()) > 6
    list(reader.pushFilters([P.GreaterThan(("posted",), date(2024, 5, 1))]))
    assert {P._month(p.value) for p in reader.partitions()} == {"2024-05", "2024-06"}  # undated results can't pass
    found = P.search(spark, path, "PUMP 1", naics=["B"], posted_from=date(2024, 2, 1), posted_to=date(2024, 4, 30), limit=1000, active_only=False).collect()
    want = [r for r in rows if "1" in r[1] and r[2] == "B" and (r[6] is None or date(2024, 2, 1) <= r[6] <= date(2024, 4, 30))]
    assert {r.notice_id for r in found} == {r[0] for r in want} and any(r.posted is None for r in found)
    assert P.search(spark, path, "pump", limit=0).count() == 1 and P.search(spark, path, "pump", limit=1000).count() == 100
    P.written(n.limit(0), str(tmp_path / "none"))
    assert P.pages(spark, str(tmp_path / "none")).count() == 0


def test_a_budget_holds_after_a_restart(spark, tmp_path):
    """Three requests a day and key; the fourth is refused, also when the stream has been started anew."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda day, s: datetime(2024, 1, day, 0, 0, s)

    def run(rows):
        spark.createDataFrame(rows, "key string, request long, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, request long, ts timestamp").parquet(source)
        q = admitted(stream, 3).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        return {r.request: (r.admitted, r.used) for r in spark.read.parquet(out).collect()}

    got = run([("a", 1, at(1, 5)), ("a", 2, at(1, 1)), ("b", 3, at(1, 1))])
    assert got == {2: (True, 1), 1: (True, 2), 3: (True, 1)}
    got = run([("a", 4, at(1, 7)), ("a", 5, at(1, 6)), ("a", 6, at(2, 0)), ("b", 7, at(1, 9))])
    assert got[5] == (True, 3) and got[4] == (False, 3) and got[6] == (True, 1) and got[7] == (True, 2)
    got = run([("a", 8, at(1, 30)), ("a", 9, at(2, 1)), ("a", 10, at(2, 2)), ("a", 11, at(2, 3))])
    assert [got[i] for i in (8, 9, 10, 11)] == [(False, 3), (True, 2), (True, 3), (False, 3)]
