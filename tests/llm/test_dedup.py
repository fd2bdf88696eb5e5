import random

import pytest

from bidlens.llm.line_dedup import deduped_lines
from bidlens.llm.queries import QUERIES
from bidlens.llm.substring_dedup import deduped_substrings
from pyspark.sql import functions as F

from . import brute

SF = "/root/testdata/sf0.001"


def rows_of(spark, sf=SF):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_lines_like_brute_force(spark):
    got = sorted((tuple(r) for r in QUERIES["op3_line_dedup"](spark, SF).collect()), key=repr)
    assert got == brute.lines(rows_of(spark))
    assert sum(r[2] for r in got) > 0


def test_lines_edges(spark):
    long = "Ein Satz mit genügend vielen Zeichen für den Schlüssel"
    rows = [(i, f"{long}\nown {i}\n {long.upper().replace('Ü', 'ü')}\t") for i in range(1, 6)] + [(6, None), (7, ""), (8, "\n\n"), (None, long), (5, long), (9, "x" * 39), (10, ("y " * 30 + "\n") * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keys", F.lit(1)).withColumn("id", F.lit("a")).withColumn("n_lines", F.lit(7))
    out = deduped_lines(df)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, brute.sha(r.kept_text)) for r in out.collect()), key=repr)
    assert got == brute.lines(rows)
    assert {"keys", "id"} <= set(out.columns)
    assert deduped_lines(df.limit(0)).count() == 0


def test_substrings_like_brute_force(spark):
    got = sorted(tuple(r) for r in QUERIES["op4_substring_dedup"](spark, SF).collect())
    assert got == brute.substrings(rows_of(spark))
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_few_words(spark, seed):
    """Few words make windows meet in every way, inside a document too."""
    r = random.Random(seed)
    blocks = [" ".join(r.choice("abcd") for _ in range(r.randint(5, 60))) for _ in range(12)]
    rows = [(i, " ".join(r.choice(blocks) if r.random() < 0.7 else r.choice("abcdefgh") for _ in range(r.randint(0, 9)))) for i in range(60)] + [(100, "z " * 3000), (101, None), (102, "z " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for k in (20, 7):
        got = sorted((x.doc_id, x.n_words, x.n_removed, brute.sha(x.kept_text)) for x in deduped_substrings(df, k=k).collect())
        assert got == brute.substrings(rows, k)


def test_substrings_edges(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, "a b"), (3, None), (4, "")], "doc_id long, text string").withColumn("th", F.lit(0)).withColumn("firsts", F.lit("x"))
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in deduped_substrings(df).collect()), key=repr)
    assert got == sorted([(1, 30, 0), (1, 30, 0), (2, 30, 30), (None, 2, 0), (3, 0, 0), (4, 0, 0)], key=repr)
    assert [s.asDict() for s in deduped_substrings(df).where("doc_id = 2").first().spans] == [{"start": 0, "n": 30}]
    assert deduped_substrings(df.limit(0)).count() == 0


def test_line_dedup_with_clashing_names(spark):
    line = "a line of more than forty characters that five documents hold"
    rows = [(i, line + "\nown") for i in range(6)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"drop_id": F.lit(1), "Drop_Keys": F.lit("x"), "_drop_keys": F.lit("y"), "keys": F.lit(2), "n_lines": F.lit("z")})
    got = {r.doc_id: r for r in deduped_lines(df).collect()}
    assert got[5].n_dropped == 0 and got[0].kept_text == "own" and got[0].drop_id == 1 and got[0]["Drop_Keys"] == "x" and got[None].kept_text == "" and got[None].n_lines == 1


def test_chains_compact_over_joins(spark):
    """A long passage that repeats is one span of its source; a branch within another one parts it."""
    from bidlens.llm.substring_dedup import chains

    rows = [(i, i - 1 or None, i + 1 if i < 40 else None, 7, 1, 3 * i, 3) for i in range(1, 41)]
    rows += [(100, None, 101, 7, 1, 200, 2), (101, 100, None, 7, 1, 202, 2), (102, 101, None, 8, 1, 204, 2), (200, None, 201, 9, 1, 0, 1), (201, 200, None, 9, 1, 5, 1), (300, None, None, None, 1, 0, 4)]
    df = spark.createDataFrame(rows, "key long, before long, after long, id long, th long, lo int, n int").repartition(3)
    want = [(7, 1, 3, 120), (7, 1, 200, 4), (8, 1, 204, 2), (9, 1, 0, 1), (9, 1, 5, 1), (None, 1, 0, 4)]
    assert sorted((tuple(r) for r in chains(df).collect()), key=repr) == sorted(want, key=repr)
    assert chains(df.limit(0)).count() == 0
