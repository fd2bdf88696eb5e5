from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as cp

from . import brute
from .test_jaccard import brute_classes
from .test_language_decontamination import brute_contaminations
from .test_packing_sharding import whole

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def kept_lines(rows):
    holders = defaultdict(list)
    for doc, text in rows:
        for key in {x.strip(brute.BLANK).translate(brute.LOWER) for x in (text or "").split("\n")}:
            if len(key) >= 40:
                holders[key].append(doc)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    return [(d, "\n".join(x for x in (t or "").split("\n") if keeper.get(x.strip(brute.BLANK).translate(brute.LOWER), d) == d)) for d, t in rows]


def test_stages_like_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, items = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    start = pairs(docs)
    docs = cp.stored(cp.language(spark, docs, SF), "t1")
    assert docs.columns == columns and len(start) - docs.count() <= len([t for _, t in start if not any(c.isalpha() for c in t or "")]) + 2
    before = pairs(docs)
    docs = cp.stored(cp.lines(spark, docs, SF), "t2")
    assert docs.columns == columns and sorted(pairs(docs)) == sorted(kept_lines(before))
    assert docs.where("n_chars <> length(text)").count() == 0
    before = pairs(docs)
    docs = cp.stored(cp.near_duplicates(spark, docs, SF), "t3")
    keep = {d for d, _, c in brute_classes(before, 5, 80) if d == c}
    assert docs.columns == columns and sorted(pairs(docs)) == sorted(x for x in before if x[0] in keep) and len(keep) < len(before)
    before = pairs(docs)
    docs = cp.stored(cp.decontamination(spark, docs, SF), "t4")
    leaks = {x[0] for x in brute_contaminations(before, items)}
    assert docs.columns == columns and sorted(pairs(docs)) == sorted(x for x in before if x[0] not in leaks) and leaks
    got = defaultdict(int)
    for r in cp.packing(spark, docs, SF).collect():
        got[r.doc_id] += r.length
    assert got == {d: len(whole(t or "")) + 1 for d, t in pairs(docs)}


def odd_documents(spark):
    body = " ".join(f"word{i} the of" for i in range(40))
    line = "a line that is longer than forty characters by far"
    rows = [(i, f"{line}\n{body} number{i} {i} ends", "en") for i in range(6)] + [(20, "Les mots de la langue " * 2000, "fr")] * 2
    rows += [(None, None, None), (30, None, "en"), (31, "", None), (32, "12 34 !!", "en"), (None, f"{body} nobody", None), (33, "слово язык речь письмо " * 30, None), (34, "x " * 70_000 + "the end", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n_chars", F.length("text").cast("long"))
    names = ["gone_id", "copy", "likeness", "drop_keys", "drop_id", "matches0", "id", "Score", "lang_pred", "kept_text", "n_lines", "component"]
    return df.withColumns({n: F.lit(n) for n in names})


def test_stages_on_odd_rows(spark):
    docs = odd_documents(spark)
    kept = cp.stored(cp.language(spark, docs, SF), "odd")
    got = kept.collect()
    assert kept.columns == docs.columns and {r.doc_id for r in got} == {0, 1, 2, 3, 4, 5, 20, None, 34}
    assert {r.lang for r in got} == {"en", "fr"} and all(r.copy == "copy" and r.likeness == "likeness" and r["Score"] == "Score" and r.lang_pred == "lang_pred" for r in got)
    assert [r.lang for r in got if r.doc_id is None] == ["en"]  # a null label is filled in
    for stage in (cp.lines, cp.near_duplicates, cp.decontamination):
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert out.columns == docs.columns and all(r.gone_id == "gone_id" and r.drop_keys == "drop_keys" and r.component == "component" and r.kept_text == "kept_text" and r.n_lines == "n_lines" for r in rows)
        if stage is cp.near_duplicates:
            assert sorted((r.doc_id for r in rows), key=repr) == sorted([0, 20, 30, 31, 32, 33, 34, None, None], key=repr)
        else:
            assert len(rows) == docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert cp.language(spark, docs.limit(0), SF).count() == 0
    pieces = cp.packing(spark, docs, SF)
    assert pieces.where("start = 0").count() == docs.count() and cp.packing(spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    assert cp.run(spark, SF).count() > 100
    assert [n for n, _ in cp.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "packing"]


def test_near_duplicates_of_few_documents_in_few_jobs(spark):
    """The driver takes memory for each stage and each table that is read, so a small input must not have many."""
    docs = cp.stored(spark.read.parquet(f"{SF}/documents.parquet"), "few")
    spark.sparkContext.setJobGroup("near", "near_duplicates")
    try:
        cp.stored(cp.near_duplicates(spark, docs, SF), "near")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("near")) <= 65
