"""Queries that do the whole of what a registered part does, by brute force."""

import re

from pyspark.sql import functions as F

from bidlens.functions import text as T
from bidlens.operators import chunking
from bidlens.operators.search import numbered_by
from bidlens.registry import ORACLE_SQL, QUERIES
from bidlens.sources.tables import notices, table

from .oracle import compare

SF = "/root/testdata/sf0.001"


def test_contacts_of_all_customers(spark):
    sf = "/root/testdata/sf0.01"
    assert table(spark, sf, "customer").where("c_custkey > 500").count()
    assert compare(spark, "contact_primary_all", QUERIES["contact_primary_all"], ORACLE_SQL["contact_primary_all"], sf)


def test_requirements_meet_sections_of_all_sources(spark):
    own = {r.section for r in QUERIES["requirement_section_map_all"](spark, SF).collect()}
    sources = {r.source for r in table(spark, SF, "documents").where(F.col("doc_id").isin(*own)).collect()}
    assert len(sources) > 1


def test_recommended_from_all_notices(spark):
    ids = [r.notice_id for r in QUERIES["recommend_ranked"](spark, SF).collect()]
    assert notices(spark, SF).where(F.col("notice_id").isin(*ids) & (F.col("posted") < "2000-06-01")).count()


def brute_heading(line):
    s = line.strip()
    words, letters = s.split(), [c for c in s if c.isalpha()]
    if not 3 <= len(s) <= 90 or (s[0] != "#" and s[-1] in ".!?,;"):
        return False
    numbered = re.match(r"(\d+(\.\d+)*|[IVXLCDM]+)[.)]\s", s)
    loud = letters and sum(c.isupper() for c in letters) / len(letters) >= 0.6
    titled = len(words) > 1 and sum(w[0].isupper() for w in words) / len(words) >= 0.7
    return bool(s[0] == "#" or numbered or (len(words) <= 12 and (loud or titled)))


def test_heading_lines(spark):
    got = {(r.doc_id, r.pos): r.heading for r in QUERIES["heading_lines"](spark, SF).collect()}
    docs = table(spark, SF, "documents").where("text IS NOT NULL").collect()
    assert got == {(d.doc_id, i): brute_heading(x) for d in docs for i, x in enumerate(d.text.split("\n"))}


def test_numbers_over_ranges(spark):
    rows = [(g, k) for g in ("a", "b", None) for k in (-7, -3, 0, 2, 3, 5, 6, 40, None)]
    got = {(r.g, r.k): r.n for r in numbered_by(spark.createDataFrame(rows, "g string, k long").repartition(3), "g", "k", "n", bucket=3).collect()}
    assert got == {(g, k): i for g in ("a", "b", None) for i, k in enumerate((None, -7, -3, 0, 2, 3, 5, 6, 40), 1)}
    sparse = [("a", 2**40 * i + (i % 7) * 10**9) for i in range(400)] + [("b", -(2**50))]
    df = spark.createDataFrame(sparse, "g string, k long").repartition(3)
    got = numbered_by(df, "g", "k", "n", bucket=50)
    assert {(r.g, r.k): r.n for r in got.collect()} == {x: i for g in "ab" for i, x in enumerate(sorted(y for y in sparse if y[0] == g), 1)}
    plan = QUERIES["citations"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan


def brute_score(kind, category, name, n):
    score = {"Proposal": 12, "Technical Document": 8}.get(kind, 0) + 10 * (kind == "Past Performance" and n >= 5)
    score += 4 * (category in ("Technical", "Past Performance")) + min(n, 25) * 0.5
    score += 6 * any(w in name.lower() for w in ("proposal", "excitation", "technical volume", "volume 1"))
    score -= 8 * (kind in ("Capability Statement", "Pricing") and n <= 3)
    return score - 6 * any(w in name.lower() for w in ("line card", "capabilities statement"))


def test_template_score(spark):
    rows = [
        ("Proposal", "Technical", "Volume 1", 40), ("Technical Document", "Technical", "x", 2), ("Past Performance", "Past Performance", "x", 4),
        ("Past Performance", "Past Performance", "x", 5), ("Pricing", "Pricing", "x", 3), ("Pricing", "Pricing", "x", 4), ("Other", "src1", "Line Card", 0),
    ]
    df = spark.createDataFrame(rows, "kind string, category string, name string, n int").withColumn("s", T.template_score(F.col("kind"), F.col("category"), F.col("name"), F.col("n")))
    assert [r.s for r in df.collect()] == [brute_score(*r) for r in rows]


def test_template_scored(spark):
    chunks = {int(r.doc_id): r["count"] for r in chunking.chunks(table(spark, SF, "documents"), "doc_id", "text").groupBy("doc_id").count().collect()}
    docs = QUERIES["doc_type_rules"](spark, SF).join(table(spark, SF, "documents"), "doc_id").collect()
    scored = [(brute_score(d.doc_type, d.source, f"doc_{d.doc_id}", chunks.get(d.doc_id, 0)), -d.doc_id) for d in docs]
    best = max(scored)
    assert [tuple(r) for r in QUERIES["template_scored"](spark, SF).select("doc_id", "score").collect()] == ([(-best[1], best[0])] if best[0] > 0 else [])
