"""The knowledge base and drafts, by brute force and on small libraries."""

import random

from pyspark.sql import functions as F

from bidlens.operators import embedding as E
from bidlens.operators import knowledge as K
from bidlens.operators import mining
from bidlens.operators import proposal as P
from bidlens.plans.recommend import all_queries
from bidlens.registry import QUERIES
from bidlens.sources.tables import table  # isort: split
from bidlens.queries import documents

from .test_functions import values

HINTS, STOP = documents.HINTS, documents.STOP
SF = "/root/testdata/sf0.001"
DOCS = [
    (1, "power.txt", "Capabilities", "# Generator work\n\nWe repair generator excitation systems at power plants. Crews test every exciter."),
    (2, "roads.txt", "Uncategorized", "Past Performance\n\nAsphalt roads and bridges were built for the county. Paving takes care."),
    (3, "same.txt", "Capabilities", "# Generator work\n\nWe repair generator excitation systems at power plants. Crews test every exciter."),
    (4, "empty.txt", "Pricing", ""),
]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, name string, category string, text string")


def test_add_embeds_and_dedupes(spark):
    backend = E.Hashed(256)
    told, index = K.added(docs(spark).where("doc_id > 9"), docs(spark), backend)
    assert {r.doc_id: r.status for r in told.collect()} == {1: "indexed", 2: "indexed", 4: "no_chunks"}
    rows = {r.doc_id: r for r in index.collect()}
    assert set(rows) == {1, 2} and rows[1].embed_text.split("\n")[0] == "power.txt — Capabilities — Capability Statement — Generator work"
    assert rows[2].embed_text.startswith("roads.txt — Past Performance") and "Uncategorized" not in rows[2].embed_text
    again, none = K.added(docs(spark), docs(spark), backend)
    assert again.count() == 0 and none.count() == 0
    q = spark.createDataFrame([(0, "generator exciter repair"), (1, "paving county roads"), (2, "the")], "no long, query string")
    top = P.searched(q, index, 1, backend).collect()
    assert {r.q: (r.id // K.PER_DOCUMENT, r.score > 0) for r in top} == {0: (1, True), 1: (2, True), 2: (1, False)}


def test_reindex_and_recategorise(spark, tmp_path):
    old, new = E.Hashed(64), E.Hashed(256)
    described = K.described(docs(spark).where("doc_id <= 2"))
    K.saved(K.embedded(K.contextual_chunks(described), old), str(tmp_path / "index"))
    same, other = K.loaded(spark, str(tmp_path / "index"), old), K.loaded(spark, str(tmp_path / "index"), new)
    assert {r.signature for r in same.collect()} == {"hashing:64"} and {r.signature for r in other.collect()} == {"hashing:256"}
    told, index = K.recategorised(described, same, spark.createDataFrame([(2, "Technical"), (1, "Capabilities")], "doc_id long, category string"), old)
    assert {r.doc_id: (r.category, r.changed) for r in told.collect()} == {1: ("Capabilities", False), 2: ("Technical", True)}
    assert {r.doc_id: "Technical" in r.embed_text for r in index.collect()} == {1: False, 2: True}
    vectors = lambda df: {r.chunk_no: [tuple(x) for x in r.v] for r in df.collect()}
    assert vectors(index)[K.PER_DOCUMENT] == vectors(same)[K.PER_DOCUMENT] and vectors(index)[2 * K.PER_DOCUMENT] != vectors(same)[2 * K.PER_DOCUMENT]


def brute_rebuilt(parts):
    out, last = parts[0], parts[0]
    for t in parts[1:]:
        k = next((k for k in range(min(len(last), len(t), 1500), 24, -1) if last.endswith(t[:k])), 0)
        out, last = out + "\n\n" + t[k:], t
    return out


def test_rebuilt_texts(spark):
    r = random.Random(2)
    rows, want = [], {}
    for d in range(12):
        text = "".join(r.choice("ab ") for _ in range(r.randint(1, 900)))
        parts = [text[i : i + 120] for i in range(0, len(text), r.choice([60, 90, 120]))]
        want[d] = brute_rebuilt(parts)
        rows += [(d, i, t) for i, t in enumerate(parts)]
    r.shuffle(rows)
    chunks = spark.createDataFrame(rows, "doc_id long, ordinal int, text string")
    assert {x.doc_id: x.text for x in K.rebuilt(chunks).collect()} == want
    stored = spark.createDataFrame([(0, "kept"), (1, None), (99, None)], "doc_id long, text string")
    assert {x.doc_id: x.text for x in K.document_texts(stored, chunks).collect()} == {0: "kept", 1: want[1], 99: None}


def brute_exemplar(text, most):
    lines = "\n".join(x.rstrip() for x in text.strip().split("\n"))
    if len(lines) <= most:
        return lines
    head, enough = lines[:most], int(0.6 * most)
    cut = head.rfind("\n\n")
    if cut < enough:
        cut = max(head.rfind(m) for m in (". ", ".\n", "\n"))
    if cut < enough:
        cut = head.rfind(" ")
    return lines[: cut if cut > 0 else most].rstrip() + "…"


def test_exemplars(spark):
    r = random.Random(4)
    texts = ["".join(r.choice(["word", "x", " ", " ", ". ", "\n", "\n\n", ".\n"]) for _ in range(r.randint(1, 60))) for _ in range(150)] + ["y" * 100, ""]
    assert values(spark, texts, lambda c: P.exemplar(c, 40)) == [brute_exemplar(t, 40) for t in texts]


def test_nearest_like_brute_force(spark):
    r = random.Random(8)
    vectors = {i: [r.choice([0.0, 1.0, -1.0, 2.0]) for _ in range(3)] for i in range(60)}
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<double>").repartition(3)
    got = {}
    for x in E.nearest(df.where("id < 9"), df, 4, dimension=3, digits=5, others=True, normed=False).collect():
        got.setdefault(x.q, []).append((x["rank"], x.id, x.score))

    def cosine(a, b):
        norm = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / norm, 5) if norm else -1.0

    for q in range(9):
        best = sorted((-cosine(vectors[q], v), i) for i, v in vectors.items() if i != q)[:4]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    small = E.nearest(df.where("id < 9"), df, 4, dimension=3, digits=5, others=True, normed=False, query_rows=4, item_rows=7)
    assert sorted(map(tuple, small.collect())) == sorted((q, i, s, k) for q, rows in got.items() for k, i, s in rows)  # many blocks
    assert E.nearest(df.limit(0), df, 4, dimension=3).count() == 0 and E.nearest(df, df.limit(0), 4, dimension=3).count() == 0


def test_chunks_of_very_large_document_numbers(spark):
    df = spark.createDataFrame([(2**62, "a.txt", "General", "Some words about generators. " * 40), (-(2**62), "b.txt", "General", "Others about roads. " * 40)], "doc_id long, name string, category string, text string")
    backend = E.Hashed(64)
    _, index = K.added(df.limit(0), df, backend, size=200, overlap=20)
    rows = index.collect()
    assert {int(r.chunk_no) for r in rows} == {int(r.doc_id) * K.PER_DOCUMENT + r.ordinal for r in rows} and len(rows) > 8
    asked = backend.embed(spark.createDataFrame([(0, "generators")], "no long, t string"), "no", "t")
    top = E.nearest(asked, index.select(F.col("chunk_no").alias("id"), "v"), 2, dimension=64).collect()
    assert {int(r.id) // K.PER_DOCUMENT for r in top} == {2**62}


def test_evidence_and_drafts(spark):
    backend = E.Hashed(1024)
    _, index = K.added(docs(spark).limit(0), docs(spark), backend)
    library = index.withColumn("citation", F.concat("name", F.lit(" #1")))
    files = spark.createDataFrame([(7, "sow.txt", "Section M basis for award. The contractor shall repair generator exciter units | on site. Offerors must provide certifications."), (8, "none.txt", "")], "doc_id long, name string, text string")
    solicitation = P.solicitation_index(files, backend)
    sections = [P.Section("a", "Approach", "generator exciter repair", headings=("generator",), solicitation=1, facts=2, style=1), P.Section("b", "Roads", "asphalt paving", style=0), P.Section("c", "More", "zzz", optional=True, style=0)]
    got = P.gathered(sections, solicitation, library, backend).collect()
    mine = [(r.origin, r.label) for r in got if r.no == 0]
    assert ("solicitation", "Solicitation: sow.txt #1") in mine and ("style_exemplar", "KB style: power.txt #1") in mine and ("knowledge_base", "KB: power.txt #1") not in mine
    assert all(r.score >= 0.3 for r in got if r.origin == "knowledge_base")
    parts = P.scaffolds(sections[:2], spark.createDataFrame(got).where("no < 2"))
    page = P.draft_markdown(parts, "Draft").first().markdown
    assert page.startswith("# Draft\n\n## Approach") and page.index("## Approach") < page.index("## Roads") and "Solicitation: sow.txt" in page and "More" not in page
    matrix = P.compliance_matrix(P.compliance_evidence(solicitation, backend), parts, backend)
    rows = matrix.orderBy("item").collect()
    assert [r.category for r in rows] == ["SOW (shall)", "SOW (shall)"] and rows[0].section_title == "Approach" and rows[0].source == "Solicitation: sow.txt #1"
    text = P.matrix_markdown(matrix).first().markdown
    assert "units \\| on site" in text and text.rstrip().endswith("addressed_") and text.count("\n| ") == 4
    assert P.matrix_markdown(matrix.limit(0)).first().markdown.startswith("## Compliance Matrix")


def test_mined_queries_by_brute_force(spark):
    found = mining.query_candidates(table(spark, SF, "documents"), "doc_id", "text", hints=HINTS, stopwords=STOP)
    rows = sorted(found.collect(), key=lambda r: (-r.score, r.kind, (r.first.id, r.first.pos), r.term))
    want, covered = [], set()
    for r in rows:
        if len(want) < 6 and not set(r.term.split()) <= covered:
            want.append((r.term, r.kind, r.score))
            covered |= set(r.term.split())
    assert [tuple(r) for r in QUERIES["generated_queries"](spark, SF).collect()] == want
    assert all_queries(["a", "b", "a"], ["b", "c"]) == ["a", "b", "c"]


def test_outlines(spark):
    chunks = spark.createDataFrame([(1, 0, "B", "x"), (1, 1, "A ", "x"), (1, 2, "B", "x"), (2, 0, None, "x"), (1, 3, " ", "x")], "doc_id long, ordinal int, section string, text string")
    assert [tuple(r) for r in P.outline(chunks).collect()] == [(1, "- B\n- A")]
