"""Candidates of several sources, records of several types, sections as events, documents put together."""

import json
import random

from pyspark.sql import functions as F

from bidlens.functions import vocabulary as V
from bidlens.operators import assembly as A
from bidlens.operators import embedding as E
from bidlens.operators import links as L
from bidlens.operators import proposal as P
from bidlens.operators.sections import EVENTS, current_sections, section
from bidlens.plans.candidates import affordable, gathered_candidates, hits


def notices(spark, rows):
    return spark.createDataFrame(rows, "notice_id string, title string, naics string, posted string, via string")


def gathered(spark, keyed, cached, crawled, queries, broad, **how):
    how = {"naics": ["A"], "left": 9, "top_k": 1, "order": [F.desc("posted")]} | how
    crawled = notices(spark, crawled).withColumn("full_text", F.concat_ws(" ", "title", "via"))
    out = gathered_candidates(notices(spark, keyed), notices(spark, cached), crawled, queries, broad, **how)
    return {r.notice_id: r for r in out.collect()}


def test_the_first_source_wins(spark):
    same = lambda via: ("1", "Pump repair", "A", "2024-01-01", via)
    got = gathered(spark, [same("k")], [same("c"), ("2", "pump", "B", "2024-01-02", "c")], [same("w"), ("2", "pump", "B", "2024-01-02", "w"), ("3", "pump", "A", "2024-01-03", "w")], ["pump", "repair"], [])
    assert {i: (r.source, r.via, r.sources, r.matched) for i, r in got.items()} == {
        "1": ("live", "k", ["cache", "crawl", "live"], ["pump", "repair"]), "2": ("cache", "c", ["cache"], ["pump"]), "3": ("crawl", "w", ["crawl"], ["pump"]),
    }
    assert [tuple(got[i].arrival) for i in "123"] == [(0, 0, 1), (0, 1, 1), (0, 2, 1)]
    got = gathered(spark, [same("k")], [same("c")], [same("w")], ["pump"], [], left=0)  # nothing is left to spend
    assert got["1"].source == "cache" and got["1"].via == "c"


def test_budget_by_running_sums(spark):
    rows = affordable(spark, list("abcdef"), 4, live=5, costs=[1, 2, 1, 1, 0, 1]).orderBy("no").collect()
    assert [r.live for r in rows] == [True, True, True, False, False, False]
    assert [r.live for r in affordable(spark, list("abcd"), 9).orderBy("no").collect()] == [True, True, True, False]


def test_industries_are_given_up_by_query_and_thin_results_broadened(spark):
    crawl = [("1", "pump", "B", "2024-01-01", "w"), ("2", "valve", "A", "2024-01-01", "w"), ("3", "valve", "B", "2024-01-01", "w"), ("4", "motor", "B", "2024-01-01", "w")]
    got = gathered(spark, [], [], crawl, ["pump", "valve"], ["motor"], top_k=1)
    assert {i: r.source for i, r in got.items()} == {"1": "crawl", "2": "crawl"}  # two are enough for one
    got = gathered(spark, [], [], crawl, ["pump", "valve"], ["motor"], top_k=2)
    assert {i: r.source for i, r in got.items()} == {"1": "crawl", "2": "crawl", "4": "broadened"} and got["4"].matched == ["motor"]
    got = gathered(spark, [], [], crawl, ["pump", "valve"], [], top_k=9)  # without broad terms the first queries are widened
    assert {i: r.source for i, r in got.items()} == {"1": "crawl", "2": "crawl", "3": "broadened"} and got["2"].sources == ["broadened", "crawl"]
    assert gathered(spark, [], [], [], ["pump"], []) == {}


def test_hits_are_the_first_of_each_query(spark):
    rows = [(f"n{i:02d}", "Pump", "A", f"2024-01-{1 + i % 20:02d}", "w") for i in range(40)]
    q = spark.createDataFrame([(0, "pump"), (1, "PUMP  ")], "no int, query string")
    got = hits(notices(spark, rows), q, F.col("title"), [F.desc("posted")], 3).collect()
    assert sorted((r.no, r.place, r.notice_id) for r in got) == [(no, k, i) for no in (0, 1) for k, i in enumerate(["n19", "n39", "n18"], 1)]


def test_linked_records(spark):
    person = {"fullName": "A", "type": "Primary"}
    whole = {"data2": {"title": " T ", "type": "O", "solicitationNumber": 5, "naics": [{"type": "x", "code": "1"}, 4, {"type": "primary", "code": ["2"]}], "typeOfSetAside": "SBA", "solicitation": {"deadlines": {"response": "2024-02-01"}},
                       "pointOfContact": [{"fullName": "B"}, 5, {"fullName": 7}, None, [], person], "placeOfPerformance": {"city": {"code": "C"}, "state": "VA", "zip": 22101, "country": {"name": "USA"}}}, "description": [{"body": "<p>x</p>y"}], "postedDate": "2024-01-01"}
    rows = [("a", 200, json.dumps(whole)), ("b", 404, "{}"), ("c", 500, None), ("d", 200, "nope"), ("e", 200, '{"data2":{}}'), ("f", 200, "[1]"), ("g", None, json.dumps({"data2": {"type": 3, "pointOfContact": {"a": 1}, "naics": "x", "placeOfPerformance": []}, "description": "<b>z</b>"})),
            ("h", 200, json.dumps({"data2": {"a": 1}, "description": {"body": "q"}})), ("i", 200, '{"data2":[1]}'), ("j", 200, json.dumps({"data2": {"naics": [{"code": "9"}], "title": ""}, "description": [5]})), ("k", 200, None)]
    got = {r.notice_id: r for r in L.link_records(spark.createDataFrame(rows, "notice_id string, http int, raw string")).collect()}
    assert {i: r.status for i, r in got.items()} == {"a": "ok", "b": "not_found", "c": "http_error", "d": "not_json", "e": "empty", "f": "not_json", "g": "ok", "h": "ok", "i": "empty", "j": "ok", "k": "not_json"}
    a = got["a"]
    assert (a.title, a.number, a.type, a.naics, a.deadline, a.posted, a.description) == ("T", "5", V.NOTICE_TYPES["o"], "2", "2024-02-01", "2024-01-01", "x\n\ny")
    assert [c.fullName for c in a.contacts] == ["B", "A"] and a.contact.fullName == "A" and tuple(a.place) == ("C", "VA", "22101", "USA") and a.set_aside == V.SET_ASIDES["SBA"]
    assert [got[i].description for i in "ghj"] == ["z", "q", ""] and got["j"].naics == "9" and got["j"].title == "SAM.gov opportunity j" and got["g"].contacts == [] and got["b"].contacts is None


def test_listed_files(spark):
    rows = [("a", json.dumps({"_embedded": {"opportunityAttachmentList": [{"attachments": [{"type": "link", "uri": "http://u"}, {"resourceId": "R1", "name": "f.pdf"}, 3, {"id": 9}, {"name": "no"}, {"type": "link", "id": "L"}], "resourceLinks": ["http://x/z.pdf", 4]}, None, 7]}})),
            ("b", json.dumps({"_embedded": {"opportunityAttachmentList": {"attachments": [{"id": "Q"}]}}})), ("c", "zz"), ("d", None), ("e", '{"_embedded": 5}')]
    got = [tuple(r) for r in L.attachments(spark.createDataFrame(rows, "notice_id string, raw string")).orderBy("notice_id", "position").collect()]
    url = L.DOWNLOAD_URL.format
    assert got == [("a", 0, "http://u", "http://u"), ("a", 1, url("R1"), "f.pdf"), ("a", 2, url("9"), None), ("a", 3, url("L"), None), ("a", 4, "http://x/z.pdf", None), ("b", 0, url("Q"), None)]


def test_sections_like_a_list(spark):
    """Events against a plain list in which sections are replaced or appended."""
    r, events, want = random.Random(6), [], {}
    for seq in range(300):
        d, s = f"d{r.randrange(4)}", f"s{r.randrange(5)}"
        title, content, feedback = (f"{n}{seq}" if r.random() < p else None for n, p in (("t", 0.4), ("c", 0.6), ("f", 0.3)))
        events.append((d, seq, s, title, content, feedback))
        own = next((x for x in want.setdefault(d, []) if x[0] == s), None)
        if own is None:
            want[d].append(own := [s, None, None, [], 0])
        own[1], own[2], own[4] = title or own[1], content or own[2], own[4] + bool(content)
        own[3] += [feedback] if feedback else []
    df = spark.createDataFrame([*events, ("d0", 999, None, "x", "y", "z")], EVENTS).repartition(5)
    got = {}
    for x in current_sections(df).orderBy("draft_id", "place").collect():
        got.setdefault(x.draft_id, []).append([x.section_id, x.title, x.content, x.feedback, x.revisions])
    assert got == want and section(current_sections(df), "s1").count() == sum(any(x[0] == "s1" for x in v) for v in want.values())


def test_volumes(spark):
    n = spark.createDataFrame([("1", "Pumps", "", "", "Office", "Acme Corp\nTab 1 One\nTab 2 Two\nTab 2 Two\nAppendix 3 Three"), ("2", "", "N-2", None, None, None)], "notice_id string, title string, number string, agency string, office string, template string")
    s = spark.createDataFrame([("1", "2", 2, "B", " b "), ("1", "2", 1, "A", "a"), ("1", "7", 1, "Else", "e"), ("2", "5", 1, "Past", "p")], "document string, tab string, place int, title string, content string")
    got = {r.document: r.text for r in A.assembled(A.front_blocks(n).unionByName(A.tab_blocks(n, s))).collect()}
    one, two = got["1"], got["2"]
    assert one.startswith("Acme Corp\n\nTitle Page") and "To: Office\nSubj: Pumps\nRef: 1\n" in one and "Tab 1 One\nTab 2 Two\n\nAppendix 3 Three" in one
    assert one.endswith("# Tab 1 One\n\n# Tab 2 Two\n\n## A\n\na\n\n## B\n\nb\n\n## Else\n\ne\n\n# Appendix 3 Three")
    assert two.startswith("The Offeror\n") and "To: Contracting Officer\nSubj: Technical Proposal\nRef: N-2\n" in two and two.index("# Tab 5 Past Performance\n\n## Past\n\np") < two.index("# Tab 6 Appendices") < two.index("# Appendix 11")


def test_contexts_within_a_budget_by_brute_force(spark):
    r = random.Random(9)
    rows = [(no, r.choice(A._ORIGINS), f"l{i}", "x" * r.randrange(0, 60), r.randrange(5)) for no in range(4) for i in range(12)]
    df = spark.createDataFrame(rows, "no int, origin string, label string, snippet string, rank int")
    kept = {(x.no, x.label) for x in A.within_budget(df, 150).collect()}
    texts = {x.no: x.context for x in A.contexts(spark.range(6).select(F.col("id").cast("int").alias("no")), df, 150).collect()}
    for no in range(4):
        own, total, want = sorted((A._ORIGINS.index(o), rank, label, s) for n, o, label, s, rank in rows if n == no), 0, []
        for o, _, label, s in own:
            total += len(label) + len(s)
            if total > 150:
                break
            want.append((o, label, s))
        assert kept & {(no, x[2]) for x in own} == {(no, x[1]) for x in want}
        parts = [A._HEADS[o] + "\n\n" + "\n\n".join(f"[{label}]\n{s}" for k, label, s in want if k == o) for o in range(3) if any(x[0] == o for x in want)]
        assert texts[no] == "\n\n".join(parts)
    assert texts[4] == texts[5] == A.NOTHING


def test_exemplars_of_categories_and_the_template(spark):
    """Style comes from a section's categories, and from the template where a search of all finds it; without hits there, from all."""
    backend = E.Hashed(512)
    texts = [(1, "Past", "repair of generators and exciters"), (2, "Technical", "repair of generators in plants"), (3, "Past", "asphalt paving of roads"), (9, "Forms", "repair of generators and exciters on forms")]
    df = spark.createDataFrame(texts, "doc_id long, category string, text string").withColumns({"chunk_no": F.col("doc_id") * 10, "citation": F.concat(F.lit("d"), "doc_id"), "section": F.lit(None).cast("string")})
    vectors = backend.embed(df, "chunk_no", "text").select(F.col("id").alias("v_no"), "v")
    library = df.join(vectors, df["chunk_no"] == vectors["v_no"]).drop("v_no")
    none = P.solicitation_index(spark.createDataFrame([], "doc_id long, name string, text string"), backend)
    style = lambda template, *categories: {r.label for r in P.gathered([P.Section("a", "A", "repair generators exciters", style=3, facts=0, categories=categories)], none, library, backend, template=template).collect() if r.origin == "style_exemplar"}
    assert style(None, "Past") == {"KB style: d1", "KB style: d3"} and style(9, "Past") == {"KB style: d1", "KB style: d3", "KB style: d9"}
    assert style(None, "Nothing") == {"KB style: d1", "KB style: d2", "KB style: d9"} and len(style(9)) == 3


def test_matrices_are_mapped_anew_and_keep_notes(spark):
    backend = E.Hashed(512)
    items = spark.createDataFrame([(1, "The contractor shall repair generators.", "SOW (shall)", "S", "ask | them")], "item int, requirement string, category string, source string, notes string")
    sections = lambda *rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "no long, title string, content string")
    before = P.placed(items, sections(("Roads", "asphalt"), ("Power", "nothing yet")), backend).first()
    matrix = P.placed(items, sections(("Roads", "The contractor shall repair generators."), ("Power", "nothing yet")), backend)
    after = P.placed(matrix, sections(("Roads", "asphalt"), ("Power", "The contractor shall repair generators.")), backend).first()
    assert before.status == "Not Addressed" and (matrix.first().section_title, after.section_title) == ("Roads", "Power") and after.status == "Addressed" and after.notes == "ask | them"
    text = P.matrix_markdown(matrix).first().markdown
    assert "| Notes |" in text and "| ask \\| them |" in text
