"""What people are shown, against plain Python versions."""

import hashlib
import json
import random
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bidlens.functions import normalize as N
from bidlens.operators import knowledge as K
from bidlens.operators import presented as P
from bidlens.operators import pricing
from bidlens.operators.search import Filters


def test_cache_keys_of_any_characters(spark):
    params = [{"q": "a", "naics": "1"}, {"q": 'é"\\ \n\t\x00\x7f', "z": "日本"}, {"ü": "😀 x", "b": ""}, {"api_key": "s", "Token": "t", "n": None}, {}, {"q": "\b\f\r "}]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(params)], "i int, p map<string,string>")
    got = {r.i: r.k for r in df.select("i", N.cache_key(F.lit("/a/é"), F.col("p")).alias("k")).collect()}
    for i, p in enumerate(params):
        own = {k: v for k, v in p.items() if v is not None and k.lower() not in ("api_key", "token", "key", "apikey")}
        assert got[i] == hashlib.sha256(json.dumps({"endpoint": "/a/é", "params": own}, sort_keys=True, separators=(",", ":")).encode()).hexdigest(), p


def test_links_and_redaction(spark):
    raws = [None, " ", "https://x/opp/Ab1/view", "http://x/other", "0123456789abcdef", "0123456789abcde", "0123456789abcdef!", "see /opp/Z9"]
    got = [tuple(r.r) for r in spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").orderBy("i").select(N.linked_notice(F.col("raw")).alias("r")).collect()]
    assert got == [(None, "empty"), (None, "empty"), ("Ab1", None), (None, "not_a_link"), ("0123456789abcdef", None), (None, "not_a_link"), (None, "not_a_link"), ("Z9", None)]
    line = spark.range(1).select(N.redacted(F.lit("a?Api_Key=1&x=2 token=zz hunter2"), ("hunter2", "")).alias("l")).first().l
    assert line == "a?Api_Key=***&x=2 token=*** ***"


def brute_rebuilt(texts):
    out = texts[0]
    for nxt in texts[1:]:
        k = next((k for k in range(min(len(out), len(nxt), 1500), 24, -1) if out[-k:] == nxt[:k]), 0)
        out += "\n\n" + nxt[k:]
    return out


def test_rebuilt_like_brute_force(spark):
    r = random.Random(11)
    rows, want = [], {}
    for doc in range(40):
        text = "".join(r.choice("ab \n") for _ in range(r.choice([60, 300, 4000])))
        cuts, at = [], 0
        while at < len(text):
            size = r.choice([30, 120, 1800])
            cuts.append(text[at : at + size])
            at += max(1, size - r.choice([0, 10, 26, 29, 100]))
        if doc % 3 == 0:  # a short chunk in the middle, after which all before it counts
            cuts = [text[:50], text[40:70], text[20:]]
        want[doc] = brute_rebuilt(cuts)
        rows += [(doc, i, t) for i, t in enumerate(cuts)]
    got = {x.doc_id: x.text for x in K.rebuilt(spark.createDataFrame(rows, "doc_id int, ordinal int, text string").repartition(3)).collect()}
    assert got == want


@pytest.mark.parametrize("amounts", [[1.0, 2.5, 100.0, 1e6, 77.7, 50.0], [5.5, 5.5], [-10.0, 0.0, 1234567.0], [3.0], []])
def test_histogram_labels_like_pandas(spark, amounts):
    df = spark.createDataFrame([(a,) for a in amounts] + [(None,)], "amount double")
    got = [(r.label, r.n) for r in P.histogram_labels(pricing.price_histogram(df)).orderBy("bin").collect()]
    if not amounts:
        want = []
    elif min(amounts) == max(amounts):
        want = [(f"${min(amounts):,.0f}", len(amounts))]
    else:
        counts = pd.cut(pd.Series(amounts), bins=8).value_counts().sort_index()
        want = [(f"${int(i.left):,}–${int(i.right):,}", n) for i, n in counts.items()]
    assert got == want


def test_rows_letters_and_blocks(spark):
    n = spark.createDataFrame([("1", "", None, "Dept.Sub.Office", None, None, "o", None, None, None), ("2", "Pumps", "N-2", None, "SBA", "541", "zz", date(2024, 3, 5), "B. Roe", "b@x")], "notice_id string, title string, number string, path string, set_aside string, naics string, type string, deadline date, contact_name string, contact_email string")
    rows = {r["Notice ID"]: r for r in P.table_rows(n, F.lit("2024-03-01 12:00:00").cast("timestamp")).collect()}
    assert list(rows["1"].asDict()) == ["Title", "Agency", "Office", "Type", "Set-Aside", "NAICS", "Response Deadline", "Days Left", "Notice ID", "Link"]
    assert (rows["1"].Title, rows["1"].Agency, rows["1"].Office, rows["1"]["Days Left"], rows["1"].NAICS) == ("(untitled)", "Dept", "Office", None, "")
    assert (rows["2"].Type, rows["2"]["Response Deadline"], rows["2"]["Days Left"]) == ("zz", "2024-03-05 00:00", 3) and rows["2"].Link.endswith("/2/view")
    profile = {"company": "Acme", "sender": "A", "sender_title": "T", "email": "e", "phone": "p", "capabilities": "pumps"}
    letters = {r.notice_id: r for r in P.letters(n, profile).collect()}
    one, two = letters["1"], letters["2"]
    assert one.body.startswith("Dear Contracting Officer,") and '"1" (1) posted by Dept.' in one.body and one.to_name is None and len(one.sources) == 1 and "deadline of" not in one.body
    assert two.subject == "Question regarding Pumps (N-2)" and two.to_email == "b@x" and "posted by your agency (NAICS 541)." in two.body and "March 05, 2024" in two.body and len(two.sources) == 4 and "{" not in two.body
    blocks = {r.notice_id: r.block.split("\n") for r in P.notice_block(n).collect()}
    assert blocks["1"][1] == "Title: N/A" and blocks["1"][6] == "Set-aside: None" and blocks["2"][4] == "Agency: N/A / Office: N/A" and blocks["2"][7] == "Response deadline: 2024-03-05"
    lines = {r.notice_id: r.t for r in n.select("notice_id", P.notice_text(F.col("title"), F.col("naics"), F.lit("R1"), F.lit(None).cast("string"), F.col("path")).alias("t")).collect()}
    assert lines == {"1": "R1 Office Dept", "2": "Pumps 541 R1"}


def test_lists_and_citations(spark):
    n = spark.createDataFrame([("1", "Pumps"), ("2", "")], "notice_id string, title string")
    items = spark.createDataFrame([("1", 1, "B", "d2", None, "s2"), ("1", 0, "A", "d1", "2024-01-01", "s1")], "notice_id string, position int, action string, detail string, due string, source string")
    got = {r.notice_id: r.markdown for r in P.checklist_markdown(items, n).collect()}
    assert got["1"].split("\n")[0] == "# Action checklist — Pumps" and got["1"].split("\n")[5:] == ["- [ ] **A** (due 2024-01-01)", "  - d1", "  - _source: s1_", "- [ ] **B**", "  - d2", "  - _source: s2_"]
    assert got["2"].startswith("# Action checklist — 2\n\n- Notice ID: 2\n")
    cite = spark.range(1).select(P.citation(F.lit("a.pdf"), F.lit(2), F.lit("Scope")).alias("x"), P.citation(F.lit("a.pdf"), F.lit(0), F.lit("")).alias("y")).first()
    assert tuple(cite) == ("a.pdf #3 · Scope", "a.pdf #1")


def test_filters_as_parameters():
    f = Filters(keyword="pump", naics=("1", " 2 "), types=("o",), department="Navy", posted_from=date(2024, 1, 2), posted_to=date(2024, 3, 4), limit=10, offset=20)
    assert f.parameters() == {"limit": "10", "offset": "20", "postedFrom": "01/02/2024", "postedTo": "03/04/2024", "title": "pump", "deptname": "Navy", "ncode": "1,2", "ptype": "o"}
    assert Filters().parameters() == {"limit": "25", "offset": "0"}
