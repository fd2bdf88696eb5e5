"""Column functions on values that the tables do not have."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from bidlens.functions import normalize as N
from bidlens.functions import text as T


def values(spark, rows, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(rows)), f"i int, x {kind}").withColumn("y", f(F.col("x")))
    return [r.y for r in df.orderBy("i").collect()]


def test_currency(spark):
    got = values(spark, ["$1,234.56", " 12 ", "", "TBD", "(500)", "1_000", "1.0d", "nan", "-5", None, ".", "1__0", "2e3", "-inf"], N.currency)
    assert math.isnan(got.pop(7))
    assert got == [1234.56, 12.0, None, None, None, 1000.0, None, -5.0, None, None, None, 2000.0, -math.inf]


def test_dates(spark):
    got = values(spark, ["2026-06-01", "06/01/2026", "6/1/2026", "2026-06-01T10:00:00Z", "2026-06-01T10:00:00.125+00:00", "2026-06-01T10:00:00-0400", "2026-06-01 07:08:09", "null", "soon", "", None, "13/40/2026"], N.moment)
    day = datetime(2026, 6, 1)
    assert got == [day, day, day, datetime(2026, 6, 1, 10), datetime(2026, 6, 1, 10, 0, 0, 125000), datetime(2026, 6, 1, 14), datetime(2026, 6, 1, 7, 8, 9), None, None, None, None, None]


def test_days_left_are_floored(spark):
    as_of = F.lit("2026-06-01 12:00:00").cast("timestamp")
    got = values(spark, ["2026-06-01 11:00:00", "2026-06-01 13:00:00", "2026-06-02 13:00:00", None], lambda c: N.days_left(c.cast("timestamp"), as_of))
    assert got == [-1, 0, 1, None]
    keys = values(spark, [10, 2, -1, None], N.deadline_key, "long")
    assert sorted(range(4), key=lambda i: keys[i]) == [1, 0, 2, 3]


def test_paths(spark):
    paths = ["U.S. ARMY.ACC", "SOLO", None, "", "A..B", " X . Y "]
    assert values(spark, paths, N.agency) == ["U", "SOLO", None, None, "A", "X"]
    assert values(spark, paths, N.office) == ["ACC", "SOLO", None, None, "B", "Y"]


def test_references(spark):
    got = values(spark, ["https://sam.gov/opp/abc123/view?x", " abc123 ", "", None, "https://sam.gov/search", "two words", "a/b"], N.notice_reference)
    assert [(r.notice_id, r.error) for r in got] == [("abc123", None), ("abc123", None), (None, "empty"), (None, "empty"), (None, "no_id_in_link"), (None, "not_an_id"), (None, "not_an_id")]


def test_doc_types(spark):
    kind = lambda c: T.doc_type(F.lit("a.txt"), F.lit("Technical"), c)
    assert values(spark, ["corporate", "Our RESUME", "x " * 800 + "resume", None, "the pws", "section l"], kind) == ["Pricing", "Resume", "Technical Document", "Technical Document", "Statement of Work", "Proposal"]


def test_requirements(spark):
    text = "The Contractor shall do it. It is fine.\nOfferors must  submit\ttwo volumes. see e.g. what must come"
    assert values(spark, [text, None, ""], T.requirement_sentences) == [["The Contractor shall do it.", "Offerors must submit two volumes."], None, []]
    assert values(spark, ["per Section L", "basis for award", "evaluated", "must", "may"], T.requirement_category) == ["Section L", "Section M", "Evaluation", "SOW (shall)", "Other"]


def test_html(spark):
    got = values(spark, ["<p>A&nbsp;b</p><ul><li>x</li><li class=y>z &amp;lt; q</ul>&lt;b&gt;<br/>end", "", "a</P >\n\n\n<br>b"], T.html_text)
    assert got == ["A b\n\n• x\n• z &lt; q<b>\nend", "", "a\n\nb"]


def test_entities(spark):
    import html

    rows = ["&amp;lt; &#65;&#x42; &#0; &#xD800; &#1114112; &#128; &euro;&CounterClockwiseContourIntegral;", "&nosuch; &copy 1 &notin; &#99999999999999999999; &", "a&&b&;", "&#x41 &#66z", "", None, "&NotEqualTilde; &Eacute;t&eacute;"]
    assert values(spark, rows, T.resolved) == [html.unescape(x) if x is not None else None for x in rows]


def test_prose(spark):
    text = "# Title\n**bold** and *it* and snake_case_name [KB #1]\n\n\n\nmore  \nend\n\n**Sources**: a\nb"
    assert values(spark, [text], T.plain_prose) == ["Title\nbold and it and snakecasename [KB 1]\n\nmore\nend"]
    assert values(spark, [text, None], lambda c: T.plain_prose(c, export=True)) == ["Title\nbold and it and snakecasename\n\nmore\nend", ""]


def test_headings_and_lines(spark):
    rows = ["# A b", "1.2. Scope of work", "SYSTEM DESCRIPTION", "Past Performance", "this is not one", "Ends here.", "ab", "IV. Team:", "a\nb"]
    assert values(spark, rows, T.is_heading) == [True, True, True, True, False, False, False, True, False]
    assert values(spark, [*rows[:2], "IV. Team:", "## " + "x" * 100, "#:", "A :: "], T.heading_label) == ["A b", "Scope of work", "Team", "x" * 90, "", "A"]
    got = values(spark, ["Tab 1 Summary\ntab 2  Data \nTab 1 Summary\nTable 3 x"], lambda c: T.titled_lines(c, "Tab"))
    assert [(r.number, r.title) for r in got[0]] == [("1", "Summary"), ("2", "Data")]
    assert values(spark, ["Volume 1 Inc\n\nAcme Power, LLC\nx", "none", None], T.company_line) == ["Acme Power, LLC", "The Offeror", "The Offeror"]


def test_windows_and_summaries(spark):
    assert values(spark, ["abcdefgh", "", "abc"], lambda c: T.char_windows(c, 4, 1)) == [["abcd", "defg", "gh"], [], ["abc"]]
    first = "This sentence has more than forty characters in it. Second one. "
    got = values(spark, ["short\n\n" + first + "Third " * 80 + ".", "tiny", None], T.summary)
    assert got == [first.strip(), "tiny", ""]
    assert values(spark, ["a\r\n\r\n\r\n\r\nb  \n c "], T.normalized_lines) == ["a\n\nb\n c"]
    assert values(spark, ["a  b\n" + "c" * 400], T.snippet)[0].endswith("…")


def test_keys_and_labels(spark):
    params = spark.createDataFrame([({"b": 'x"y', "a": "1", "API_KEY": "s", "n": None},)], "p map<string,string>")
    import hashlib
    import json

    want = hashlib.sha256(json.dumps({"endpoint": "/e", "params": {"a": "1", "b": 'x"y'}}, separators=(",", ":")).encode()).hexdigest()
    assert params.select(N.cache_key(F.lit("/e"), F.col("p"))).first()[0] == want
    fresh = spark.createDataFrame([(-1,), (0,), (10,), (9,)], "ttl int").select(N.is_fresh(F.lit(100), F.col("ttl"), F.lit(109))).collect()
    assert [r[0] for r in fresh] == [True, False, True, False]
    assert values(spark, [5, 300, 7200, 200000], N.age_label, "long") == ["just now", "5m ago", "2h ago", "2d ago"]
    assert values(spark, ["SBA", "ZZ", None], N.set_aside_label) == ["Total Small Business Set-Aside", "ZZ", None]
