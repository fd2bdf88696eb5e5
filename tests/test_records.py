"""Records, files and references on values that the tables do not have."""

from pyspark.sql import functions as F

from bidlens.operators import records as R

from .test_functions import values


def test_awardees(spark):
    rows = ['{"awardee": {"name": " A ", "ueiSAM": "U1", "uei": "U2"}}', '{"awardee": {"name": "B", "uei": "U2"}}', '{"awardee": "C"}', '{"awardee": "C", "awardee_name": "D", "awardee_uei": "U3"}', "{}", "no json", None]
    assert [(r.name, r.uei) for r in values(spark, rows, R.awardee)] == [("A", "U1"), ("B", "U2"), ("C", None), ("D", "U3"), (None, None), (None, None), (None, None)]


def test_hierarchies(spark):
    kind = "array<struct<level:int,name:string>>"
    assert values(spark, [[(2, "B"), (1, " A "), (3, "")], [], None, [(None, "Z"), (1, "A")], [(1, " ")]], R.hierarchy_path, kind) == ["A.B", None, None, "Z.A", None]


def test_search_notices(spark):
    raw = ['{"_id": "1", "title": "T", "type": {"value": "V"}, "naics": [{"code": ["9"], "type": "x"}, {"code": ["8"], "type": "primary"}], "typeOfSetAside": "ZZ", "publishDate": "2026-01-01"}', '{"id": 2, "type": {"code": "R"}, "naicsCode": "7"}', '{"title": "none"}', "x"]
    got = {r.notice_id: r for r in R.search_notices(spark.createDataFrame([(x,) for x in raw], "raw string"), "raw").collect()}
    assert set(got) == {"1", "2"} and got["1"].naics == "8" and got["1"].type == "V" and got["1"].set_aside == "ZZ" and got["1"].posted == "2026-01-01"
    assert got["2"].type == "Sources Sought" and got["2"].title == "SAM.gov opportunity 2" and got["2"].naics == "7" and got["2"].url == "https://sam.gov/opp/2/view"


def test_descriptions_and_replies(spark):
    rows = ['[{"body": "<p>a</p>b"}]', '{"body": "&amp;"}', "<b>x</b>", "", None, "[]", "y" * 50_000]
    got = values(spark, rows, R.description)
    assert got[:6] == ["a\n\nb", "&", "x", "", "", ""] and len(got[6]) == 40_000
    assert values(spark, ['{"a": 1}', 'so: {"a": {"b": 2}} ok', "{no", None, "", "} {"], R.json_object) == ['{"a": 1}', '{"a": {"b": 2}}', None, None, None, None]
    assert values(spark, ['{"message": "m", "error": {"code": "c"}}', '{"description": "d"}', " plain ", '{"x": 1}'], R.error_detail) == ["c", "d", "plain", '{"x": 1}']


def test_names_and_lists(spark):
    headers = ['attachment; filename="a b.pdf"', "attachment; filename*=UTF-8''x.doc", "inline", None]
    assert values(spark, headers, lambda c: R.file_name(c, F.lit("f"))) == ["a b.pdf", "x.doc", "f", "f"]
    assert values(spark, ["a, b,,c ", "", None], R.comma_list) == [["a", "b", "c"], [], []]
    assert values(spark, ["a b/c.pdf"], lambda c: R.stored_name(F.lit("u"), c))[0].endswith("__a_b_c.pdf")
    made = values(spark, ["", None, "sam.gov/opp/ab1/view", "two words"], lambda c: R.manual_notice(c, F.lit(None).cast("string"), F.lit("dir/my.plan.docx"), F.lit("7")))
    assert [(r.notice_id, r.title, r.error) for r in made] == [("MANUAL-7", "my.plan", None), ("MANUAL-7", "my.plan", None), ("ab1", "my.plan", None), (None, None, "not_an_id")]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in {"a.txt": b" hello \xff ", "b.pdf": b"%PDF", "c.exe": b"x", "d.md": b"  ", "e.html": b"z" * 30_000, "noext": b"q"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in R.extracted_files(spark, str(tmp_path / "in")).collect()}
    assert {n: r.status for n, r in got.items()} == {"a.txt": "ok", "b.pdf": "plug_in", "c.exe": "unsupported", "d.md": "empty", "e.html": "ok", "noext": "unsupported"}
    assert got["a.txt"].text == "hello �" and got["e.html"].truncated and len(got["e.html"].text) == 20_000 and not got["a.txt"].truncated
    rows = spark.createDataFrame([(1, 'a "q", b\nc'), (2, None)], "i int, t string")
    R.exported(rows, str(tmp_path / "csv"))
    back = spark.read.option("escape", '"').option("multiLine", True).schema("i int, t string").csv(str(tmp_path / "csv"), header=True)
    assert sorted(map(tuple, back.collect())) == [(1, 'a "q", b\nc'), (2, None)]
