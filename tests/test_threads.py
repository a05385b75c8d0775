"""One hand-made thread through XML, the characteristic table, its publication and the command line."""

import csv
import json
from xml.etree import ElementTree as ET

import pytest

from threadloom import cli
from threadloom.plans import characteristics
from threadloom.plans.columns import NAMES
from threadloom.plans.explore_table import convert, load, select_period
from threadloom.sources import files, xml

from conftest import rows_of

POSTS = """<?xml version="1.0" encoding="utf-8"?>
<posts>
  <row Id="1" PostTypeId="1" AcceptedAnswerId="3" CreationDate="2024-01-01T00:00:00.000" Score="2" Body="&lt;p&gt;a &amp;amp; b&lt;/p&gt;&#xA;" Title=" A " Tags="&lt;c#&gt;&lt;.net&gt;" AnswerCount="4" ViewCount="10" />
  <row Id="10" PostTypeId="2" ParentId="1" CreationDate="2024-01-01T01:30:00.12" Score="5" Body="x" />
  <row Id="2" PostTypeId="2" ParentId="1" CreationDate="2024-01-01T01:30:00.120" Body="y" OwnerUserId="" />
  <row Id="3" PostTypeId="2" ParentId="1" CreationDate="2024-01-01T03:00:00" Score="2" Body="&lt;b&gt;z&lt;/b&gt;" />
</posts>"""
COMMENTS = """<comments><row Id="5" PostId="1" Text="c1" CreationDate="2024-01-01T01:00:00" /><row Id="6" PostId="1" Text="c2" CreationDate="2024-01-01T01:30:00.120" /></comments>"""
VOTES = """<votes><row Id="1" PostId="3" VoteTypeId="1" CreationDate="2024-01-05T00:00:00.000" /><row Id="2" PostId="3" VoteTypeId="1" CreationDate="2024-01-03T00:00:00.000" /><row Id="3" PostId="3" VoteTypeId="2" CreationDate="2024-01-02T00:00:00.000" /></votes>"""


@pytest.fixture()
def dump(tmp_path):
    for name, text in (("Posts", POSTS), ("Comments", COMMENTS), ("Votes", VOTES)):
        (tmp_path / f"{name}.xml").write_text(text, encoding="utf-8")
    return tmp_path


def test_xml_sources(spark, dump):
    rows = {r["id"]: r for r in xml.read_rows(spark, str(dump / "Posts.xml"), xml.POSTS).collect()}
    assert rows["1"]["title"] == " A " and rows["1"]["body"] == "<p>a &amp; b</p>\n"
    assert rows["2"]["owner_user_id"] == "" and rows["10"]["owner_user_id"] is None
    every = xml.read_all_attributes(spark, str(dump / "Posts.xml")).orderBy("place").collect()
    assert [a["name"] for a in every[1]["attrs"]] == ["Id", "PostTypeId", "ParentId", "CreationDate", "Score", "Body"]
    picked = xml.read_all_attributes(spark, str(dump / "Posts.xml")).orderBy("place").select(xml.attribute("OwnerUserId")).collect()
    assert [r[0] for r in picked] == [None, None, "", None]


def _sources(spark, dump):
    return [xml.read_rows(spark, str(dump / f"{n}.xml"), a) for n, a in (("Posts", xml.POSTS), ("Comments", xml.COMMENTS), ("Votes", xml.VOTES))]


def test_characteristics(spark, dump):
    row = characteristics.build(*_sources(spark, dump), snapshot="2024-02-01", site="q.example", strict=True).first()
    assert list(row.asDict()) == NAMES
    expected = {
        "first_answer_id": "2", "available_answer_count": 3, "comments_before_first_answer": 1, "answer_score_spread": 3, "accepted_answer_score_rank": 2, "days_to_acceptance": 2, "time_to_eventually_accepted_answer_post_hours": 3.0, "observation_days_at_dump": 31, "question_tags": "c#;.net",
        "tag_count": 2, "question_url": "https://q.example/questions/1", "accepted_answer_url": "https://q.example/a/3", "accepted_answer_body_text": "z", "question_body_text": "a & b", "median_answer_response_hours": 1.500033, "has_stackexchange_answer": True, "available_question_comment_count": 2,
    }
    assert {k: row[k] for k in expected} == expected
    assert str(row["acceptance_date"]) == "2024-01-03"


def test_validation_and_issues(spark, dump, make):
    table = characteristics.build(*_sources(spark, dump), snapshot="2024-02-01", site="q.example")
    status = {r["check_name"]: r["status"] for r in characteristics.validation(table).collect()}
    assert len(status) == 10 and status["answers_differ"] == "WARN" and status["ids_present_and_unique"] == "PASS"
    double = {r["check_name"]: r["status"] for r in characteristics.validation(table.union(table)).collect()}
    assert double["ids_present_and_unique"] == "FAIL"
    assert characteristics.validation(table.where("false")).where("check_name = 'rows_produced'").first()["status"] == "FAIL"
    bad = make["posts"](dict(id="x", post_type_id="1", creation_date="2024-1-1", view_count="-1"))
    found = characteristics.issues(bad, make["comments"](), make["votes"]())
    assert {r["rule"] for r in found.collect()} == {"id", "creation_date", "view_count"}
    with pytest.raises(characteristics.DataIssues, match=r"questions row \(Id='x'\)"):
        characteristics.raise_issues(found)
    at = dict(post_type_id="1", creation_date="2024-01-02T00:00:00")
    early = make["posts"](
        dict(at, id="1", accepted_answer_id="5", last_edit_date="2024-01-01T00:00:00"), dict(at, id="2", accepted_answer_id="6", closed_date="2024-01-01T00:00:00"), dict(at, id="3"),
        dict(id="5", parent_id="1", post_type_id="2", creation_date="2024-01-01T00:00:00"), dict(id="6", parent_id="2", post_type_id="2", creation_date="2024-01-09T00:00:00"),
    )
    said = make["comments"](dict(id="7", post_id="3", creation_date="2024-01-01T23:59:59"), dict(id="8", post_id="5", creation_date="2023-01-01T00:00:00"))
    voted = make["votes"](dict(id="1", post_id="5", vote_type_id="1", creation_date="2024-01-01T00:00:00"), dict(id="2", post_id="6", vote_type_id="1", creation_date="2024-01-05T00:00:00"))
    got = {(r["source"], r["rule"], r["id"], r["context"]) for r in characteristics.issues(early, said, voted).collect()}
    assert got == {
        ("questions", "last_edit_date_before_question", "1", "Id='1'"), ("questions", "closed_date_before_question", "2", "Id='2'"), ("answers", "before_question", "5", "Id='5', ParentId='1'"), ("comments", "before_question", "7", "Id='7', PostId='3'"),
        ("acceptances", "before_question", "1", "Id='1'"), ("acceptances", "before_answer", "2", "Id='2'"),
    }
    assert characteristics.issues(*(t.where("false") for t in (early, said, voted))).count() == 0
    broken = {r["rule"]: r["rows"] for r in characteristics.invariants(table.union(table)).collect()}
    assert broken["repeated_id"] == 1 and broken["negative_count"] == 0


def test_build_command(spark, dump, tmp_path):
    out = tmp_path / "out"
    args = ["build", str(dump), str(out), "--site", "q.example", "--snapshot", "2024-02-01", "--start", "2024-01-01", "--end", "2024-01-08"]
    assert cli.main(args, spark) == 0
    raw = (out / "characteristics.tsv").read_bytes()
    assert raw.count(b"\r\n") == 2 and b"\tTRUE\t" in raw
    with open(out / "characteristics.tsv", newline="", encoding="utf-8") as f:
        rows = list(csv.DictReader(f, delimiter="\t"))
    assert rows[0]["question_body_html"] == "<p>a &amp; b</p>\n" and rows[0]["time_to_eventually_accepted_answer_post_hours"] == "3.0"
    assert json.loads((out / "run.json").read_text())["row_count"] == 1
    assert cli.main(args, spark) == 1  # exists
    assert cli.main([*args, "--overwrite"], spark) == 0
    assert cli.main([*args[:-1], "2023-01-01", "--overwrite"], spark) == 1
    loaded = load(convert(files.read_tsv(spark, str(out / "characteristics.tsv"))))
    assert loaded.rows_selected == 1 and loaded.analysis_end == "2024-01-01"
    with pytest.raises(ValueError):
        select_period(loaded.table, "year_range", start="2024-01-01")


def test_extract_commands(spark, dump, tmp_path):
    assert cli.main(["threads", str(dump), str(tmp_path / "t.xml"), "1"], spark) == 0
    q = ET.parse(tmp_path / "t.xml").getroot().find("thread/question")
    assert [a.get("Id") for a in q.find("answers")] == ["2", "10", "3"] and len(q.find("comments")) == 2
    source = {(r.get("PostTypeId"), r.get("Id")): r for r in ET.parse(dump / "Posts.xml").getroot()}
    for row in (q, *q.find("answers")):  # every attribute, empty ones too, in source order
        assert list(row.attrib.items()) == list(source[row.get("PostTypeId"), row.get("Id")].attrib.items())
    assert list(q.find("comments")[0].attrib) == ["Id", "PostId", "Text", "CreationDate"] and q.find("answers")[0].get("OwnerUserId") == ""
    assert cli.main(["summaries", str(dump), str(tmp_path / "s.xml"), "1"], spark) == 0
    r = ET.parse(tmp_path / "s.xml").getroot().find("request")
    assert r.find("first_answer_id").text == "2" and r.find("first_comment_text").text == "c1" and r.find("accepted_answer_body").text == "<b>z</b>"
    assert cli.main(["threads", str(dump), str(tmp_path / "u.xml"), "3"], spark) == 1  # an answer
    assert cli.main(["threads", str(dump), str(tmp_path / "u.xml"), "77"], spark) == 1
    assert cli.main(["threads", str(dump), str(dump / "Posts.xml"), "1", "--overwrite"], spark) == 1  # an input


def test_configuration(tmp_path):
    def fields(text):
        p = tmp_path / "f.tsv"
        p.write_text("field\tinclude\tsource_record\tsource_attribute\n" + text)
        return files.load_summary_fields(str(p))

    assert fields("question_title\t true\tquestion\tTitle\nquestion_id\tTRUE\tquestion\tId\n") == ["question_title", "question_id"]
    for bad in ("nothing\tTRUE\tquestion\tX\n", "question_id\tTRUE\tquestion\tId\n" * 2, "question_id\tTRUE\tquestion\tTitle\n", "question_id\tTRUE\tquestion\tid\n", "question_id\tmaybe\tquestion\tId\n", "question_id\tFALSE\tquestion\tId\n"):
        with pytest.raises(ValueError):
            fields(bad)
    p = tmp_path / "s.tsv"
    p.write_text("position\tcharacteristic\n1\ta\n3\tb\n")
    with pytest.raises(ValueError):
        files.load_schema(str(p))
    with pytest.raises(FileNotFoundError, match="Votes.xml"):
        files.required(str(tmp_path), ["Votes.xml"])


def test_publication(spark, tmp_path):
    from threadloom.sinks import publish, workbook

    df = spark.createDataFrame([(1, 'a\t"b"\n', 1e-6, True), (2, None, None, None)], "i int, t string, x double, f boolean")
    publish.write_tsv_distributed(df.coalesce(1), str(tmp_path / "parts"))
    part = next((tmp_path / "parts").glob("part-*")).read_bytes()
    assert part == b'1\t"a\t""b""\n"\t1e-06\tTRUE\r\n2\t\t\t\r\n'
    workbook.write_workbook(str(tmp_path / "w.xlsx"), {"a": (["x"], [[1], ["<&>"]])})
    assert (tmp_path / "w.xlsx").stat().st_size > 500
    one, two = spark.createDataFrame([(1,), (1,)], "a int"), spark.createDataFrame([(1,), (2,)], "a int")
    assert rows_of(workbook.drift(one, two)) == [(1, "first"), (2, "second")]
