import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions.html import measure
from threadloom.functions.ids import exact_instant, instant_text, positive_id, reference, shows_something, valid_timestamp
from threadloom.functions.scalars import bad_integer, elapsed_hours, label_number, optional_integer, split_tags, tag_names, word_count
from threadloom.functions.text import visible_text, words
from threadloom.operators.threads import requested

MARKUP = '<p>foo<b>bar</b> snake_case well-known</p><pre><code>a = 1\n\nb</code></pre><p>see <a href="">x</a> <a name="n">y</a><img src="z"><!-- hid --></p>'


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        (MARKUP, ("foo bar snake_case well-known a = 1 b see x y", 6, 8, 2, 1, 1)),
        ("<pre>a<i>b</i>c</pre>", ("a b c", 0, 0, 3, 0, 0)),
        ("<code>x<code>y</code></code>", ("x y", 0, 3, 0, 0, 0)),
        ("", ("", 0, 0, 0, 0, 0)),
        (None, ("", 0, 0, 0, 0, 0)),
        ("<p>a</b> c", ("a c", 2, 0, 0, 0, 0)),
        ("<script>x()</script>y", ("y", 1, 0, 0, 0, 0)),
    ],
)
def test_measures(source, expected):
    assert measure(source) == expected


def test_visible_text():
    assert visible_text("<p>a&amp;b<!-- x -->​ </p>\n") == "a&b"
    assert visible_text("<div><p>&#160;&#8203;</p></div>") == ""
    assert visible_text(None) == ""
    assert words("Größe snake_case I'm 4x") == ["größe", "snake", "case", "i", "m", "4x"]


@given(st.text(alphabet="aB1_-é“ \t'", max_size=30))
@settings(max_examples=200, deadline=None)
def test_words_agree_with_pattern(text):
    import re

    assert words(text) == re.findall(r"[^\W_]+", text.lower())


def test_parsing(spark):
    df = spark.createDataFrame([("7 ", "2024-01-01T00:00:00.12"), ("007", "2024-1-1"), ("x", "2024-02-30T00:00:00"), (None, "2024-01-01T00:00:00Z"), ("0", None), ("99999999999999999999", "2024-01-01T00:00:00.1234567")], "a string, t string")
    got = df.select(reference("a"), positive_id("a"), valid_timestamp("t")).collect()
    assert [r[0] for r in got] == ["7", "7", None, None, None, "99999999999999999999"]
    assert [r[1] for r in got] == [7, 7, None, None, None, None]
    assert [r[2] for r in got] == [dt.datetime(2024, 1, 1, 0, 0, 0, 120000), None, None, None, None, dt.datetime(2024, 1, 1, 0, 0, 0, 123456)]


def test_exact_order(spark):
    times = ["2024-01-01T00:00:00", "2024-01-01T00:00:00.12", "2024-01-01T00:00:00.120", "2024-01-01T00:00:00.1234568", "2024-01-01T00:00:00.1234567", "2024-01-01T00:00:01"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in reversed(times)], "t string").orderBy(exact_instant("t"), "t").collect()]
    assert got == [times[0], times[1], times[2], times[4], times[3], times[5]]
    text = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t string").select(instant_text("t")).collect()]
    assert text[1] == text[2] and text[4] < text[3] < text[5] and text[0] < text[1]


def test_shows_something_agrees(spark):
    bodies = [None, "", "<p> </p>", "<p>​</p>", "<div>&nbsp;&#8203;&#xA0;</div>", "<!-- a -->", "a", "<p>.</p>", "&amp;", " ", "<b>1</b>", "x < y", "\x1c"]
    got = [r[0] for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(shows_something("b")).collect()]
    assert got == [visible_text(b) != "" for b in bodies]


def test_numbers(spark):
    df = spark.createDataFrame([(" 5",), ("-3",), ("",), (None,), ("1_000",), ("x",)], "a string")
    assert [r[0] for r in df.select(optional_integer("a")).collect()] == [5, -3, None, None, None, None]
    assert [r[0] for r in df.select(bad_integer("a", negative_ok=False)).collect()] == [False, True, False, False, True, True]
    at = lambda ms: F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)).cast("timestamp_ntz")
    one = spark.range(1).select(elapsed_hours(at(63), at(0)), elapsed_hours(at(297), at(0)), elapsed_hours(at(0), at(1))).first()
    assert list(one) == [0.000017, 0.000082, None]
    assert [label_number(x) for x in (12345.6, 7.0, 2.25)] == ["12,346", "7", "2.2"]


def test_tags_and_words(spark):
    df = spark.createDataFrame([("<c#><.net>", "a; b ;;a"), ("", ""), (None, None)], "t string, s string")
    assert [r[0] for r in df.select(tag_names("t")).collect()] == [["c#", ".net"], [], []]
    assert [r[0] for r in df.select(split_tags("s")).collect()] == [["a", "b"], [], []]
    texts = [("foo-bar it's snake_case x",), ("½ é",), (None,)]
    assert [r[0] for r in spark.createDataFrame(texts, "t string").select(word_count("t")).collect()] == [3, 2, 0]


def test_requested():
    assert requested(["007", "7", "12"]) == ["7", "12"]
    for bad in (["0"], ["-1"], ["x"], []):
        with pytest.raises(ValueError):
            requested(bad)


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from threadloom.session import shared_folder

    session = lambda master, folder: SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=SimpleNamespace(master=master, getConf=dict))
    assert shared_folder(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_folder(session("local[4]", None)).startswith("file://")
    with pytest.raises(ValueError):
        shared_folder(session("local-cluster[3,2,1000]", None))
