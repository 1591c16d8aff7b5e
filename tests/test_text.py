import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import text as t


@pytest.mark.parametrize(
    "query, expected",
    [
        ("Über-Café: what's new?", "über_café_whats_new"),
        ("a - - b", "a_b"),
        ("x" * 60, "x" * 50),
        ("???", ""),
    ],
)
def test_slug(one, query, expected):
    assert one(query, t.slug) == expected


@pytest.mark.parametrize(
    "reply, expected",
    [
        ('{"key": "value", "list": [1, 2]}', {"key": "value", "list": [1, 2]}),
        ("This is not JSON{", {}),
        ('```json\n{"a": 1}\n```', {"a": 1}),
        ('```\n{"a": 1}```', {"a": 1}),
        ('{"a": [1, 2,], }', {"a": [1, 2]}),
        ('{"a": [{"b": 1} {"b": 2}]}', {"a": [{"b": 1}, {"b": 2}]}),
        ('{"a": {"b": 1}} and so on', {"a": {"b": 1}}),
        ('{"a": 1} {"b": 2}', {}),
        ('{"a": 1, "a": 2}', {"a": 2}),
        ("", {}),
        (None, {}),
    ],
)
def test_repair_json(one, reply, expected):
    assert json.loads(one(reply, lambda c: F.to_json(t.repair_json(c)))) == expected


def test_strip_takes_all_white_space(one):
    assert one("　\x1f\t x y \n\x85", t.strip) == "x y"


@given(st.text(alphabet="ab- \n\tÄ_", max_size=40))
@settings(max_examples=40, deadline=None)
def test_clean_extracted_text(spark, text):
    expected = re.sub(r"(\w+)-\s+(\w+)", r"\1\2", re.sub(r"\n\s*\n", "\n", re.sub(r"\s+", " ", text)))
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(t.clean_extracted_text(F.col("t"))).first()[0] == expected


def test_collapse_blank(one):
    assert one("  a\n\n\n\nb   c \n", t.collapse_blank) == "a\n\nb c"


def test_languages(one):
    assert one(".PY", t.language_of) == "python"
    assert one("go", t.language_of) == "go"


def test_code_metadata_and_imports(spark):
    body = "\n".join(f"  import m{i}" for i in range(12)) + "\nfrom x import y"
    files = spark.createDataFrame([("/a/b.py", body), ("/a/b.go", "import x"), ("/a/c.js", "x\nrequire('y')")], "path string, text string")
    rows = {r.filename: r for r in t.code_imports(t.code_metadata(files)).collect()}
    assert rows["b.py"].imports == [f"import m{i}" for i in range(10)]
    assert rows["b.py"].line_count == 13 and rows["b.py"].content_type == "code"
    assert rows["b.go"].imports is None and rows["b.go"].language == "go"
    assert rows["c.js"].imports == ["require('y')"]


def test_markdown_headings(spark):
    df = spark.createDataFrame([(1, "# Test Document\n\nThis is test content.\n### Deep  \nno # here")], "id int, text string")
    rows = [(r.pos, r.level, r.heading) for r in t.markdown_headings(df).collect()]
    assert rows == [(0, 1, "Test Document"), (1, 3, "Deep")]


def test_date_mentions(spark):
    df = spark.createDataFrame([(1, "On January 15, 2024 and May  3, 1999; not Foo 3, 1999. February 30, 2024")], "id int, text string")
    rows = [(r.mention, str(r.date)) for r in t.date_mentions(df).collect()]
    assert rows == [("January 15, 2024", "2024-01-15"), ("May  3, 1999", "1999-05-03"), ("February 30, 2024", "None")]


def test_ids_sizes_and_secrets(one):
    assert one("a" * 64, t.short_id) == "aaaaaaaa..."
    assert one("a" * 20, t.hit_id) == "a" * 20
    assert one("abcdefgh" + "-" * 20 + "stuvwxyz", t.hit_id) == "abcdefgh...stuvwxyz"
    assert one("x", lambda c: t.size_kb(F.lit(256))) == f"{256 / 1024:.1f} KB"
    assert one("x", lambda c: t.size_kb(F.lit(1536))) == "1.5 KB"
    assert one("abcd12345wxyz", t.mask_secret) == "abcd*****wxyz"
    assert one("abcdefgh", t.mask_secret) == "********"


def test_url_host(one):
    assert one("https://u:p@h.org:8080/x?y", t.url_host) == "u:p@h.org:8080"
    assert one("no url", t.url_host) == ""


def test_clip_and_cap(one):
    assert one("abcdef", lambda c: t.clip(c, 3)) == "abc..."
    assert one("abc", lambda c: t.clip(c, 3)) == "abc"
    assert len(one("q" * 700, t.cap_query)) == 500


def test_token_estimate(one):
    assert one("one two　three", t.token_estimate) == pytest.approx(3.9)
    assert one("", t.token_estimate) == 0


def test_white_space_is_pythons(spark):
    points = [*range(0x3100), 0xFEFF, 0x1F600]
    found = spark.createDataFrame([(chr(i),) for i in points], "c string").filter(F.col("c").rlike(f"(?U)^[{t.SPACE}]$"))
    assert {r.c for r in found.collect()} == {chr(i) for i in points if chr(i).isspace()} == set(t.WHITESPACE)
