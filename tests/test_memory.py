import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from marginalia.operators import memory as m
from marginalia.operators.numbering import number_rows


def rows(spark, *entries):
    start = dt.datetime(2024, 1, 1)
    data = [(start + dt.timedelta(seconds=i), {k: str(v) for k, v in e.items()}) for i, e in enumerate(entries)]
    return spark.createDataFrame(data, "timestamp timestamp, entry map<string,string>")


@pytest.fixture
def talk(spark):
    return m.append_memory(
        "conversation",
        rows(
            spark,
            {"session_id": "kitchen", "role": "user", "content": "one lamp"},
            {"session_id": "kitchen", "role": "assistant", "content": "which one"},
            {"session_id": "cellar", "role": "user", "content": "two lamps"},
        ),
    )


def test_search(talk):
    assert m.search_memory("conversation", talk, "one").count() == 2
    assert m.search_memory("conversation", talk, filters={"session_id": "kitchen"}).count() == 2
    (row,) = m.search_memory("conversation", talk, filters={"role": "assistant", "unknown": 1}).collect()
    assert row.content == "which one"
    assert [r.id for r in m.search_memory("conversation", talk, "", limit=2).collect()] == [3, 2]
    with pytest.raises(ValueError):
        m.search_memory("conversation", talk, filters={"url": "x"})


@pytest.mark.parametrize(
    "query, found",
    [("über", 0), ("Über", 1), ("ÜBER", 1), ("ÜBEr", 1), ("a_c", 2), ("a%c", 2), ("a\\c", 1), ("A\\C", 1), ("xyz", 0)],
)
def test_like_folds_ascii_only(spark, query, found):
    table = m.append_memory("fact", rows(spark, {"fact": "Über"}, {"fact": "abc"}, {"fact": "a\\c"}))
    assert m.search_memory("fact", table, query).count() == found


def test_defaults_and_metadata(spark):
    talk = m.append_memory("conversation", rows(spark, {"mood": "good"})).first()
    assert (talk.session_id, talk.role, talk.content, talk.metadata) == ("default", "unknown", "", {"mood": "good"})
    fact = m.append_memory("fact", rows(spark, {"fact": "lamps need oil", "source": "almanac", "confidence": 0.9}, {}))
    assert [(r.fact, r.source, r.confidence) for r in fact.orderBy("id").collect()] == [("lamps need oil", "almanac", 0.9), ("", "", 1.0)]
    page = m.append_memory("document", rows(spark, {"content": "how to fill a lamp", "url": "https://lamps.example"})).first()
    assert (page.title, page.content, page.url, page.metadata) == ("Untitled", "how to fill a lamp", "https://lamps.example", {})
    for kind in m.DEFAULTS:
        assert m.append_memory(kind, rows(spark, {})).schema.names == m.memory_schema(kind).names
    with pytest.raises(ValueError):
        m.append_memory("poem", rows(spark, {}))


def test_ids_go_on(spark, talk):
    more = m.append_memory("conversation", rows(spark, {"content": "x"}, {"content": "y"}), talk)
    assert [(r.id, r.content) for r in more.orderBy("id").collect()] == [(4, "x"), (5, "y")]


def test_read_and_delete(spark, talk):
    assert [r.content for r in m.read_memory("conversation", talk, [1]).collect()] == ["one lamp"]
    assert m.read_memory("conversation", talk, [9999]).count() == 0
    assert m.read_memory("conversation", talk, []).count() == 0
    rest, gone = m.delete_memory("conversation", talk, spark.createDataFrame([(1,), (9999,)], "id bigint"))
    assert gone == 1 and sorted(r.id for r in rest.collect()) == [2, 3]
    _, gone = m.delete_memory("conversation", rest, spark.createDataFrame([(1,)], "id bigint"))
    assert gone == 0


def test_stored_memory(spark, tmp_path):
    """New rows are appended, deletions are a table of ids, and numbers are never given twice."""
    path = str(tmp_path / "conversation")
    assert m.load_memory(spark, "conversation", path).count() == 0
    m.store_memory("conversation", rows(spark, {"content": "a"}, {"content": "b"}), path)
    before = {f: (tmp_path / "conversation/rows" / f).stat().st_mtime_ns for f in os.listdir(f"{path}/rows") if f.endswith("parquet")}
    ids = spark.createDataFrame([(2,), (2,), (9,)], "id bigint")
    assert m.forget_memory("conversation", path, ids) == 1 and m.forget_memory("conversation", path, ids) == 0
    m.store_memory("conversation", rows(spark, {"content": "c"}), path)
    assert [(r.id, r.content) for r in m.load_memory(spark, "conversation", path).orderBy("id").collect()] == [(1, "a"), (3, "c")]
    assert all((tmp_path / "conversation/rows" / f).stat().st_mtime_ns == t for f, t in before.items())


def test_history(spark):
    said = [("user", "Is it dark?"), ("assistant", "Not yet."), ("user", "And now?")]
    table = m.append_memory("conversation", rows(spark, *[{"session_id": "s", "role": r, "content": c} for r, c in said], {"session_id": "t"}))
    asked = spark.createDataFrame([("s",)], "session_id string")

    def listed(**how):
        return [(r.role, r.content) for r in m.conversation_history(table, asked, **how).orderBy("n").collect()]

    assert listed() == said
    assert listed(limit=2) == said[:2]
    assert listed(limit=2, latest=True) == said[1:]


def test_build_messages(spark, talk):
    prompts = spark.createDataFrame(
        [(1, "kitchen", "Be kind.", "Next?"), (2, "nobody", None, "Hi")], "id int, session_id string, system string, prompt string"
    )
    found = {r.id: [(x.role, x.content) for x in r.messages] for r in m.build_messages(prompts, talk).collect()}
    assert found[1] == [("system", "Be kind."), ("user", "one lamp"), ("assistant", "which one"), ("user", "Next?")]
    assert found[2] == [("user", "Hi")]


def test_results_to_memory(spark):
    now = dt.datetime(2024, 1, 1)
    pages = spark.createDataFrame([("T", "C", "u", now), (None, "D", "v", now)], "title string, content string, url string, timestamp timestamp")
    hits = spark.createDataFrame(
        [("f1", {"source": "s", "similarity": "0.8"}, now), ("f2", {}, now)], "content string, metadata map<string,string>, timestamp timestamp"
    )
    asked = spark.createDataFrame([("q", now)], "query string, timestamp timestamp")
    told = spark.createDataFrame([("a", now)], "summary string, timestamp timestamp")
    parts = m.results_to_memory(pages, hits, asked, told)
    tables = {kind: m.append_memory(kind, part).collect() for kind, part in parts.items()}
    assert {(r.title, r.content, r.url) for r in tables["document"]} == {("T", "C", "u"), ("Untitled", "D", "v")}
    assert {(r.fact, r.source, r.confidence) for r in tables["fact"]} == {("f1", "s", 0.8), ("f2", "", 0.5)}
    assert {(r.session_id, r.role, r.content) for r in tables["conversation"]} == {("default", "user", "q"), ("default", "assistant", "a")}


def test_number_rows_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(16)
    found = number_rows(df, ["v"], "n", 10).collect()
    assert all(r.n == r.v + 10 for r in found) and len(found) == 5000
