"""Physical plans: what must not be in them."""

import pytest
from pyspark.sql import functions as F

from checks import table
from marginalia.functions import text as t
from marginalia.operators import chunks, library, memory, pages, ranking, vectors
from marginalia.sources import tables as tb

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def web(spark):
    return table(spark, SMALL, "pages")


def test_allowlist_neither_shuffles_nor_loops(web):
    shown = plan(pages.allowed_pages(web, ["example.org"]))
    assert "Exchange" not in shown and "NestedLoop" not in shown and "Python" not in shown


def test_long_allowlist_joins_on_the_host(web, monkeypatch):
    monkeypatch.setattr(pages, "LITERAL_DOMAINS", 0)
    shown = plan(pages.allowed_pages(web, ["example.org", "x.org"]))
    assert "NestedLoop" not in shown and "Cartesian" not in shown and "LeftSemi" in shown


def test_html_is_read_once_and_narrowly(web):
    for df in (pages.parse_pages(web), pages.page_links(web), pages.select_text(web, "p")):
        shown = plan(df)
        assert shown.count("read_html") <= 2 and "Exchange" not in shown
    assert "url" not in plan(pages.page_title(web)).split("ReadSchema")[-1]


def test_scalar_functions_stay_in_the_jvm(spark):
    docs = table(spark, SMALL, "documents")
    col = F.col("text")
    shown = plan(
        docs.select(t.slug(col), t.clip(col, 9), t.clean_extracted_text(col), t.token_estimate(col), t.content_id(col))
    )
    assert "Python" not in shown and "WholeStageCodegen" in shown or "*(1)" in shown
    assert "lang" not in shown.split("ReadSchema")[-1]


def test_chunks_are_narrow(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    assert "Exchange" not in plan(chunks.chunk_documents(docs))
    assert "Python" not in plan(chunks.chunk_fixed(docs))


def test_topk_cuts_before_the_shuffle(spark):
    vecs = table(spark, SMALL, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    shown = plan(vectors.search_topk(vecs.withColumnRenamed("id", "query_id"), vecs))
    assert shown.count("Exchange") == 1 and "Cartesian" not in shown and "NestedLoop" not in shown
    assert "row_number(), 5, Partial" in shown


def test_top_n_per_key_cuts_before_the_shuffle(spark):
    talk = table(spark, SMALL, "conversations").select(
        F.col("conv_id").alias("session_id"), "role", F.col("text").alias("content"), F.col("turn").alias("id"), F.col("turn").alias("timestamp")
    )
    assert "10, Partial" in plan(memory.conversation_history(talk))
    found = talk.select(F.col("session_id").alias("query_id"), F.lit(1).alias("priority"), F.col("id").alias("rank"))
    assert "5, Partial" in plan(ranking.first_nonempty_source(found))


def test_memory_search_is_pushed_down(spark):
    talk = table(spark, SMALL, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content"), F.col("turn").alias("id"), F.col("turn").alias("timestamp")
    )
    shown = plan(memory.search_memory("conversation", talk, "a", {"role": "user"}))
    assert "TakeOrderedAndProject" in shown and "EqualTo(role,user)" in shown


def test_lookups_are_equi_joins(spark):
    registry = spark.createDataFrame([], tb.REGISTRY_SCHEMA)
    keys = spark.createDataFrame([("ab",)], "key string")
    hits = spark.createDataFrame([("a",)], "source string")
    for df in (library.get_documents(keys, registry), library.resolve_hits(hits, registry)):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
