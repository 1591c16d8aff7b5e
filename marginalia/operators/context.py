"""Context text per query from search results, pages and document hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.text import clip
from marginalia.session import cut_lineage

# How much of what is shown, and the texts of the blocks.
RESULTS_PER_LIST = 5
PAGE_CHARS = 1500
NO_WEB = "No web results available."
NO_DOCUMENTS = "No document results available."


def _or(column: str, default: str) -> Column:
    return F.coalesce(F.col(column), F.lit(default))


def _first_joined(rows: DataFrame, n: int, block: Column) -> DataFrame:
    """The first n blocks of each query as one text; rows beyond n never leave their task."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    first = rows.select("query_id", place.alias("place"), block.alias("block")).filter(F.col("place") <= n)
    held = first.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "block"))).alias("b"))
    return held.select("query_id", F.array_join("b.block", "").alias("text"))


def format_search_context(results: DataFrame, n: int = RESULTS_PER_LIST) -> DataFrame:
    """The first results of each query as a list. Input: query_id, rank, title, snippet, url."""
    block = F.concat(
        F.lit("- "), _or("title", "No title"), F.lit(": "), _or("snippet", "No snippet"),
        F.lit(" (Source: "), _or("url", ""), F.lit(")\n\n"),
    )
    return _first_joined(results, n, block)


def page_block() -> Column:
    """Text of one fetched page, or a warning that the source failed."""
    failed = F.concat(
        F.lit("[FAILED SOURCE] "), _or("title", "Error"), F.lit(" (URL: "), _or("url", ""), F.lit(")\nError: "),
        _or("error", "Unknown error"),
        F.lit("\nWARNING: This source could not be accessed and should not be cited or used as a reference.\n\n"),
    )
    fetched = F.concat(
        F.lit("Webpage: "), _or("title", "Untitled"), F.lit(" (Source: "), _or("url", ""), F.lit(")\nContent: "),
        clip(_or("content", ""), PAGE_CHARS), F.lit("\n\n"),
    )
    return F.when(F.coalesce("fetch_success", F.lit(True)), fetched).otherwise(failed)


def format_page_context(pages: DataFrame) -> DataFrame:
    """One block per page, clipped where the page is read. Narrow.

    Input: title, url, content, fetch_success, error; further columns stay.
    """
    used = ("title", "url", "content", "html", "fetch_success", "error")
    return pages.select(*[c for c in pages.columns if c not in used], page_block().alias("text"))


def format_doc_context(hits: DataFrame, n: int = RESULTS_PER_LIST) -> DataFrame:
    """The first document hits of each query. Input: query_id, rank, content, source."""
    block = F.concat(
        F.lit("- "), _or("content", ""), F.lit(" (Source: "), _or("source", "Unknown"), F.lit(")\n\n")
    )
    return _first_joined(hits, n, block)


def count_failures(results: DataFrame) -> DataFrame:
    """Failed fetches and analyses per query. Input: query_id, success."""
    return results.groupBy("query_id").agg(
        F.count_if(~F.coalesce("success", F.lit(True))).alias("failures")
    )


def build_context(queries: DataFrame, results: DataFrame, pages: DataFrame, hits: DataFrame) -> DataFrame:
    """One context row per query: search list, pages in order, document hits, failures.

    ``pages`` has query_id and position (the step that fetched it); pages at one position are
    ordered by their text. The text of a query holds all its pages, each clipped.
    """
    # Written once, as every part of the context is cut to it.
    asked = cut_lineage(queries.select("query_id").distinct())
    pages = pages.join(asked, "query_id", "left_semi")

    def parts(texts: DataFrame, kind: str) -> DataFrame:
        return texts.join(asked, "query_id", "left_semi").select(
            "query_id", F.lit(kind).alias("kind"), F.lit(0).cast("bigint").alias("position"), "text"
        )

    blocks = format_page_context(pages).select(
        "query_id", F.lit("page").alias("kind"), F.col("position").cast("bigint").alias("position"), "text"
    )
    # Every query has a row, whatever was found for it.
    rows = (
        parts(asked.withColumn("text", F.lit("")), "query")
        .unionByName(parts(format_search_context(results), "search"))
        .unionByName(parts(format_doc_context(hits), "document"))
        .unionByName(blocks)
    )
    held = rows.groupBy("query_id").agg(
        F.max(F.when(F.col("kind") == "search", F.col("text"))).alias("search"),
        F.max(F.when(F.col("kind") == "document", F.col("text"))).alias("document"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "page", F.struct("position", "text")))).alias("pages"),
    )
    failed = count_failures(pages.select("query_id", F.col("fetch_success").alias("success")))
    web = F.concat(_or("search", ""), F.array_join("pages.text", ""))
    return held.join(failed, "query_id", "left").select(
        "query_id",
        F.when(web == "", F.lit(NO_WEB)).otherwise(web).alias("web_context"),
        _or("document", NO_DOCUMENTS).alias("doc_context"),
        F.coalesce("failures", F.lit(0)).alias("failures"),
    )
