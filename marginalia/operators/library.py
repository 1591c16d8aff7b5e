"""The registry of indexed documents: listing, lookup, summaries, search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.text import clip, short_id, size_kb
from marginalia.session import broadcast_if_small, cut_lineage

ID_LENGTH = 64
SUMMARY_PAGES = 3
SUMMARY_CHARS = 1000


def list_documents(registry: DataFrame) -> DataFrame:
    return registry.select(
        short_id(F.col("id")).alias("short_id"),
        "filename",
        "type",
        size_kb(F.col("size_bytes")).alias("size"),
        F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("Unknown")).alias("created"),
    )


def _prefix(key: Column) -> Column:
    """What an id must start with: short keys and keys ending in dots are prefixes."""
    partial = key.endswith("...") | (F.length(key) < ID_LENGTH)
    return F.when(partial, F.regexp_replace(key, r"\.+$", "")).otherwise(key)


def get_documents(ids: DataFrame, registry: DataFrame, key: str = "key") -> DataFrame:
    """Documents by full id, by prefix, or by path; a prefix or path takes the first document registered.

    The registry is keyed by the prefix lengths that were asked for, at most 65 of them, and
    cut to the prefixes that were asked for, so the lookup is an equi-join that keeps one
    small row per prefix.
    """
    asked = ids.select(F.col(key)).distinct().withColumn("prefix", _prefix(F.col(key)))
    asked = cut_lineage(asked)
    lengths = [r[0] for r in asked.select(F.least(F.length("prefix"), F.lit(ID_LENGTH + 1))).distinct().collect()]
    if not lengths:
        lengths = [ID_LENGTH]
    prefixes = broadcast_if_small(asked.select("prefix").distinct())
    first = (
        registry.select("id", "created_at", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("size"))
        .filter(F.length("id") >= F.col("size"))
        .select("id", "created_at", F.expr("left(id, size)").alias("prefix"))
        .join(prefixes, "prefix", "left_semi")
        .groupBy("prefix")
        .agg(F.min(F.struct("created_at", "id")).alias("first"))
        .select("prefix", F.col("first.id").alias("_id"), F.col("first.created_at").alias("_created_at"))
    )
    paths = asked.select(F.col(key).alias("path")).filter(F.col("path").contains("/"))
    by_path = registry.join(paths, "path", "left_semi").groupBy(F.col("path").alias(key))
    by_path = by_path.agg(F.min(F.struct("created_at", "id")).alias("first"))
    found = asked.filter(~F.col(key).contains("/")).join(first, "prefix").select(key, "_id", "_created_at")
    found = found.unionByName(by_path.select(key, F.col("first.id").alias("_id"), F.col("first.created_at").alias("_created_at")))
    same = (F.col("_id") == F.col("id")) & F.col("_created_at").eqNullSafe(F.col("created_at"))
    return found.join(registry, same).select(key, *registry.columns)


def document_summaries(pages: DataFrame) -> DataFrame:
    """The first pages of each document, joined and clipped.

    Input: doc_id, page_no, text. Pages are numbered, cut and clipped before they are
    brought together, so a document of any length is a few short strings.
    """
    order = W.partitionBy("doc_id").orderBy("page_no")
    first = pages.select(
        "doc_id", "page_no", F.substring("text", 1, SUMMARY_CHARS + 1).alias("text"), F.row_number().over(order).alias("n")
    ).filter(F.col("n") <= SUMMARY_PAGES)
    joined = first.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("parts"))
    return joined.select(
        "doc_id", clip(F.array_join("parts.text", "\n\n"), SUMMARY_CHARS).alias("summary")
    )


def resolve_hits(hits: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach the registered document to each hit: by path, else by file name, else ``unknown``.

    Input: hits(source, ...). Hits that carry a ``doc_id`` are matched by it first, so that
    a document keeps its chunks when its file moves. Lookup tables have one row per key.
    """
    document, first = F.struct("id", "filename"), F.struct("created_at", "id")
    # Written once: the hits both select from the registry and are joined with it.
    hits = cut_lineage(hits)
    found = hits.withColumn("name", F.regexp_extract("source", r"([^/]+)/*$", 1))
    keys = {"source": "path", "name": "filename"}
    if "doc_id" in hits.columns:
        keys = {"doc_id": "id", **keys}
    for key, column in keys.items():
        wanted = found.select(F.col(key).alias(column)).distinct()
        known = registry.join(wanted, column, "left_semi").groupBy(F.col(column).alias(key))
        known = known.agg(F.min_by(document, first).alias(f"_{key}"))
        found = found.join(known, key, "left")
    match = F.coalesce(*[F.col(f"_{key}") for key in keys])
    return found.select(
        *hits.columns,
        F.coalesce(match["id"], F.lit("unknown")).alias("document_id"),
        F.coalesce(match["filename"], F.col("name")).alias("filename"),
    )
