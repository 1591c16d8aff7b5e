"""Indexing files and answering queries from the index.

An index folder holds Parquet tables: ``registry``, which is appended to, and ``pages``, ``chunks``,
``owners`` (which run wrote a document) and ``frequencies`` (in how many vectors a place weighs
anything), each in a folder per run that the run may replace. Nothing else is rewritten. The
default vectors depend on their texts alone and are weighted by the merged frequencies when a
query is asked, so it does not matter in which batches documents were indexed.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import code_imports, code_metadata, content_id
from marginalia.operators.chunks import chunk_documents
from marginalia.operators.library import document_summaries, get_documents, resolve_hits
from marginalia.operators.vectors import embed_text, few_hits, inverse_frequencies, merged_frequencies, place_frequencies, search_topk, weigh_places
from marginalia.session import broadcast_if_small, cut_lineage, keep_listed, many_files, temporary_tables
from marginalia.sources.files import CODE_TYPES, extract_pages
from marginalia.sources.tables import exists, read_registry, write_registry

CHUNK_SCHEMA = (
    "chunk_id string, doc_id string, source string, page_no int, chunk_no int, text string, metadata map<string,string>, vector array<float>"
)
CHUNK_COLUMNS = [part.split()[0] for part in CHUNK_SCHEMA.split(", ")]
# Ids up to this number are looked up by literal filters.
LISTED_IDS = 500
PAGE_SCHEMA = "doc_id string, source string, page_no int, text string, metadata map<string,string>"


def chunk_id(doc_id: Column, page_no: Column, chunk_no: Column) -> Column:
    return F.concat_ws("-", doc_id, page_no.cast("string"), chunk_no.cast("string"))


def _read(spark: SparkSession, index: str, table: str, schema: str, ids: DataFrame | None = None) -> DataFrame:
    """A table of the index with ``run``, without the rows of runs that lost a document to another one.

    With ``ids`` (doc_id) only files of the runs that hold these documents are read, and of those
    the row groups that may have them.
    """
    path = f"{index}/{table}"
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, run string")
    rows = spark.read.schema(f"{schema}, run string").parquet(path)
    if ids is not None:
        rows = _listed(rows, index, ids)
    lost = f"{index}/superseded"
    if exists(spark, lost):
        gone = spark.read.schema("doc_id string, loser string, run string").parquet(lost).select("doc_id", F.col("loser").alias("run")).distinct()
        rows = rows.join(broadcast_if_small(gone), ["doc_id", "run"], "left_anti")
    return rows


def _listed(rows: DataFrame, index: str, ids: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    wanted = ids.select("doc_id").distinct()
    few = [r.doc_id for r in wanted.limit(LISTED_IDS + 1).collect()]
    if len(few) > LISTED_IDS:
        return rows.join(broadcast_if_small(wanted), "doc_id", "left_semi")
    owners = spark.read.schema("doc_id string, run string").parquet(f"{index}/owners")
    runs = [r.run for r in owners.where(F.col("doc_id").isin(few)).select("run").distinct().collect()]
    return rows.where(F.col("run").isin(runs) & F.col("doc_id").isin(few))


def read_chunks(spark: SparkSession, index: str, ids: DataFrame | None = None) -> DataFrame:
    return _read(spark, index, "chunks", CHUNK_SCHEMA, ids).select(*CHUNK_COLUMNS)


def read_pages(spark: SparkSession, index: str, ids: DataFrame | None = None) -> DataFrame:
    return _read(spark, index, "pages", PAGE_SCHEMA, ids).drop("run")


def index_weights(spark: SparkSession, index: str) -> np.ndarray | None:
    """How much every place of the default vectors weighs, from the merged frequencies of all runs."""
    path = f"{index}/frequencies"
    if not exists(spark, path):
        return None
    return inverse_frequencies(merged_frequencies(spark.read.schema("place int, docs bigint, total bigint, run string").parquet(path)))


def page_metadata(pages: DataFrame) -> DataFrame:
    """Add ``metadata``: for source files the language, size and imports, as strings."""
    name = F.regexp_extract("source", r"([^/]+)$", 1)
    is_code = F.col("type").isin(*CODE_TYPES)
    read = code_imports(code_metadata(pages.select("*"), path="source").drop("filename"))
    pairs = {
        "language": F.col("language"), "filename": name, "line_count": F.col("line_count").cast("string"),
        "file_size_bytes": F.col("file_size_bytes").cast("string"), "content_type": F.col("content_type"),
        "imports": F.to_json("imports"),
    }
    held = F.create_map(*[part for key, value in pairs.items() for part in (F.lit(key), value)])
    none = F.create_map().cast("map<string,string>")
    metadata = F.when(is_code, F.map_filter(held, lambda _, v: v.isNotNull())).otherwise(none)
    return read.select(*pages.columns, metadata.alias("metadata"))


def index_documents(files: DataFrame, index: str, embedder=None, run: str | None = None) -> dict[str, int]:
    """Index files by content: new contents are chunked and embedded, known ones only re-registered.

    Input: path, filename, type, size_bytes, last_modified, content. Equal contents are one
    document, under the last path. A file without text is not indexed. Whether a content is
    known is looked up in the registry, which holds documents with chunks only. Every content
    is read once. ``run`` names what this call writes: the same call under the same name replaces
    its rows. Runs at the same time may index the same content; of these the one with the first
    name keeps it. Returns the numbers of files found and of documents registered.
    """
    with temporary_tables(files.sparkSession), many_files(files.sparkSession):
        return _index(files, index, embedder, run or uuid.uuid4().hex)


def _known(spark: SparkSession, index: str, run: str) -> DataFrame:
    """Registered ids, but for those that this very run has written before."""
    ids = read_registry(spark, f"{index}/registry").select("id").distinct()
    if exists(spark, f"{index}/owners"):
        owners = spark.read.schema("doc_id string, run string").parquet(f"{index}/owners")
        mine = owners.where(F.col("run") == run).select(F.col("doc_id").alias("id"))
        ids = ids.join(mine, "id", "left_anti")
    return cut_lineage(ids)


def _index(files: DataFrame, index: str, embedder, run: str) -> dict[str, int]:
    spark = files.sparkSession
    known = _known(spark, index, run)
    few = broadcast_if_small(known)
    named = files.select("path", "filename", "type", "size_bytes", "last_modified", content_id(F.col("content")).alias("id"), "content")
    if few is not known:
        # Contents that are known are not parsed again.
        named = named.join(few.withColumn("_known", F.lit(True)), "id", "left")
        named = named.withColumn("content", F.when(F.col("_known").isNull(), F.col("content"))).drop("_known")
    staged = cut_lineage(extract_pages(named, outer=True))
    listed = cut_lineage(staged.where("coalesce(page_no, 0) = 0").drop("page_no", "text"))
    last = listed.groupBy("id").agg(F.max_by(F.struct(*[c for c in listed.columns if c != "id"]), "path").alias("f"))
    documents = cut_lineage(last.select("id", "f.*"))
    fresh = cut_lineage(documents.select("id", "path").join(few, "id", "left_anti"))
    pages = keep_listed(staged.where("text is not null"), listed, fresh, "path")
    pages = page_metadata(pages.select(F.col("id").alias("doc_id"), F.col("path").alias("source"), "type", "page_no", "text"))
    held = known
    if not fresh.isEmpty():
        _replace(pages.select("doc_id", "source", "page_no", "text", "metadata"), index, "pages", run, "doc_id")
        own = spark.read.schema(PAGE_SCHEMA).parquet(f"{index}/pages/run={run}")
        keyed = chunk_documents(own).withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("page_no"), F.col("chunk_no")))
        # Sorted files let a look-up of a few ids skip most of them.
        chunks = embed_text(keyed, "text", embedder).select(*CHUNK_COLUMNS).sortWithinPartitions("chunk_id")
        _replace(chunks, index, "chunks", run, "doc_id")
        written = spark.read.schema(CHUNK_SCHEMA).parquet(f"{index}/chunks/run={run}")
        if embedder is None:
            _replace(place_frequencies(written), index, "frequencies", run)
        _replace(written.select("doc_id").distinct().sort("doc_id"), index, "owners", run, "doc_id")
        held = known.union(written.select("doc_id")).distinct()
    rows = documents.join(held, "id", "left_semi").select(
        "id", "filename", "path", "type", F.lit(None).cast("string").alias("title"),
        F.current_timestamp().alias("created_at"), "size_bytes", "last_modified",
    )
    rows = cut_lineage(rows)
    write_registry(rows, index + "/registry")
    if not fresh.isEmpty():
        _settle(spark, index, run, embedder)
    return {"found": files.select("path").count(), "indexed": rows.count()}


def _replace(rows: DataFrame, index: str, table: str, run: str, key: str | None = None) -> None:
    """Write what a run has of a table, in place of what it had; a Bloom filter on the key serves look-ups."""
    writer = rows.write.mode("overwrite")
    if key:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.parquet(f"{index}/{table}/run={run}")


def _settle(spark: SparkSession, index: str, run: str, embedder) -> None:
    """Where several runs have written a document, the first by name keeps it.

    Every run does this after it has registered its documents, so the last of them sees all.
    """
    owners = spark.read.schema("doc_id string, run string").parquet(f"{index}/owners")
    mine = owners.where(F.col("run") == run).select("doc_id")
    shared = owners.join(broadcast_if_small(mine), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("run").alias("winner"), F.max("run").alias("last"))
    shared = cut_lineage(shared.where("winner <> last"))
    if shared.isEmpty():
        return
    lost = cut_lineage(owners.join(broadcast_if_small(shared), "doc_id").where("run <> winner").select("doc_id", F.col("run").alias("loser")))
    _replace(lost, index, "superseded", run)
    if embedder is None:
        for loser in [r.loser for r in lost.select("loser").distinct().collect()]:
            rest = _read(spark, index, "chunks", CHUNK_SCHEMA).where(F.col("run") == loser)
            _replace(cut_lineage(place_frequencies(rest)), index, "frequencies", loser)


def read_documents(keys: DataFrame, index: str) -> DataFrame:
    """Documents of the index with the beginning of their text, by id, prefix of an id, or path. Input: key."""
    spark = keys.sparkSession
    registry = cut_lineage(read_registry(spark, index + "/registry"))
    found = get_documents(keys, registry)
    wanted = found.select(F.col("id").alias("doc_id"))
    mine = cut_lineage(read_pages(spark, index, wanted).select("doc_id", "page_no", "text", "metadata"))
    summaries = document_summaries(mine).withColumnRenamed("doc_id", "id")
    metadata = mine.filter("page_no = 0").select(F.col("doc_id").alias("id"), "metadata")
    return found.join(summaries, "id").join(metadata, "id").select("key", "id", "filename", "path", "type", "summary", "metadata")


def rank_chunks(queries: DataFrame, chunks: DataFrame, k: int = 5, embedder=None, weights: np.ndarray | None = None) -> DataFrame:
    """The k nearest chunks of each query text, after both sides are weighted by place if there are weights.

    Input: queries(query_id, text), chunks(chunk_id, vector, ...).
    """
    asked = embed_text(queries.select("query_id", "text"), "text", embedder)
    vectors = chunks.select(F.col("chunk_id").alias("id"), "vector")
    if weights is not None:
        asked, vectors = weigh_places(asked, weights), weigh_places(vectors, weights)
    hits = search_topk(asked, vectors, k)
    rest = chunks.drop("vector").withColumnRenamed("chunk_id", "id")
    return few_hits(hits, queries).join(rest, "id").withColumnRenamed("id", "chunk_id")


def search_documents(queries: DataFrame, index: str, k: int = 5, embedder=None) -> DataFrame:
    """The k best chunks of the index for every query, with the document they belong to."""
    spark = queries.sparkSession
    weights = index_weights(spark, index) if embedder is None else None
    hits = cut_lineage(rank_chunks(queries, read_chunks(spark, index), k, embedder, weights))
    registry = read_registry(spark, index + "/registry", hits.select(F.col("doc_id").alias("id")))
    named = resolve_hits(hits, registry)
    own = F.create_map(F.lit("source"), F.col("source"), F.lit("chunk_id"), F.col("chunk_id"))
    none = F.create_map().cast("map<string,string>")
    return named.select(
        "query_id",
        "rank",
        "document_id",
        "filename",
        F.col("text").alias("content"),
        "score",
        F.col("page_no").alias("page_number"),
        F.map_concat(F.coalesce("metadata", none), own).alias("metadata"),
    )


def search_table(queries: DataFrame, docs: DataFrame, k: int = 5, embedder=None) -> DataFrame:
    """Search a table of documents directly: chunk, embed, rank, attach the document.

    Input: queries(query_id, text), docs(doc_id, text, source). Equal texts are one
    document, the one of the lowest doc_id.
    """
    hashed = cut_lineage(docs.select(content_id(F.col("text")).alias("content_id"), "doc_id"))
    first = cut_lineage(hashed.groupBy("content_id").agg(F.min("doc_id").alias("doc_id")))
    unique = keep_listed(docs.select("doc_id", "text", "source"), hashed, first, "doc_id")
    unique = unique.withColumn("content_id", content_id(F.col("text")))
    chunks = cut_lineage(chunk_documents(unique))
    keyed = chunks.withColumn("chunk_id", chunk_id(F.col("content_id"), F.lit(0), F.col("chunk_no")))
    vectors = cut_lineage(embed_text(keyed, "text", embedder))
    weights = inverse_frequencies(place_frequencies(vectors)) if embedder is None else None
    hits = rank_chunks(queries, vectors, k, embedder, weights)
    return hits.select(
        "query_id", "rank", "doc_id", "chunk_no", "source",
        F.round("score", 6).alias("score"), F.col("text").alias("content"),
    )
