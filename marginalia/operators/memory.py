"""Conversation, fact and document memory as tables."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.operators.numbering import number_rows
from marginalia.session import broadcast_if_small, cut_lineage
from marginalia.sources.tables import exists

# The columns of each table with what a missing value becomes.
DEFAULTS = {
    "conversation": {"session_id": "default", "role": "unknown", "content": ""},
    "fact": {"fact": "", "source": "", "confidence": 1.0},
    "document": {"title": "Untitled", "content": "", "url": ""},
}
SEARCHED = {"conversation": "content", "fact": "fact", "document": "content"}
# The filters that count; others are ignored.
FILTERS = ["session_id", "role", "source", "title", "url"]


def _defaults(kind: str) -> dict:
    if kind not in DEFAULTS:
        raise ValueError(f"memory type must be one of {sorted(DEFAULTS)}, not {kind!r}")
    return DEFAULTS[kind]


def memory_schema(kind: str) -> T.StructType:
    types = {float: T.DoubleType(), str: T.StringType()}
    fields = [T.StructField(c, types[type(v)]) for c, v in _defaults(kind).items()]
    return T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("timestamp", T.TimestampType()),
            *fields,
            T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        ]
    )


def memory_rows(kind: str, rows: DataFrame) -> DataFrame:
    """Rows in table form without ids; further columns of ``rows`` stay.

    Input: ``timestamp`` and ``entry`` map<string,string>. Unknown keys become metadata.
    """
    entry, defaults = F.col("entry"), _defaults(kind)

    def value(name, default):
        held = F.try_element_at(entry, F.lit(name))
        held = held.try_cast("double") if isinstance(default, float) else held
        return F.coalesce(held, F.lit(default)).alias(name)

    return rows.select(
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        *[value(name, default) for name, default in defaults.items()],
        F.map_filter(entry, lambda k, _: ~k.isin(*defaults)).alias("metadata"),
        *[c for c in rows.columns if c not in ("timestamp", "entry")],
    )


def append_memory(
    kind: str, rows: DataFrame, table: DataFrame | None = None, order: list[str] | None = None
) -> DataFrame:
    """The new rows with ids that go on from the table's highest; append them to the table.

    ``order`` names the columns of ``rows`` that say how the rows came in; without it they
    are taken by timestamp and content. One writer at a time, as ids are sequential.
    """
    top = table.agg(F.max("id")).first()[0] if table is not None else None
    shaped = memory_rows(kind, rows)
    if order is None:
        shaped = shaped.withColumn("_metadata", F.to_json(F.array_sort(F.map_entries("metadata"))))
        order = ["timestamp", *_defaults(kind), "_metadata"]
    return number_rows(shaped, order, "id", (top or 0) + 1).select(*memory_schema(kind).names)


def store_memory(kind: str, rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Append new rows to the stored table; only they are written. Input as ``append_memory``.

    ``path`` holds ``rows`` and the ids that were ``deleted``. Ids go on from the highest ever
    given. One writer at a time.
    """
    spark = rows.sparkSession
    known = spark.read.schema(memory_schema(kind)).parquet(f"{path}/rows").select("id") if exists(spark, f"{path}/rows") else None
    append_memory(kind, rows, known, order).write.mode("append").parquet(f"{path}/rows")


def load_memory(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """The stored rows that were not deleted; none where nothing was stored. Damaged files raise."""
    if not exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], memory_schema(kind))
    rows = spark.read.schema(memory_schema(kind)).parquet(f"{path}/rows")
    if not exists(spark, f"{path}/deleted"):
        return rows
    gone = spark.read.schema("id bigint").parquet(f"{path}/deleted").distinct()
    return rows.join(broadcast_if_small(gone), "id", "left_anti")


def forget_memory(kind: str, path: str, ids: DataFrame) -> int:
    """Delete stored rows by id, and say how many there were. Only their ids are written."""
    table = load_memory(ids.sparkSession, kind, path)
    gone = cut_lineage(table.select("id").join(ids.select("id").distinct(), "id", "left_semi"))
    gone.write.mode("append").parquet(f"{path}/deleted")
    return gone.count()


def read_memory(kind: str, table: DataFrame, ids: list[int] | DataFrame) -> DataFrame:
    _defaults(kind)
    if isinstance(ids, DataFrame):
        return table.join(ids.select("id"), "id", "left_semi")
    return table.filter(F.col("id").isin(*ids)) if ids else table.filter(F.lit(False))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def contains_like(text: Column, query: str) -> Column:
    """``LIKE '%query%'`` that folds ASCII letters only; ``%`` and ``_`` stay wildcards."""
    folded = query.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return ascii_lower(text).like("%" + folded.replace("\\", "\\\\") + "%")


def search_memory(
    kind: str, table: DataFrame, query: str = "", filters: dict | None = None, limit: int = 10
) -> DataFrame:
    """Rows that hold the query and equal the filters, newest first."""
    _defaults(kind)
    found = table
    if query:
        found = found.filter(contains_like(F.col(SEARCHED[kind]), query))
    for name, value in (filters or {}).items():
        if name not in FILTERS:
            continue
        if name not in table.columns:
            raise ValueError(f"{kind} memory has no column {name!r}")
        found = found.filter(F.col(name) == value)
    return found.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def conversation_history(
    conversations: DataFrame, sessions: DataFrame | None = None, limit: int = 10, latest: bool = False
) -> DataFrame:
    """The first ``limit`` messages of each session (or the last ones), oldest first."""
    if sessions is not None:
        conversations = conversations.join(sessions.select("session_id"), "session_id", "left_semi")
    order = [F.desc("timestamp"), F.desc("id")] if latest else ["timestamp", "id"]
    chosen = conversations.withColumn("n", F.row_number().over(W.partitionBy("session_id").orderBy(*order)))
    chosen = chosen.filter(F.col("n") <= limit)
    if latest:
        held = F.count(F.lit(1)).over(W.partitionBy("session_id"))
        chosen = chosen.withColumn("n", (held - F.col("n") + 1).cast("int"))
    return chosen.select("session_id", "n", "role", "content")


def delete_memory(kind: str, table: DataFrame, ids: DataFrame) -> tuple[DataFrame, int]:
    """The remaining rows of a table, and how many of the ids existed; ``forget_memory`` is for a stored one."""
    _defaults(kind)
    gone = ids.select("id")
    return table.join(gone, "id", "left_anti"), table.join(gone, "id", "left_semi").count()


def _entry(**columns: Column) -> Column:
    pairs = [part for name, value in columns.items() for part in (F.lit(name), value.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("entry")


def results_to_memory(
    pages: DataFrame, hits: DataFrame, queries: DataFrame, summaries: DataFrame
) -> dict[str, DataFrame]:
    """Rows to append per table: pages, search hits, and the conversation around them.

    Input: pages(title, content, url, timestamp), hits(content, metadata, timestamp),
    queries(query, timestamp), summaries(summary, timestamp). A hit's confidence is its
    ``similarity`` or 0.5.
    """
    meta = F.col("metadata")
    said = [
        part.select("timestamp", _entry(session_id=F.lit("default"), role=F.lit(role), content=F.col(column)))
        for part, role, column in ((queries, "user", "query"), (summaries, "assistant", "summary"))
    ]
    return {
        "document": pages.select(
            "timestamp",
            _entry(title=F.col("title"), content=F.col("content"), url=F.col("url"), timestamp=F.col("timestamp")),
        ),
        "fact": hits.select(
            "timestamp",
            _entry(
                fact=F.col("content"),
                source=F.coalesce(F.try_element_at(meta, F.lit("source")), F.lit("")),
                confidence=F.coalesce(F.try_element_at(meta, F.lit("similarity")), F.lit("0.5")),
            ),
        ),
        "conversation": said[0].unionByName(said[1]),
    }


def build_messages(prompts: DataFrame, conversations: DataFrame, limit: int = 10) -> DataFrame:
    """Chat messages per prompt: system, the session's history in order, then the user's prompt.

    Input: prompts(id, session_id, system, prompt). History is cut to ``limit`` before it
    is brought together.
    """
    message = "struct<role:string,content:string>"
    history = conversation_history(conversations, prompts.select("session_id").distinct(), limit)
    held = history.groupBy("session_id").agg(
        F.sort_array(F.collect_list(F.struct("n", "role", "content"))).alias("h")
    )

    def single(role, column):
        return F.array(F.struct(F.lit(role).alias("role"), F.col(column).alias("content")))

    past = F.transform(
        F.coalesce("h", F.array().cast("array<struct<n:int,role:string,content:string>>")),
        lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
    )
    system = F.when(F.col("system").isNotNull(), single("system", "system")).otherwise(
        F.array().cast(f"array<{message}>")
    )
    return prompts.join(held, "session_id", "left").select(
        "id", F.concat(system, past, single("user", "prompt")).alias("messages")
    )
