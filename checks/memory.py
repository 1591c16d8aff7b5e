"""Memory tables made from conversations, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import query, scratch, table
from marginalia.functions import text as t
from marginalia.operators import memory as m

# A conversation's turns are its session's messages; the table id follows conversation and turn.
BASE = "1704067200"
MEMORY = f"""mem AS (SELECT conv_id * 1000 + turn AS id, {BASE} + turn * 60 AS said, conv_id::varchar AS session_id, role,
    text AS content FROM conversations)"""


def memory(spark, d):
    rows = table(spark, d, "conversations")
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.timestamp_seconds(F.lit(int(BASE)) + F.col("turn") * 60).alias("timestamp"),
        F.col("conv_id").cast("string").alias("session_id"),
        "role",
        F.col("text").alias("content"),
        F.create_map(F.lit("n"), F.col("turn").cast("string")).alias("metadata"),
    )


def entries(spark, d):
    """Rows to append: system messages come without a role, user messages without a session."""
    rows, role = table(spark, d, "conversations"), F.col("role")
    entry = F.create_map(
        F.lit("session_id"), F.when(role != "user", F.col("conv_id").cast("string")),
        F.lit("role"), F.when(role != "system", role),
        F.lit("content"), F.col("text"), F.lit("turn"), F.col("turn").cast("string"),
    )
    return rows.select(
        F.timestamp_seconds(F.lit(int(BASE)) + F.col("turn") * 60).alias("timestamp"),
        F.map_filter(entry, lambda _, v: v.isNotNull()).alias("entry"),
        "conv_id",
        "turn",
    )


@query(
    "append_memory",
    f"""WITH {MEMORY}, top AS (SELECT max(id) AS id FROM mem)
        SELECT top.id + row_number() OVER (ORDER BY conv_id, turn) AS id, {BASE} + turn * 60 AS said,
            CASE WHEN role = 'user' THEN 'default' ELSE conv_id::varchar END AS session_id,
            CASE WHEN role = 'system' THEN 'unknown' ELSE role END AS role, text AS content, 'turn=' || turn AS metadata
        FROM conversations, top""",
)
def append_memory(spark, d):
    new = m.append_memory("conversation", entries(spark, d), memory(spark, d), ["conv_id", "turn"])
    pairs = F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return new.select(
        "id", F.unix_seconds("timestamp").alias("said"), "session_id", "role", "content", F.array_join(pairs, ",").alias("metadata")
    )


@query(
    "append_memory_facts",
    """SELECT row_number() OVER (ORDER BY doc_id) AS id, text AS fact,
        CASE WHEN lang = 'de' THEN '' ELSE source END AS source,
        CASE WHEN lang = 'fr' THEN 1.0 ELSE n_chars / 8.0::double END AS confidence FROM documents""",
)
def append_memory_facts(spark, d):
    lang = F.col("lang")
    entry = F.create_map(
        F.lit("fact"), F.col("text"),
        F.lit("source"), F.when(lang != "de", F.col("source")),
        F.lit("confidence"), F.when(lang != "fr", (F.col("n_chars") / F.lit(8.0)).cast("string")),
    )
    rows = table(spark, d, "documents").select(
        F.lit("2024-01-01").cast("timestamp").alias("timestamp"), F.map_filter(entry, lambda _, v: v.isNotNull()).alias("entry"), "doc_id"
    )
    return m.append_memory("fact", rows, None, ["doc_id"]).select("id", "fact", "source", "confidence")


def labelled_ids(spark, d):
    """Ids of the first two turns of the conversations that have the number of a labelled document."""
    first = F.explode(F.array(F.lit(0), F.lit(1)))
    return table(spark, d, "labels").select("doc_id", first.alias("n")).select((F.col("doc_id") * 1000 + F.col("n")).alias("id"))


@query(
    "read_memory",
    f"""WITH {MEMORY} SELECT id, said, session_id, role, content, (id % 1000)::varchar AS turn FROM mem
        WHERE id IN (SELECT doc_id * 1000 + n FROM labels, (VALUES (0), (1)) AS v(n))""",
)
def read_memory(spark, d):
    return m.read_memory("conversation", memory(spark, d), labelled_ids(spark, d)).select(
        "id", F.unix_seconds("timestamp").alias("said"), "session_id", "role", "content", F.col("metadata")["n"].alias("turn")
    )


# DuckDB folds only ASCII here, as the memory search does.
FOLDED = "translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "search_memory",
    f"""WITH {MEMORY} SELECT id, session_id, role, content FROM mem WHERE {FOLDED} LIKE '%ü_er%' AND role = 'assistant'
        ORDER BY said DESC, id DESC LIMIT 10""",
)
def search_memory(spark, d):
    found = m.search_memory("conversation", memory(spark, d), "ü_ER", {"role": "assistant", "colour": "red"})
    return found.select("id", "session_id", "role", "content")


@query(
    "conversation_history",
    f"""WITH {MEMORY}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY said, id) AS n FROM mem)
        SELECT session_id, n, role, content FROM n WHERE n <= 10""",
)
def conversation_history(spark, d):
    return m.conversation_history(memory(spark, d))


@query(
    "conversation_history_latest",
    f"""WITH {MEMORY}, b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY said DESC, id DESC) AS back FROM mem),
        k AS (SELECT * FROM b WHERE back <= 3)
        SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY said, id) AS n, role, content FROM k""",
)
def conversation_history_latest(spark, d):
    return m.conversation_history(memory(spark, d), limit=3, latest=True)


@query("delete_memory", f"WITH {MEMORY} SELECT id, role, content FROM mem WHERE id NOT IN (SELECT doc_id * 1000 + n FROM labels, (VALUES (0), (1)) AS v(n))")
def delete_memory(spark, d):
    rest, _ = m.delete_memory("conversation", memory(spark, d), labelled_ids(spark, d))
    return rest.select("id", "role", "content")


# Two appends, a deletion by number, and a third append whose ids go on behind the deleted ones.
@query(
    "stored_memory",
    """WITH n AS (SELECT count(*) AS n FROM conversations),
        a AS (SELECT 'a' AS part, row_number() OVER (ORDER BY conv_id, turn) AS id, text FROM conversations),
        b AS (SELECT 'b' AS part, n + row_number() OVER (ORDER BY item_id) AS id, text FROM benchmark, n),
        ab AS (SELECT * FROM a UNION ALL SELECT * FROM b),
        c AS (SELECT 'c' AS part, (SELECT max(id) FROM ab) + row_number() OVER (ORDER BY item_id) AS id, text FROM benchmark)
        SELECT id, text AS content FROM (SELECT * FROM ab WHERE id % 3 <> 0 AND id <> (SELECT max(id) FROM ab) UNION ALL SELECT * FROM c)""",
)
def stored_memory(spark, d):
    path, now = scratch(spark), F.lit("2024-01-01").cast("timestamp").alias("timestamp")
    said = table(spark, d, "conversations").select(now, F.create_map(F.lit("content"), F.col("text")).alias("entry"), "conv_id", "turn")
    asked = table(spark, d, "benchmark").select(now, F.create_map(F.lit("content"), F.col("text")).alias("entry"), "item_id")
    m.store_memory("conversation", said, path, ["conv_id", "turn"])
    m.store_memory("conversation", asked, path, ["item_id"])
    ids = m.load_memory(spark, "conversation", path).select("id")
    last = ids.agg(F.max("id").alias("id"))
    m.forget_memory("conversation", path, ids.filter(F.col("id") % 3 == 0).union(last))
    m.store_memory("conversation", asked, path, ["item_id"])
    return m.load_memory(spark, "conversation", path).select("id", "content")


# Documents of every kind of memory, written and read again under the declared columns.
@query(
    "memory_schema",
    """SELECT row_number() OVER (ORDER BY doc_id) AS id, 1704067200 AS said, source AS title, text AS content, '' AS url, 'lang=' || lang AS metadata
        FROM documents""",
)
def memory_schema(spark, d):
    path = scratch(spark)
    entry = F.create_map(F.lit("title"), F.col("source"), F.lit("content"), F.col("text"), F.lit("lang"), F.col("lang"))
    rows = table(spark, d, "documents").select(F.lit("2024-01-01").cast("timestamp").alias("timestamp"), entry.alias("entry"), "doc_id")
    m.append_memory("document", rows, None, ["doc_id"]).write.parquet(path)
    read = spark.read.schema(m.memory_schema("document")).parquet(path)
    pairs = F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return read.select("id", F.unix_seconds("timestamp").cast("int").alias("said"), "title", "content", "url", F.array_join(pairs, ",").alias("metadata"))


@query(
    "results_to_memory",
    """SELECT 'document' AS kind, regexp_extract(url, '([^/]+)/*$', 1) AS name, html AS content, url AS source, NULL::double AS confidence FROM pages
        UNION ALL SELECT 'fact', '', text, source, CASE WHEN lang = 'en' THEN n_chars / 4.0::double ELSE 0.5 END FROM documents
        UNION ALL SELECT 'conversation', 'user', text, 'default', NULL FROM benchmark
        UNION ALL SELECT 'conversation', 'assistant', 'Answer to ' || text, 'default', NULL FROM benchmark""",
)
def results_to_memory(spark, d):
    now = F.lit("2024-01-01").cast("timestamp").alias("timestamp")
    pages = table(spark, d, "pages").select(
        F.regexp_extract("url", r"([^/]+)/*$", 1).alias("title"), F.col("html").alias("content"), "url", now
    )
    similarity = F.when(F.col("lang") == "en", (F.col("n_chars") / F.lit(4.0)).cast("string"))
    meta = F.create_map(F.lit("source"), F.col("source"), F.lit("similarity"), similarity)
    hits = table(spark, d, "documents").select(F.col("text").alias("content"), meta.alias("metadata"), now)
    asked = table(spark, d, "benchmark")
    queries = asked.select(F.col("text").alias("query"), now)
    answers = asked.select(F.concat(F.lit("Answer to "), F.col("text")).alias("summary"), now)
    rows = m.results_to_memory(pages, hits, queries, answers)

    def shown(kind, name, content, source, confidence=F.lit(None).cast("double")):
        return m.memory_rows(kind, rows[kind]).select(
            F.lit(kind).alias("kind"), name.alias("name"), F.col(content).alias("content"), F.col(source).alias("source"), confidence.alias("confidence")
        )

    return (
        shown("document", F.col("title"), "content", "url")
        .union(shown("fact", F.lit(""), "fact", "source", F.col("confidence")))
        .union(shown("conversation", F.col("role"), "content", "session_id"))
    )


@query(
    "build_messages",
    f"""WITH {MEMORY}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY said, id) AS n FROM mem),
        h AS (SELECT session_id, string_agg(role || ': ' || content, chr(10) ORDER BY n) AS past FROM n WHERE n <= 10 GROUP BY 1)
        SELECT item_id AS id, CASE WHEN length(text) > 200 THEN 'system: Be brief.' || chr(10) ELSE '' END
            || coalesce(past || chr(10), '') || 'user: ' || text AS messages
        FROM benchmark LEFT JOIN h ON h.session_id = item_id::varchar""",
)
def build_messages(spark, d):
    prompts = table(spark, d, "benchmark").select(
        F.col("item_id").alias("id"), F.col("item_id").cast("string").alias("session_id"),
        F.when(F.length("text") > 200, F.lit("Be brief.")).alias("system"), F.col("text").alias("prompt"),
    )
    lines = F.transform("messages", lambda x: F.concat(x["role"], F.lit(": "), x["content"]))
    return m.build_messages(prompts, memory(spark, d)).select("id", F.array_join(lines, "\n").alias("messages"))
