"""File sources and sinks: the tables are written as files, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import query, scratch, table
from checks.pages import PARTS, registry_of
from marginalia.operators.stats import timing_stats
from marginalia.sources import files as fs
from marginalia.sources import summaries as su
from marginalia.sources import tables as tb

STAMP = "2024-01-02 03:04:05"
SUMMARY_FILES = rf"""named AS (SELECT item_id, text AS query,
        left(regexp_replace(regexp_replace(lower(text), '[^\pL\pN_\s-]', '', 'g'), '[\s-]+', '_', 'g'), 50) || '_' ||
            epoch(TIMESTAMP '{STAMP}' + to_seconds(item_id))::bigint || '.md' AS filename,
        strftime(TIMESTAMP '{STAMP}' + to_seconds(item_id), '%Y-%m-%d %H:%M:%S') AS date FROM benchmark),
    files AS (SELECT *, '---' || chr(10) || 'title: Research Summary' || chr(10) || 'query: "' || replace(query, chr(10), ' ')
        || '"' || chr(10) || 'date: ' || date || chr(10) || '---' || chr(10) || chr(10) || 'About: ' || query || chr(10) AS content FROM named)"""


def summaries(spark, d):
    """Every benchmark text as the query of one summary, a second apart."""
    return table(spark, d, "benchmark").select(
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("query"),
        F.concat(F.lit("About: "), F.col("text")).alias("summary"),
        F.timestamp_seconds(F.unix_seconds(F.lit(STAMP).cast("timestamp")) + F.col("item_id")).alias("ts"),
    )


def summary_folder(spark, d):
    folder = scratch(spark)
    su.write_summaries(summaries(spark, d), folder)
    return folder


@query("write_summaries", f"WITH {SUMMARY_FILES} SELECT filename, content FROM files")
def write_summaries(spark, d):
    return su.read_summary_files(spark, summary_folder(spark, d)).select("filename", F.col("value").alias("content"))


@query(
    "read_summaries",
    f"""WITH {SUMMARY_FILES}, q AS (SELECT *, trim(replace(query, chr(10), ' '), ' "') AS shown FROM files)
        SELECT filename, CASE WHEN length(shown) > 50 THEN left(shown, 50) || '...' ELSE shown END AS query, date,
        chr(10) || chr(10) || 'About: ' || query || chr(10) AS body FROM q""",
)
def read_summaries(spark, d):
    return su.read_summaries(spark, summary_folder(spark, d)).select("filename", "query", "date", "body")


@query(
    "summary_fields",
    f"""WITH {SUMMARY_FILES} SELECT filename, 'Research Summary' AS title, trim(replace(query, chr(10), ' '), ' "') AS query,
        date, 3 AS fields FROM files""",
)
def summary_fields(spark, d):
    fields = su.summary_fields(su.read_summary_files(spark, summary_folder(spark, d)))
    front = F.col("front")
    return fields.select(
        "filename", front["title"].alias("title"), front["query"].alias("query"), front["date"].alias("date"), F.size(front).alias("fields")
    )


@query(
    "scan_files",
    f"WITH {SUMMARY_FILES} SELECT filename, 'md' AS type, strlen(content) AS size_bytes FROM files",
)
def scan_files(spark, d):
    return fs.scan_files(spark, summary_folder(spark, d)).select("filename", "type", "size_bytes")


@query("read_text_docs", f"WITH {SUMMARY_FILES} SELECT filename, 0 AS page_no, content AS text FROM files")
def read_text_docs(spark, d):
    return fs.read_text_docs(fs.scan_files(spark, summary_folder(spark, d))).select("filename", "page_no", "text")


@query(
    "read_csv_docs",
    """SELECT 'doc_id: ' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || 'text: ' || trim(text, ' ' || chr(10) || chr(9))
        || chr(10) || 'n_chars: ' || n_chars AS text FROM documents""",
)
def read_csv_docs(spark, d):
    folder = scratch(spark)
    docs = table(spark, d, "documents").select("doc_id", "lang", "text", "n_chars")
    docs.write.csv(folder, header=True, escape='"', quoteAll=True)
    return fs.read_csv_docs(spark, folder).select("text")


@query(
    "read_json_docs",
    """WITH u AS (SELECT user_id, count(*) AS n, list(DISTINCT event_type ORDER BY event_type) AS kinds FROM events GROUP BY 1)
        SELECT 'user_' || user_id || '.json' AS filename, '{' || chr(10) || '  "user_id": ' || user_id || ',' || chr(10)
            || '  "name": "\\u00dc' || user_id || '",' || chr(10) || '  "events": ' || n || ',' || chr(10) || '  "kinds": [' || chr(10)
            || array_to_string(list_transform(kinds, lambda k: '    "' || k || '"'), ',' || chr(10)) || chr(10) || '  ]' || chr(10) || '}' AS text
        FROM u""",
)
def read_json_docs(spark, d):
    users = table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), F.sort_array(F.collect_set("event_type")).alias("kinds")
    )
    name = F.concat(F.lit("Ü"), F.col("user_id").cast("string")).alias("name")
    files = users.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.lit(".json")).alias("filename"),
        F.to_json(F.struct("user_id", name, "events", "kinds")).alias("content"),
    )
    folder = scratch(spark)
    su.write_files(files, folder)
    return fs.read_json_docs(fs.scan_files(spark, folder)).select("filename", "text")


@query("read_html_docs", f"WITH {PARTS} SELECT 'page_' || page_id || '.html' AS filename, content AS text FROM read_pages")
def read_html_docs(spark, d):
    folder = scratch(spark)
    su.write_files(
        table(spark, d, "pages").select(
            F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("filename"), F.col("html").alias("content")
        ),
        folder,
    )
    return fs.read_html_docs(fs.scan_files(spark, folder)).select("filename", "text")


# Documents that are not German are registered again a day later, from another folder.
@query(
    "read_registry",
    """WITH r AS (SELECT sha256(text) AS id, 'Doc_' || doc_id || '.TXT' AS filename, '/data/' || source || '/' AS folder, doc_id AS n, text FROM documents
            UNION ALL SELECT sha256(text), 'Doc_' || doc_id || '.TXT', '/new/', doc_id + 86400, text FROM documents WHERE lang <> 'de'),
        newest AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS back FROM r)
        SELECT id, filename, folder || filename AS path, 'txt' AS type, strlen(text) AS size_bytes,
        strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(n), '%Y-%m-%d %H:%M:%S') AS created FROM newest WHERE back = 1""",
)
def read_registry(spark, d):
    folder, docs = scratch(spark), table(spark, d, "documents")
    tb.write_registry(registry_of(docs), folder)
    again = registry_of(docs.filter(F.col("lang") != "de")).withColumn("path", F.concat(F.lit("/new/"), "filename"))
    tb.write_registry(again.withColumn("created_at", F.col("created_at") + F.make_dt_interval(days=F.lit(1))), folder)
    return tb.read_registry(spark, folder).select(
        "id", "filename", "path", "type", "size_bytes", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created")
    )


@query(
    "write_registry",
    """SELECT sha256(text) AS id, '/data/' || source || '/Doc_' || doc_id || '.TXT' AS path, strlen(text) AS size_bytes FROM documents
        UNION ALL SELECT sha256(text), '/new/Doc_' || doc_id || '.TXT', strlen(text) FROM documents WHERE lang <> 'de'""",
)
def write_registry(spark, d):
    folder, docs = scratch(spark), table(spark, d, "documents")
    tb.write_registry(registry_of(docs), folder)
    tb.write_registry(registry_of(docs.filter(F.col("lang") != "de")).withColumn("path", F.concat(F.lit("/new/"), "filename")), folder)
    return spark.read.parquet(folder).select("id", "path", "size_bytes")


@query(
    "write_metrics",
    """SELECT event_type, round(avg(value), 6) AS avg_seconds, min(value) AS min_seconds, max(value) AS max_seconds,
        count(*) AS total, count(*) AS successful FROM events GROUP BY 1""",
)
def write_metrics(spark, d):
    folder = scratch(spark)
    tb.write_metrics(timing_stats(table(spark, d, "events"), ["event_type"], "value"), folder)
    kinds = "event_type string, avg_seconds double, min_seconds double, max_seconds double, total long, successful long"
    return spark.read.schema(kinds).json(folder).withColumn("avg_seconds", F.round("avg_seconds", 6))
