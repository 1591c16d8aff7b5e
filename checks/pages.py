"""Page operators over the whole ``pages`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import query, scratch, table
from marginalia.functions import text as t
from marginalia.operators import pages as p

DOMAINS = ["example.org", "therha.example.com", "example.net.invalid"]

HOST = r"regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
ALLOWED = (
    "(host = 'example.org' OR ends_with(host, '.example.org') OR host = 'therha.example.com'"
    " OR ends_with(host, '.therha.example.com'))"
)


def plain(sql: str) -> str:
    """Text of an HTML fragment in SQL: tags off, the entities of the test pages read."""
    bare = rf"regexp_replace({sql}, '<[^>]*>', '', 'g')"
    for entity, sign in (("quot", "'\"'"), ("copy", "chr(169)"), ("middot", "chr(183)")):
        bare = f"replace({bare}, '&{entity};', {sign})"
    # A page may end an entity without its semicolon.
    return f"regexp_replace({bare}, '&amp;?', '&', 'g')"


TITLE = f"trim({plain(chr(39).join(['regexp_extract(html, ', '(?s)<title>(.*?)</title>', ', 1)']))})"
PARTS = rf"""parts AS (
    SELECT page_id, url, html, {TITLE} AS title,
        regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1) AS article,
        regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages),
texts AS (
    SELECT *, {plain("regexp_extract(article, '(?s)<h1>(.*?)</h1>', 1)")} AS h1,
        list_filter(list_transform(string_split(article, '<p>')[2:],
            lambda x: trim({plain("split_part(x, '</p>', 1)")})), lambda x: x <> '') AS paragraphs,
        list_filter(list_transform(regexp_split_to_array(article, '<[^>]*>'),
            lambda x: trim({plain("x")})), lambda x: x <> '') AS pieces,
        list_transform(regexp_extract_all(nav, '(?s)<li>(.*?)</li>', 1), lambda x: trim({plain("x")})) AS items,
        regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 1) AS hrefs,
        list_transform(regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 2), lambda x: trim({plain("x")})) AS anchors
    FROM parts),
read_pages AS (
    SELECT *, trim(regexp_replace(regexp_replace(title || chr(10) || chr(10) || trim(h1) || chr(10)
        || array_to_string(list_transform(paragraphs, lambda x: x || chr(10) || chr(10)), ''),
        '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), ' ' || chr(10)) AS content,
        array_to_string(pieces, '') AS main_text
    FROM texts)"""


def pages(spark, d):
    return table(spark, d, "pages")


@query(
    "allowed_pages",
    f"SELECT page_id, url FROM (SELECT *, {HOST} AS host FROM pages) WHERE {ALLOWED}",
)
def allowed_pages(spark, d):
    return p.allowed_pages(pages(spark, d), DOMAINS).select("page_id", "url")


@query("allowed_pages_empty_list", "SELECT page_id, url FROM pages")
def allowed_pages_empty_list(spark, d):
    return p.allowed_pages(pages(spark, d), []).select("page_id", "url")


@query(
    "blocked_pages",
    f"""SELECT page_id, url, 'Access Error' AS title, 'This domain is not in the allowed domains list.' AS content,
        '' AS html, 403 AS status_code, 'Domain not allowed' AS error, false AS fetch_success
        FROM (SELECT *, {HOST} AS host FROM pages) WHERE NOT {ALLOWED}""",
)
def blocked_pages(spark, d):
    return p.blocked_pages(pages(spark, d), DOMAINS)


@query(
    "domain_list_diff",
    f"""WITH h AS (SELECT DISTINCT {HOST} AS domain FROM pages)
        SELECT domain FROM (SELECT domain FROM h UNION SELECT regexp_replace(domain, '^www\\.', '') FROM h)
        WHERE domain NOT IN (SELECT domain FROM h WHERE starts_with(domain, 'www.'))""",
)
def domain_list_diff(spark, d):
    hosts = pages(spark, d).select(t.url_host(F.col("url")).alias("domain")).distinct()
    bare = hosts.select(F.regexp_replace("domain", r"^www\.", "").alias("domain"))
    return p.domain_list_diff(hosts, bare, hosts.filter(F.col("domain").startswith("www.")))


@query(
    "parse_pages",
    f"""WITH {PARTS} SELECT page_id, url, title, content, main_text, CASE WHEN trim(h1) = '' THEN 0 ELSE 1 END AS headings,
        1 AS lists, len(items) AS items, 0 AS tables, len(hrefs) AS links, 0 AS dates FROM read_pages""",
)
def parse_pages(spark, d):
    parsed = p.parse_pages(pages(spark, d))
    return parsed.select(
        "page_id", "url", "title", "content", "main_text",
        F.size("headings").alias("headings"), F.size("lists").alias("lists"),
        F.size(F.flatten("lists.items")).alias("items"), F.size("tables").alias("tables"),
        F.size("links").alias("links"), F.size("extracted_dates").alias("dates"),
    )


@query("page_title", f"WITH {PARTS} SELECT page_id, title FROM parts")
def page_title(spark, d):
    return p.page_title(pages(spark, d))


@query("page_text", f"WITH {PARTS} SELECT page_id, content FROM read_pages")
def page_text(spark, d):
    return p.page_text(pages(spark, d))


@query(
    "page_links",
    f"""WITH {PARTS} SELECT page_id, unnest(anchors) AS text, generate_subscripts(hrefs, 1) - 1 AS pos,
        regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || unnest(hrefs) AS url FROM texts""",
)
def page_links(spark, d):
    return p.page_links(pages(spark, d))


@query(
    "page_headings",
    f"WITH {PARTS} SELECT page_id, 0 AS pos, 1 AS level, trim(h1) AS text FROM texts WHERE contains(html, '<h1>')",
)
def page_headings(spark, d):
    return p.page_headings(pages(spark, d))


@query(
    "page_lists",
    f"WITH {PARTS} SELECT page_id, 0 AS list_no, 'ul' AS type, array_to_string(items, '|') AS items FROM texts",
)
def page_lists(spark, d):
    found = p.page_lists(pages(spark, d))
    return found.withColumn("items", F.array_join("items", "|"))


@query(
    "page_tables",
    """WITH r AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL),
        rows AS (SELECT source, list({'lang': lang, 'n': n} ORDER BY lang) AS l FROM r GROUP BY 1)
        SELECT source AS page_id, 0 AS table_no, 'lang|n' AS headers, 0 AS row_no, 'lang|n' AS cells FROM rows
        UNION ALL
        SELECT source, 0, 'lang|n', generate_subscripts(l, 1), unnest(list_transform(l, lambda x: x.lang || '|' || x.n)) FROM rows""",
)
def page_tables(spark, d):
    counts = table(spark, d, "documents").groupBy("source", "lang").count()
    row = F.format_string("<tr><td>%s</td><td> %d </td></tr>", "lang", "count")
    head = F.lit("<table><thead><tr><th>lang</th><th>n</th></tr></thead>")
    # One row per language, so a source's list is as short as the list of languages.
    html = counts.groupBy(F.col("source").alias("page_id")).agg(
        F.concat(head, F.array_join(F.sort_array(F.collect_list(row)), ""), F.lit("<tr></tr></table>")).alias("html")
    )
    found = p.page_tables(html)
    return found.withColumn("headers", F.array_join("headers", "|")).withColumn("cells", F.array_join("cells", "|"))


@query("page_main_text", f"WITH {PARTS} SELECT page_id, main_text FROM read_pages")
def page_main_text(spark, d):
    return p.page_main_text(pages(spark, d))


@query(
    "page_dates",
    """SELECT page_id, 0 AS pos, strftime(DATE '2024-01-01' + (page_id % 366)::int, '%B %-d, %Y') AS mention,
        strftime(DATE '2024-01-01' + (page_id % 366)::int, '%Y-%m-%d') AS day FROM pages WHERE contains(html, '<article>')""",
)
def page_dates(spark, d):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")), "MMMM d, yyyy")
    dated = F.replace("html", F.lit("<article>"), F.concat(F.lit("<article><p>Posted "), day, F.lit(".</p>")))
    found = p.page_dates(pages(spark, d).withColumn("html", dated))
    return found.select("page_id", "pos", "mention", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query("select_text", f"WITH {PARTS} SELECT page_id, array_to_string(anchors, chr(10)) AS text FROM texts")
def select_text(spark, d):
    return p.select_text(pages(spark, d), "nav li > a[href*='/']")


@query(
    "analyze_pages",
    f"""WITH {PARTS} SELECT page_id, url, starts_with(url, 'https') AS success,
        CASE WHEN NOT starts_with(url, 'https') THEN 'Connection error' END AS error,
        CASE WHEN starts_with(url, 'https') THEN title ELSE 'Access Error' END AS title,
        CASE WHEN starts_with(url, 'https') THEN main_text END AS main_content,
        CASE WHEN starts_with(url, 'https') THEN CASE WHEN trim(h1) = '' THEN 0 ELSE 1 END END AS headings FROM read_pages""",
)
def analyze_pages(spark, d):
    ok = F.col("url").startswith("https")
    fetched = pages(spark, d).select(
        "page_id", "url", F.when(ok, F.col("html")).alias("html"), ok.alias("fetch_success"),
        F.when(~ok, F.lit("Connection error")).alias("error"),
    )
    return p.analyze_pages(fetched).select(
        "page_id", "url", "success", "error", "title", "main_content",
        F.when(F.col("success"), F.size("structure.headings")).alias("headings"),
    )


# Attempts: every user's events are the attempts at one URL; the kind of event is the answer.
@query(
    "fetch_outcomes",
    """WITH log AS (SELECT 'https://host/' || user_id || '/' || strftime(ts, '%Y%m%d') AS url, event_id AS attempt,
            CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 503 WHEN 'error' THEN 404 WHEN 'signup' THEN 429 END AS status,
            CASE event_type WHEN 'purchase' THEN 'Timeout' END AS error_type FROM events),
        kinds AS (SELECT *, CASE WHEN status = 200 THEN 'ok' WHEN status IN (403, 429, 503) OR error_type IN ('ConnectionError', 'Timeout')
            THEN 'retryable' ELSE 'final' END AS kind FROM log),
        ends AS (SELECT url, min(attempt) AS end_attempt FROM kinds WHERE kind <> 'retryable' GROUP BY 1),
        per AS (SELECT url, count(*) AS attempts, count(*) FILTER (kind = 'retryable') AS retryable, max(end_attempt) AS end_attempt,
            max(attempt) AS last_attempt FROM kinds LEFT JOIN ends USING (url) WHERE end_attempt IS NULL OR attempt <= end_attempt GROUP BY 1)
        SELECT per.url, attempts, retryable, k.status AS status,
            CASE WHEN end_attempt IS NOT NULL THEN k.kind WHEN retryable >= 3 THEN 'exhausted' ELSE 'pending' END AS outcome
        FROM per JOIN kinds k ON k.attempt = coalesce(end_attempt, last_attempt)""",
)
def fetch_outcomes(spark, d):
    kind = F.col("event_type")
    log = table(spark, d, "events").select(
        F.concat(F.lit("https://host/"), F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyyMMdd")).alias("url"),
        F.col("event_id").alias("attempt"),
        F.when(kind == "click", 200).when(kind == "view", 503).when(kind == "error", 404).when(kind == "signup", 429).alias("status"),
        F.when(kind == "purchase", F.lit("Timeout")).alias("error_type"),
    )
    return p.fetch_outcomes(log)


# Every event stores the page of its user; all users and as many unknown ones ask for theirs.
@query(
    "cached_pages",
    """WITH newest AS (SELECT user_id, max(ts) AS ts, max_by(event_id, ts) AS page FROM events
            WHERE TIMESTAMP '2024-01-20 12:00:00' - ts <= INTERVAL 24 HOUR GROUP BY 1),
        asked AS (SELECT DISTINCT user_id FROM events UNION SELECT DISTINCT user_id + 1000000 FROM events)
        SELECT 'https://host/' || a.user_id AS url, n.page AS page, n.page IS NOT NULL AS hit FROM asked a LEFT JOIN newest n USING (user_id)""",
)
def cached_pages(spark, d):
    now = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    events = table(spark, d, "events")
    users = table(spark, d, "events").select("user_id").distinct()

    def url(user):
        return F.concat(F.lit("https://host/"), user.cast("string"))

    cache = events.select(
        t.cache_key(url(F.col("user_id"))).alias("cache_key"), F.col("ts").alias("cached_at"), F.col("event_id").alias("page")
    )
    asked = users.union(users.select(F.col("user_id") + 1000000)).select(url(F.col("user_id")).alias("url"))
    return p.cached_pages(asked, cache, now).select("url", "page", "hit")


RESULTS = "(SELECT conv_id AS query_id, turn AS rank, 'https://h/' || md5(text) AS url, role FROM conversations)"


@query(
    "frontier",
    f"""WITH top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, url) AS place FROM {RESULTS})
        SELECT query_id, place, url FROM top WHERE place <= 2
        AND url NOT IN (SELECT url FROM {RESULTS} WHERE role = 'assistant')""",
)
def frontier(spark, d):
    results = table(spark, d, "conversations").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.concat(F.lit("https://h/"), F.md5("text")).alias("url"), "role"
    )
    return p.frontier(results, results.filter(F.col("role") == "assistant"))


def registry_of(docs):
    """A registry made from the documents table; ids are content hashes."""
    number = F.col("doc_id").cast("string")
    return docs.select(
        t.content_id(F.col("text")).alias("id"),
        F.concat(F.lit("Doc_"), number, F.lit(".TXT")).alias("filename"),
        F.concat(F.lit("/data/"), F.col("source"), F.lit("/Doc_"), number, F.lit(".TXT")).alias("path"),
        F.lit("txt").alias("type"),
        F.lit(None).cast("string").alias("title"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("created_at"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("last_modified"),
    )


@query(
    "resolve_sources",
    """WITH refs AS (SELECT 'https://x.org/a/doc_' || doc_id || '.txt' AS ref FROM documents
            UNION ALL SELECT 'file:///old/DOC_' || doc_id || '.txt' FROM labels
            UNION ALL SELECT 'notes/other_' || doc_id || '.txt' FROM labels UNION ALL SELECT url FROM pages),
        named AS (SELECT ref, regexp_matches(ref, '^(https?|ftp)://') AS remote,
            CASE WHEN regexp_matches(ref, '^(https?|ftp)://') AND NOT regexp_matches(ref, '/[^/]+\\.(txt|pdf|md|json|csv|docx?)$')
                THEN NULL ELSE lower(regexp_extract(ref, '([^/]+)$', 1)) END AS name FROM refs),
        reg AS (SELECT lower('Doc_' || doc_id || '.TXT') AS name, '/data/' || source || '/Doc_' || doc_id || '.TXT' AS known FROM documents)
        SELECT ref, CASE WHEN NOT remote OR known IS NOT NULL THEN 'file' ELSE 'web' END AS kind,
            CASE WHEN NOT remote OR known IS NOT NULL THEN coalesce(known, regexp_replace(ref, '^file://', '')) ELSE ref END AS path
        FROM named LEFT JOIN reg USING (name)""",
)
def resolve_sources(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")

    def refs(df, before, after=".txt"):
        return df.select(F.concat(F.lit(before), F.col("doc_id").cast("string"), F.lit(after)).alias("ref"))

    asked = refs(docs, "https://x.org/a/doc_").union(refs(labels, "file:///old/DOC_")).union(refs(labels, "notes/other_"))
    return p.resolve_sources(asked.union(pages(spark, d).select("url")), registry_of(docs))


@query(
    "documents_as_pages",
    """WITH paths AS (SELECT '/data/' || doc_id || '.txt' AS path FROM documents UNION ALL
            SELECT '/gone/' || doc_id || '.txt' FROM labels),
        docs AS (SELECT '/data/' || doc_id || '.txt' AS path, text, n_chars FROM documents)
        SELECT path, 'file://' || path AS url, regexp_extract(path, '([^/]+)$', 1) AS title,
            coalesce(text, '[Document not found: ' || path || ']') AS content, n_chars AS size_bytes
        FROM paths LEFT JOIN docs USING (path)""",
)
def documents_as_pages(spark, d):
    def path(before):
        return F.concat(F.lit(before), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path")

    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    held = docs.select(
        path("/data/"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "text",
        F.col("n_chars").alias("size_bytes"), F.lit(None).cast("timestamp").alias("last_modified"),
    )
    asked = docs.select(path("/data/")).union(labels.select(path("/gone/")))
    return p.documents_as_pages(asked, held).select("path", "url", "title", "content", "size_bytes")


# Two pages in three were fetched; they are stored, and all of them are asked for.
@query(
    "store_pages",
    """WITH kept AS (SELECT url, max(length(html)) AS size FROM pages WHERE page_id % 3 <> 0 GROUP BY 1)
        SELECT p.url, k.size AS size, k.size IS NOT NULL AS hit FROM (SELECT DISTINCT url FROM pages) p LEFT JOIN kept k USING (url)""",
)
def store_pages(spark, d):
    now, path = F.lit("2024-01-20 12:00:00").cast("timestamp"), scratch(spark)
    fetched = table(spark, d, "pages").withColumn("fetch_success", F.when(F.col("page_id") % 3 != 0, True))
    p.store_pages(fetched.withColumn("size", F.length("html").cast("bigint")), path, now, "size")
    cache = spark.read.parquet(path).groupBy("cache_key").agg(F.max("cached_at").alias("cached_at"), F.max("page").alias("page"))
    found = p.cached_pages(fetched.select("url").distinct(), cache, now)
    return found.select("url", F.col("page").alias("size"), "hit")
