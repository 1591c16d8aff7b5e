"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import query, table
from marginalia.functions import text as t

# White space as Python's str.strip() sees it, spelled for DuckDB.
DUCK_SPACE = (
    "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)"
)
# Extensions handed out by doc_id; each gives a language.
EXTENSIONS = ["py", "js", "ts", "jsx", "tsx", "java", "c", "cpp", "h", "cs", "go", "rb", "kt", "rs", "sh", "sql"]


def extension():
    return F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS)).cast("int"))


DUCK_EXTENSION = "[" + ",".join(f"'{e}'" for e in EXTENSIONS) + f"][(doc_id % {len(EXTENSIONS)})::int + 1]"
# The names of languages.
DUCK_LANGUAGE = (
    f"CASE {DUCK_EXTENSION} WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript'"
    " WHEN 'jsx' THEN 'javascript react' WHEN 'tsx' THEN 'typescript react' WHEN 'cpp' THEN 'c++'"
    " WHEN 'h' THEN 'c/c++ header' WHEN 'cs' THEN 'c#' WHEN 'rb' THEN 'ruby' WHEN 'kt' THEN 'kotlin'"
    f" WHEN 'rs' THEN 'rust' WHEN 'sh' THEN 'shell/bash' ELSE {DUCK_EXTENSION} END"
)


def documents(spark, d):
    return table(spark, d, "documents")


@query(
    "content_id",
    "SELECT sha256(text) AS id, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1",
)
def content_id(spark, d):
    ids = documents(spark, d).select(t.content_id(F.col("text")).alias("id"), "doc_id")
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


@query(
    "clean_extracted_text",
    r"""SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'),
        '([\pL\pN_])-\s+([\pL\pN_]+)', '\1\2', 'g') AS text FROM documents""",
)
def clean_extracted_text(spark, d):
    return documents(spark, d).select("doc_id", t.clean_extracted_text(F.col("text")).alias("text"))


@query("language_of", f"SELECT doc_id, {DUCK_LANGUAGE} AS language FROM documents")
def language_of(spark, d):
    return documents(spark, d).select("doc_id", t.language_of(extension()).alias("language"))


@query(
    "code_metadata",
    f"""SELECT doc_id, {DUCK_LANGUAGE} AS language, 'd' || doc_id || '.' || {DUCK_EXTENSION} AS filename,
        len(string_split(text, chr(10))) AS line_count, strlen(text) AS file_size_bytes,
        'code' AS content_type FROM documents""",
)
def code_metadata(spark, d):
    path = F.concat(F.lit("/src/d"), F.col("doc_id").cast("string"), F.lit("."), extension())
    return t.code_metadata(documents(spark, d).withColumn("path", path)).select(
        "doc_id", "language", "filename", "line_count", "file_size_bytes", "content_type"
    )


@query(
    "code_imports",
    rf"""WITH src AS (SELECT doc_id, {DUCK_LANGUAGE} AS language,
            list_transform(string_split(regexp_replace(text, '(?m)^([A-Z])', 'import \1', 'g'), chr(10)),
                lambda x: trim(x, {DUCK_SPACE})) AS lines FROM documents)
        SELECT doc_id, language, array_to_string(list_filter(lines, lambda x: starts_with(x, 'import '))[1:10], chr(10))
            AS imports
        FROM src WHERE language IN ('python','javascript','typescript','javascript react','typescript react','java','kotlin')
            AND len(list_filter(lines, lambda x: starts_with(x, 'import '))) > 0""",
)
def code_imports(spark, d):
    source = documents(spark, d).select(
        "doc_id",
        t.language_of(extension()).alias("language"),
        F.regexp_replace("text", r"(?m)^([A-Z])", "import $1").alias("text"),
    )
    found = t.code_imports(source).filter(F.col("imports").isNotNull())
    return found.select("doc_id", "language", F.array_join("imports", "\n").alias("imports"))


@query(
    "markdown_headings",
    rf"""WITH src AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '(?m)^(T)', '## \1', 'g'),
            '(?m)^(#+)\s+(.+)$', 0) AS found FROM documents),
        flat AS (SELECT doc_id, unnest(found) AS h, generate_subscripts(found, 1) - 1 AS pos FROM src)
        SELECT doc_id, pos, len(regexp_extract(h, '^(#+)', 1)) AS level,
            trim(regexp_extract(h, '^(#+)\s+(.+)$', 2), {DUCK_SPACE}) AS heading FROM flat""",
)
def markdown_headings(spark, d):
    marked = documents(spark, d).select("doc_id", F.regexp_replace("text", r"(?m)^(T)", "## $1").alias("text"))
    return t.markdown_headings(marked)


@query(
    "date_mentions",
    r"""WITH src AS (SELECT doc_id, regexp_extract_all(text || ' Seen on '
                || strftime(DATE '2024-01-01' + (doc_id % 366)::int, '%B %-d, %Y') || '.',
            '\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4}\b',
            0) AS found FROM documents),
        flat AS (SELECT doc_id, unnest(found) AS mention, generate_subscripts(found, 1) - 1 AS pos FROM src)
        SELECT doc_id, pos, mention,
            strftime(strptime(regexp_replace(mention, '\s+', ' ', 'g'), '%B %d, %Y'), '%Y-%m-%d') AS day FROM flat""",
)
def date_mentions(spark, d):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int")), "MMMM d, yyyy")
    dated = documents(spark, d).select("doc_id", F.concat("text", F.lit(" Seen on "), day, F.lit(".")).alias("text"))
    found = t.date_mentions(dated)
    return found.select("doc_id", "pos", "mention", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query(
    "collapse_blank",
    rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\n{{3,}}', chr(10)||chr(10), 'g'), ' {{2,}}', ' ', 'g'),
        {DUCK_SPACE}) AS text FROM documents""",
)
def collapse_blank(spark, d):
    return documents(spark, d).select("doc_id", t.collapse_blank(F.col("text")).alias("text"))


@query(
    "slug",
    r"""SELECT doc_id, left(regexp_replace(regexp_replace(lower(text), '[^\pL\pN_\s-]', '', 'g'),
        '[\s-]+', '_', 'g'), 50) AS slug FROM documents""",
)
def slug(spark, d):
    return documents(spark, d).select("doc_id", t.slug(F.col("text")).alias("slug"))


@query(
    "clip",
    "SELECT doc_id, CASE WHEN length(text) > 1000 THEN left(text, 1000) || '...' ELSE text END AS text FROM documents",
)
def clip(spark, d):
    return documents(spark, d).select("doc_id", t.clip(F.col("text"), 1000).alias("text"))


@query("cap_query", "SELECT item_id, left(text, 500) AS query FROM benchmark")
def cap_query(spark, d):
    return table(spark, d, "benchmark").select("item_id", t.cap_query(F.col("text")).alias("query"))


# The kind of an event says what is wrong with the reply made from it.
@query(
    "repair_json",
    """SELECT event_id, CASE event_type WHEN 'error' THEN '{}'
        ELSE replace(CASE event_type WHEN 'view' THEN '{"items":[' || props || ',' || props || ']}' ELSE props END, ' ', '')
        END AS reply FROM events""",
)
def repair_json(spark, d):
    props, kind = F.col("props"), F.col("event_type")
    raw = (
        F.when(kind == "click", F.concat(F.lit("```json\n"), props, F.lit("\n```")))
        .when(kind == "view", F.concat(F.lit('{"items": ['), props, F.lit(" "), props, F.lit(",]}")))
        .when(kind == "signup", F.regexp_replace(props, "}", ",}"))
        .when(kind == "purchase", F.concat(props, F.lit(" that is all")))
        .otherwise(F.concat(F.lit("not JSON "), props))
    )
    return table(spark, d, "events").select("event_id", F.to_json(t.repair_json(raw)).alias("reply"))


@query(
    "token_estimate",
    r"""SELECT doc_id, round(len(regexp_extract_all(text, '\S+')) * 1.3::DOUBLE, 4) AS tokens FROM documents""",
)
def token_estimate(spark, d):
    return documents(spark, d).select("doc_id", F.round(t.token_estimate(F.col("text")), 4).alias("tokens"))


@query(
    "shift_timestamps",
    """SELECT event_id, strftime(ts - INTERVAL 371 DAY, '%Y-%m-%d %H:%M:%S.%f') AS corrected FROM events""",
)
def shift_timestamps(spark, d):
    shifted = t.shift_timestamps(table(spark, d, "events"), "ts", years=1, days=6)
    return shifted.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("corrected"))


@query(
    "cache_key",
    "SELECT page_id, 'page_' || md5(url) || '.json' AS page_key, 'search_' || md5(url) || '.json' AS search_key FROM pages",
)
def cache_key(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", t.cache_key(url).alias("page_key"), t.cache_key(url, is_search=True).alias("search_key")
    )


@query(
    "short_id",
    """SELECT doc_id, left(sha256(text), 8) || '...' AS listed,
        left(sha256(text), 8) || '...' || right(sha256(text), 8) AS found, left(lang, 8) AS short_found FROM documents""",
)
def short_id(spark, d):
    ident = t.content_id(F.col("text"))
    return documents(spark, d).select(
        "doc_id", t.short_id(ident).alias("listed"), t.hit_id(ident).alias("found"), t.hit_id(F.col("lang")).alias("short_found")
    )


@query("size_kb", "SELECT doc_id, printf('%.1f KB', strlen(text) / 1024.0::DOUBLE) AS size FROM documents")
def size_kb(spark, d):
    return documents(spark, d).select("doc_id", t.size_kb(F.octet_length("text")).alias("size"))


DUCK_MASK = """CASE WHEN length({0}) > 8 THEN left({0}, 4) || repeat('*', (length({0}) - 8)::int) || right({0}, 4)
    ELSE repeat('*', length({0})::int) END"""


@query(
    "mask_secret",
    f"SELECT doc_id, {DUCK_MASK.format('text')} AS masked, {DUCK_MASK.format('source')} AS short_masked FROM documents",
)
def mask_secret(spark, d):
    return documents(spark, d).select(
        "doc_id", t.mask_secret(F.col("text")).alias("masked"), t.mask_secret(F.col("source")).alias("short_masked")
    )


@query("url_host", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages")
def url_host(spark, d):
    return table(spark, d, "pages").select("page_id", t.url_host(F.col("url")).alias("host"))


@query(
    "display_score",
    """SELECT vec_id, round(1.0::DOUBLE - list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 4) AS score
        FROM embeddings""",
)
def display_score(spark, d):
    length = F.aggregate(F.transform("embedding", lambda x: F.abs(x.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "embeddings").select("vec_id", t.display_score(length).alias("score"))
