"""Chunks, vectors, search and the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import query, scratch, table
from checks.pages import PARTS, registry_of
from marginalia.operators import chunks as c
from marginalia.operators import library as lib
from marginalia.operators import probes as pr
from marginalia.operators import ranking as r
from marginalia.operators import vectors as v
from marginalia.plans import indexing as ix
from marginalia.sources import files as fs
from marginalia.sources import summaries as su
from marginalia.sources import tables as tb

REGISTRY = """registry AS (SELECT sha256(text) AS id, 'Doc_' || doc_id || '.TXT' AS filename,
    '/data/' || source || '/Doc_' || doc_id || '.TXT' AS path, doc_id AS n, strlen(text) AS size_bytes, text, lang, source
    FROM documents)"""
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def pieces(level: int, mark: str, source: str) -> str:
    """Pieces of the long texts of the level above, numbered; a mark stays at the head of its piece.

    ``run`` counts the long pieces before a piece: short ones with the same count are packed together.
    """
    above = ", ".join(f"i{n}" for n in range(1, level))
    keys = f"doc_id, {above}" if above else "doc_id"
    return f"""c{level} AS (SELECT {keys}, unnest(string_split(text, {mark})) AS piece, generate_subscripts(string_split(text, {mark}), 1) AS i{level}
            FROM {source}),
        p{level} AS (SELECT * REPLACE (CASE WHEN i{level} > 1 THEN {mark} ELSE '' END || piece AS piece) FROM c{level}),
        l{level} AS (SELECT *, length(piece) >= 1000 AS long, count(*) FILTER (length(piece) >= 1000) OVER
            (PARTITION BY {keys} ORDER BY i{level}) AS run FROM p{level} WHERE piece <> '')"""


CHUNKS = f"""WITH RECURSIVE {pieces(1, "chr(10)", "documents")},
        t1 AS (SELECT doc_id, i1, piece AS text FROM l1 WHERE long),
        {pieces(2, "'. '", "t1")},
        t2 AS (SELECT doc_id, i1, i2, piece AS text FROM l2 WHERE long),
        {pieces(3, "' '", "t2")},
        atoms AS (SELECT doc_id, 0 AS a1, 0 AS a2, run, i1, 0 AS i2, 0 AS i3, piece FROM l1 WHERE NOT long
            UNION ALL SELECT doc_id, i1, 0, run, i1, i2, 0, piece FROM l2 WHERE NOT long
            UNION ALL SELECT doc_id, i1, i2, run, i1, i2, i3, piece FROM l3 WHERE NOT long),
        numbered AS (SELECT *, dense_rank() OVER (ORDER BY doc_id, a1, a2, run) AS r, row_number() OVER w AS n,
            sum(length(piece)) OVER w AS upto FROM atoms WINDOW w AS (PARTITION BY doc_id, a1, a2, run ORDER BY i1, i2, i3)),
        packed AS (SELECT r, 1::bigint AS a FROM numbered GROUP BY r
            UNION ALL
            SELECT r, next FROM (
                SELECT e.r, (SELECT min(x.n) FROM numbered x JOIN numbered stop ON stop.r = x.r AND stop.n = e.b
                        WHERE x.r = e.r AND x.n >= e.a AND (x.n = e.b OR (stop.upto - length(stop.piece) - (x.upto - length(x.piece)) <= 200
                            AND stop.upto - (x.upto - length(x.piece)) <= 1000))) AS next
                FROM (SELECT p.r, p.a, (SELECT min(y.n) FROM numbered y JOIN numbered s ON s.r = y.r AND s.n = p.a
                        WHERE y.r = p.r AND y.n > p.a AND y.upto - (s.upto - length(s.piece)) > 1000) AS b FROM packed p) e
                WHERE e.b IS NOT NULL)),
        ends AS (SELECT p.r, p.a, min(y.n) AS b FROM packed p JOIN numbered s ON s.r = p.r AND s.n = p.a
            LEFT JOIN numbered y ON y.r = p.r AND y.n > p.a AND y.upto - (s.upto - length(s.piece)) > 1000 GROUP BY 1, 2),
        chunks AS (SELECT any_value(x.doc_id) AS doc_id, min((x.i1, x.i2, x.i3)) AS place, e.a,
            trim(string_agg(x.piece, '' ORDER BY x.n), {SPACE}) AS text
            FROM ends e JOIN numbered x ON x.r = e.r AND x.n >= e.a AND (e.b IS NULL OR x.n < e.b) GROUP BY e.r, e.a)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS chunk_no, text FROM chunks WHERE text <> ''"""


# The SQL knows three of the separators: the texts have no blank lines, and no word of 1000 letters.
@query("chunk_documents", CHUNKS)
def chunk_documents(spark, d):
    return c.chunk_documents(docs(spark, d))


@query(
    "chunk_fixed",
    f"""WITH w AS (SELECT doc_id, list_filter(list_transform(range(0, greatest(length(text) - 200, 1)::bigint, 800),
            lambda a: trim(substring(text, (a + 1)::bigint, 1000), {SPACE})), lambda x: x <> '') AS w FROM documents)
        SELECT doc_id, generate_subscripts(w, 1) - 1 AS chunk_no, unnest(w) AS text FROM w""",
)
def chunk_fixed(spark, d):
    return c.chunk_fixed(docs(spark, d))


def embedded(source: str, key: str) -> str:
    """CTE ``vectors``: non-zero weights of the texts of ``source`` by place, as stored in single precision."""
    return rf"""places AS (SELECT {key}, ('0x' || left(md5(w), 7))::bigint % 256 AS place FROM (
            SELECT {key}, unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS w FROM {source})),
        weights AS (SELECT {key}, place, 1 + ln(count(*)) AS weight FROM places GROUP BY 1, 2),
        vectors AS (SELECT {key}, place, (weight / sqrt(sum(weight * weight) OVER (PARTITION BY {key})))::float::double AS weight FROM weights)"""


@query(
    "embed_text",
    f"""WITH {embedded("documents", "doc_id")} SELECT doc_id, place, round(weight, 5) AS weight FROM vectors
        UNION ALL SELECT doc_id, -1, round(sum(weight * weight), 5) FROM vectors GROUP BY 1""",
)
def embed_text(spark, d):
    vectors = v.embed_text(docs(spark, d), "text")
    cells = vectors.select("doc_id", F.posexplode("vector").alias("place", "weight")).filter("weight > 0")
    cells = cells.withColumns({"place": F.col("place").cast("bigint"), "weight": F.col("weight").cast("double")})
    length = cells.groupBy("doc_id").agg(F.lit(-1).cast("bigint").alias("place"), F.sum(F.col("weight") * F.col("weight")).alias("weight"))
    return cells.unionByName(length).withColumn("weight", F.round("weight", 5))


def letter_counts(texts):
    """A stand-in for a model server: five letter counts."""
    return [[float(text.count(letter)) for letter in "aeiou"] for text in texts]


@query(
    "embed_text_function",
    """SELECT doc_id, list_transform(['a','e','i','o','u'],
        lambda x: (length(text) - length(replace(text, x, '')))::double)::varchar AS vector FROM documents""",
)
def embed_text_function(spark, d):
    vectors = v.embed_text(docs(spark, d), "text", letter_counts)
    shown = F.concat(F.lit("["), F.array_join(F.col("vector").cast("array<double>").cast("array<string>"), ", "), F.lit("]"))
    return vectors.select("doc_id", shown.alias("vector"))


def embeddings(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


TOPK = """WITH d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_sum(list_transform(list_zip(q.embedding, e.embedding),
        lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) AS score FROM embeddings q, embeddings e),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM d)
    SELECT query_id, rank, id, round(score, 6) AS score FROM k WHERE rank <= 5"""


@query("search_topk", TOPK)
def search_topk(spark, d):
    vectors = embeddings(spark, d)
    found = v.search_topk(vectors.withColumnRenamed("id", "query_id"), vectors)
    return found.withColumn("score", F.round("score", 6))


APPROX = {"bucket_length": 0.15, "tables": 8, "projections": 4, "probes": 24, "seed": 42}


def approx_sql(bucket_length: float, tables: int, projections: int, probes: int, seed: int, width: int = 64) -> str:
    """Top-k of the pairs whose query looks into the bucket; exact for queries with fewer."""
    lines = [
        f"({t}, {i}, [" + ", ".join(f"{x!r}::double" for x in column) + "])"
        for t, grid in enumerate((pr.directions(width, tables, projections, seed) / bucket_length).tolist())
        for i, column in enumerate(zip(*grid))
    ]
    steps = ", ".join(f"(VALUES (-1), (0), (1)) AS s{i}(x{i})" for i in range(projections))
    cost = " + ".join(f"CASE x{i} WHEN -1 THEN (p[{i + 1}] - floor(p[{i + 1}])) ** 2 WHEN 1 THEN (1 - p[{i + 1}] + floor(p[{i + 1}])) ** 2 ELSE 0 END" for i in range(projections))
    moved = ", ".join(f"floor(p[{i + 1}]) + x{i}" for i in range(projections))
    return f"""WITH g(t, i, along) AS (VALUES {", ".join(lines)}),
        p AS MATERIALIZED (SELECT vec_id, t, list(list_sum(list_transform(list_zip(embedding, along), lambda z: z[1]::double * z[2])) ORDER BY i) AS p
            FROM embeddings, g GROUP BY ALL),
        looked AS (SELECT vec_id, t, [{moved}] AS cell, row_number() OVER (PARTITION BY vec_id, t ORDER BY {cost}) AS n FROM p, {steps}),
        own AS (SELECT vec_id, t, list_transform(p, lambda x: floor(x)) AS cell FROM p),
        met AS MATERIALIZED (SELECT DISTINCT a.vec_id AS query_id, o.vec_id AS id FROM looked a JOIN own o ON a.t = o.t AND a.cell = o.cell WHERE n <= {probes}),
        n AS (SELECT e.vec_id AS query_id, count(met.id) AS n FROM embeddings e LEFT JOIN met ON met.query_id = e.vec_id GROUP BY 1),
        d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_sum(list_transform(list_zip(q.embedding, e.embedding),
            lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) AS score
            FROM embeddings q JOIN n ON n.query_id = q.vec_id CROSS JOIN embeddings e LEFT JOIN met ON met.query_id = q.vec_id AND met.id = e.vec_id
            WHERE met.id IS NOT NULL OR n < 5),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM d)
        SELECT query_id, rank, id, round(score, 6) AS score FROM k WHERE rank <= 5"""


@query("search_topk_approx", approx_sql(**APPROX))
def search_topk_approx(spark, d):
    vectors = embeddings(spark, d)
    found = pr.search_topk_approx(vectors.withColumnRenamed("id", "query_id"), vectors, **APPROX)
    return found.withColumn("score", F.round("score", 6))


# Chunks and questions as hashed words, weighted by how rare a place is among the chunks; single precision as stored.
SEARCHED = rf"""WITH chunks AS MATERIALIZED (SELECT sha256(d.text) || '-0-' || chunk_no AS chunk_id, min(doc_id) AS doc_id, chunk_no,
            any_value(c.text) AS text, arg_min(source, doc_id) AS source FROM ({CHUNKS}) c JOIN documents d USING (doc_id) GROUP BY d.text, chunk_no),
        texts AS (SELECT chunk_id AS key, true AS chunk, text FROM chunks UNION ALL SELECT item_id::varchar, false, text FROM benchmark),
        placed AS (SELECT key, chunk, ('0x' || left(md5(w), 7))::bigint % 256 AS place FROM (
            SELECT key, chunk, unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS w FROM texts)),
        counted AS (SELECT key, chunk, place, 1 + ln(count(*)) AS weight FROM placed GROUP BY ALL),
        plain AS MATERIALIZED (SELECT key, chunk, place, (weight / sqrt(sum(weight * weight) OVER (PARTITION BY key, chunk)))::float::double AS weight FROM counted),
        rare AS (SELECT place, 1 + ln((1 + any_value(n))::double / (1 + count(*))) AS idf
            FROM plain, (SELECT count(*) AS n FROM chunks) WHERE chunk GROUP BY place),
        rated AS (SELECT key, chunk, place, weight * coalesce(idf, 1 + ln((1 + n)::double)) AS weight FROM plain LEFT JOIN rare USING (place), (SELECT count(*) AS n FROM chunks)),
        vectors AS MATERIALIZED (SELECT key, chunk, place, (weight / sqrt(sum(weight * weight) OVER (PARTITION BY key, chunk)))::float::double AS weight FROM rated),
        sizes AS MATERIALIZED (SELECT key, chunk, sum(weight * weight) AS size FROM vectors GROUP BY ALL),
        products AS MATERIALIZED (SELECT q.key AS item, c.key AS chunk_id, sum(q.weight * c.weight) AS product
            FROM vectors q JOIN vectors c ON q.place = c.place AND c.chunk AND NOT q.chunk GROUP BY ALL),
        scored AS (SELECT item_id AS query_id, chunks.*, coalesce(a.size, 0) + coalesce(b.size, 0) - 2 * coalesce(product, 0) AS score
            FROM benchmark CROSS JOIN chunks LEFT JOIN sizes a ON a.key = item_id::varchar AND NOT a.chunk
            LEFT JOIN sizes b ON b.key = chunks.chunk_id AND b.chunk LEFT JOIN products p ON p.item = item_id::varchar AND p.chunk_id = chunks.chunk_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), chunk_id) AS rank FROM scored)
        SELECT query_id, rank, doc_id, chunk_no, source, round(score, 6) AS score, text AS content FROM ranked WHERE rank <= 5"""


@query("search_documents", SEARCHED)
def search_documents(spark, d):
    return ix.search_table(questions(spark, d), table(spark, d, "documents").select("doc_id", "text", "source"))


def question_files(spark, d):
    """The benchmark texts as files in a folder of their own."""
    folder = scratch(spark)
    named = table(spark, d, "benchmark").select(
        F.concat(F.lit("item_"), F.col("item_id").cast("string"), F.lit(".txt")).alias("filename"), F.col("text").alias("content")
    )
    su.write_files(named, folder)
    return folder


# Files in a folder: the driver holds the list of one folder while it is read.
FOLDER_FILES = 100_000


def folder_cuts(files, most: int) -> list[str]:
    """The first names of all folders but the first, if each is to hold about ``most`` files in the order of their names."""
    names = files.select("filename").where("filename is not null")
    count = -(-names.count() // most)
    if count < 2:
        return []
    # One row per folder.
    dealt = names.repartitionByRange(count, "filename").groupBy(F.spark_partition_id()).agg(F.min("filename").alias("first")).collect()
    return sorted(r.first for r in dealt)[1:]


def in_folder(name, cuts: list[str]):
    """The name with its folder; a single folder has none above it."""
    if not cuts:
        return name
    number = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= name))
    return F.concat(F.format_string("%06d/", number), name)


def folders(top: str, cuts: list[str]) -> list[str]:
    return [f"{top}/{n:06d}" for n in range(len(cuts) + 1)] if cuts else [top]


def document_files(spark, d):
    """The documents as files under a folder of their own: its path, and where the folders in it begin."""
    top = scratch(spark)
    number = F.col("doc_id").cast("string")
    files = docs(spark, d).select(F.concat(F.lit("doc_"), number, F.lit(".txt")).alias("filename"), F.col("text").alias("content"))
    cuts = folder_cuts(files, FOLDER_FILES)
    su.write_files(files.withColumn("filename", in_folder(F.col("filename"), cuts)), top)
    return top, cuts


def index_files(spark, places: list[str], index: str, embedder=None) -> None:
    """Index folder after folder. They are in the order of the names, so equal contents are named after their last path, as in one folder."""
    for place in places:
        ix.index_documents(fs.scan_files(spark, place), index, embedder)


@query(
    "index_documents",
    """WITH f AS (SELECT sha256(text) AS id, max('doc_' || doc_id || '.txt') AS filename, any_value(strlen(text)) AS size_bytes
            FROM documents WHERE trim(text) <> '' GROUP BY 1) SELECT id, filename, 'txt' AS type, size_bytes FROM f""",
)
def index_documents(spark, d):
    index = scratch(spark)
    index_files(spark, folders(*document_files(spark, d)), index)
    return tb.read_registry(spark, f"{index}/registry").select("id", "filename", "type", "size_bytes")


LETTERS = "list_transform(['a','e','i','o','u'], lambda x: (length(text) - length(replace(text, x, '')))::double)"


def nearest(chunks: str, key: str, k: int) -> str:
    """The k nearest of ``chunks`` (key, text) to every benchmark text by letter counts, ties by key."""
    return f"""c AS (SELECT *, {LETTERS} AS vector FROM ({chunks})),
        q AS (SELECT item_id, {LETTERS} AS wanted FROM benchmark),
        scored AS (SELECT item_id, c.* EXCLUDE (vector), list_sum(list_transform(list_zip(vector, wanted), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS score
            FROM q, c),
        placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score, {key}) AS rank FROM scored),
        nearest AS (SELECT * FROM placed WHERE rank <= {k})"""


# A document's chunks under the id of its text; equal texts are one document.
INDEXED = f"""SELECT DISTINCT sha256(d.text) AS document_id, sha256(d.text) || '-0-' || chunk_no AS chunk_id, c.text
    FROM ({CHUNKS}) c JOIN documents d USING (doc_id)"""


@query(
    "search_index",
    f"""WITH {nearest(INDEXED, "chunk_id", 3)}, files AS (SELECT sha256(text) AS document_id, max('doc_' || doc_id || '.txt') AS filename
            FROM documents GROUP BY 1)
        SELECT item_id AS query_id, rank, document_id, filename, text AS content, score FROM nearest JOIN files USING (document_id)""",
)
def search_index(spark, d):
    index = scratch(spark)
    index_files(spark, folders(*document_files(spark, d)), index, letter_counts)
    found = ix.search_documents(questions(spark, d), index, k=3, embedder=letter_counts)
    return found.select("query_id", "rank", "document_id", "filename", "content", "score")


@query(
    "search_documents_function",
    f"""WITH {nearest(f"SELECT sha256(d.text) || '-0-' || chunk_no AS chunk_id, min(doc_id) AS doc_id, chunk_no, any_value(c.text) AS text FROM ({CHUNKS}) c JOIN documents d USING (doc_id) GROUP BY d.text, chunk_no", "chunk_id", 4)}
        SELECT item_id AS query_id, rank, doc_id, chunk_no, text AS content, score FROM nearest""",
)
def search_documents_function(spark, d):
    documents = table(spark, d, "documents").select("doc_id", "text", "source")
    found = ix.search_table(questions(spark, d), documents, k=4, embedder=letter_counts)
    return found.select("query_id", "rank", "doc_id", "chunk_no", "content", "score")


# By whole id, by the short id of a list, and by a path that is known or not.
@query(
    "read_documents",
    """WITH first AS (SELECT sha256(text) AS id, max('doc_' || doc_id || '.txt') AS filename, any_value(text) AS text FROM documents GROUP BY 1)
        SELECT kind, id, filename, CASE WHEN length(text) > 1000 THEN left(text, 1000) || '...' ELSE text END AS summary
        FROM first, (VALUES ('id'), ('short'), ('path')) AS k(kind)""",
)
def read_documents(spark, d):
    (top, cuts), index = document_files(spark, d), scratch(spark)
    index_files(spark, folders(top, cuts), index, letter_counts)
    ident = F.sha2(F.col("text").cast("binary"), 256)
    named = docs(spark, d).select(ident.alias("id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"))
    named = named.withColumn("path", F.concat(F.lit(top.removeprefix("file://") + "/"), in_folder(F.col("filename"), cuts)))
    place = F.max("path")
    keys = named.groupBy("id").agg(
        F.map_from_arrays(
            F.array(F.lit("id"), F.lit("short"), F.lit("path"), F.lit("lost")),
            F.array(F.first("id"), F.concat(F.left(F.first("id"), F.lit(12)), F.lit("...")), place, F.lit("/nowhere/x.txt")),
        ).alias("k")
    )
    keys = keys.select(F.explode("k").alias("kind", "key")).distinct()
    return ix.read_documents(keys.select("key").distinct(), index).join(keys, "key").select("kind", "id", "filename", "summary")


@query(
    "resolve_hits",
    f"""WITH {REGISTRY}, hits AS (SELECT path AS source FROM registry UNION ALL
            SELECT '/moved/Doc_' || doc_id || '.TXT' FROM labels UNION ALL SELECT '/lost/' || doc_id || '.md' FROM labels),
        known AS (SELECT * FROM registry WHERE lang <> 'fr'),
        p AS (SELECT path, id, filename FROM known), f AS (SELECT filename AS name, id FROM known)
        SELECT source, coalesce(p.id, f.id, 'unknown') AS document_id, regexp_extract(source, '([^/]+)$', 1) AS filename
        FROM hits LEFT JOIN p ON p.path = source LEFT JOIN f ON f.name = regexp_extract(source, '([^/]+)$', 1)""",
)
def resolve_hits(spark, d):
    documents = table(spark, d, "documents")
    number = F.col("doc_id").cast("string")
    labels = table(spark, d, "labels")
    hits = (
        registry_of(documents).select(F.col("path").alias("source"))
        .union(labels.select(F.concat(F.lit("/moved/Doc_"), number, F.lit(".TXT"))))
        .union(labels.select(F.concat(F.lit("/lost/"), number, F.lit(".md"))))
    )
    return lib.resolve_hits(hits, registry_of(documents.filter(F.col("lang") != "fr")))


@query(
    "list_documents",
    f"""WITH {REGISTRY} SELECT left(id, 8) || '...' AS short_id, filename, 'txt' AS type,
        printf('%.1f KB', size_bytes / 1024.0::double) AS size,
        strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(n), '%Y-%m-%d %H:%M:%S') AS created FROM registry""",
)
def list_documents(spark, d):
    return lib.list_documents(registry_of(table(spark, d, "documents")))


@query(
    "get_documents",
    f"""WITH {REGISTRY}, first AS (SELECT id, min(n) AS n FROM registry GROUP BY 1),
        keys AS (SELECT DISTINCT id AS key, id AS prefix FROM registry UNION SELECT left(id, 8) || '...', left(id, 8) FROM registry
            UNION SELECT left(id, 3), left(id, 3) FROM registry UNION SELECT md5(id), md5(id) FROM registry),
        found AS (SELECT key, min(n) AS n FROM keys JOIN first ON starts_with(first.id, prefix) GROUP BY 1)
        SELECT key, id, filename FROM found JOIN registry USING (n)""",
)
def get_documents(spark, d):
    registry = registry_of(table(spark, d, "documents"))
    ident = F.col("id")
    keys = [ident, F.concat(F.substring(ident, 1, 8), F.lit("...")), F.substring(ident, 1, 3), F.md5(ident)]
    asked = registry.select(F.explode(F.array(*keys)).alias("key"))
    return lib.get_documents(asked, registry).select("key", "id", "filename")


@query(
    "document_summaries",
    """WITH p AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS s FROM (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 3 GROUP BY 1)
        SELECT doc_id, CASE WHEN length(s) > 1000 THEN left(s, 1000) || '...' ELSE s END AS summary FROM p""",
)
def document_summaries(spark, d):
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    return lib.document_summaries(pages)


def bm25(pages: str, k: int) -> str:
    """Ranking of ``pages`` (page_id, title, url, content) for the benchmark texts, as CTEs ending in ``ranked``."""
    return rf"""pages_in AS ({pages}),
        p AS (SELECT page_id, regexp_extract_all(lower(title || ' ' || content), '[\pL\pN]+') AS words, len(words) AS dl FROM pages_in),
        total AS (SELECT count(*)::double AS n, avg(dl) AS average FROM p),
        asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\pL\pN]+')) AS term FROM benchmark),
        tf AS (SELECT page_id, dl, term, count(*)::double AS tf FROM (SELECT page_id, dl, unnest(words) AS term FROM p)
            WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        idf AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5::double) / (count(*) + 0.5::double)) AS idf FROM tf, total GROUP BY 1),
        scored AS (SELECT item_id, page_id, round(sum(idf * tf * 2.2::double
                / (tf + 1.2::double * (0.25::double + 0.75::double * dl / average))), 6) AS score
            FROM asked JOIN idf USING (term) JOIN tf USING (term), total GROUP BY 1, 2),
        placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, page_id) AS rank FROM scored),
        ranked AS (SELECT item_id AS query_id, rank, page_id, score, title, url,
            CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END AS snippet
            FROM placed JOIN pages_in USING (page_id) WHERE rank <= {k})"""


DOCUMENT_PAGES = "SELECT doc_id AS page_id, source AS title, 'https://docs/' || doc_id AS url, text AS content FROM documents"
HTML_PAGES = "SELECT page_id, title, url, content FROM read_pages"


@query("search_pages", f"WITH {bm25(DOCUMENT_PAGES, 5)} SELECT * FROM ranked")
def search_pages(spark, d):
    pages = table(spark, d, "documents").select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("https://docs/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("title"), F.col("text").alias("content"),
    )
    return r.search_pages(questions(spark, d), pages)


@query("search_html_pages", f"WITH {PARTS}, {bm25(HTML_PAGES, 20)} SELECT * FROM ranked")
def search_html_pages(spark, d):
    return r.search_pages(questions(spark, d), table(spark, d, "pages"), k=20)


@query(
    "first_nonempty_source",
    """WITH r AS (SELECT conv_id AS query_id, role, turn AS rank, text, CASE role WHEN 'system' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END
            AS priority FROM conversations),
        b AS (SELECT *, min(priority) OVER (PARTITION BY query_id) AS best FROM r),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM b WHERE priority = best)
        SELECT query_id, role, rank, text, priority, place FROM n WHERE place <= 2""",
)
def first_nonempty_source(spark, d):
    role = F.col("role")
    results = table(spark, d, "conversations").select(
        F.col("conv_id").alias("query_id"), "role", F.col("turn").alias("rank"), "text",
        F.when(role == "system", 1).when(role == "assistant", 2).otherwise(3).alias("priority"),
    )
    return r.first_nonempty_source(results, 2)
