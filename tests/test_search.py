import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import checks
from marginalia.operators import chunks as c
from marginalia.operators import library as lib
from marginalia.operators import probes as pr
from marginalia.operators import ranking as r
from marginalia.operators import vectors as v

WORDS = st.lists(st.sampled_from(["alpha ", "be", ". ", "\n", "\n\n", " ", "x" * 30, "été"]), max_size=60).map("".join)


@given(WORDS, st.integers(5, 60), st.integers(0, 4))
@settings(max_examples=300, deadline=None)
def test_chunk_properties(text, size, overlap):
    chunks = c.split_text(text, size, overlap)
    assert all(0 < len(chunk) <= size and chunk == chunk.strip() for chunk in chunks)
    place = 0
    for chunk in chunks:
        at = text.find(chunk, max(0, place - size))
        assert at >= 0
        place = at + len(chunk)
    assert set("".join(text.split())) == set("".join("".join(chunks).split()))
    if overlap == 0:
        assert "".join("".join(chunks).split()) == "".join(text.split())


@pytest.mark.parametrize("n, expected", [(0, []), (999, [999]), (1000, [1000]), (1001, [1000, 201]), (2600, [1000, 1000, 1000])])
def test_chunks_without_separator(n, expected):
    assert [len(x) for x in c.split_text("x" * n)] == expected


def test_chunks_prefer_paragraphs():
    text = "\n\n".join(["a" * 400, "b" * 400, "c" * 400, "d" * 150])
    assert [x[0] + x[-1] for x in c.split_text(text)] == ["ab", "cd"]
    assert c.split_text("\n" * 3000) == []


def test_chunks_overlap_with_whole_pieces():
    text = " ".join(f"w{i:03d}" for i in range(400))
    chunks = c.split_text(text, 100, 20)
    assert all(a.split()[-4:] == b.split()[:4] for a, b in zip(chunks, chunks[1:]))


def test_chunk_documents_and_fixed_agree(spark):
    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([0, 1, 200, 201, 999, 1000, 1001, 1800, 1801, 5000])], "doc_id int, text string")
    cut = sorted(map(tuple, c.chunk_documents(docs).collect()))
    assert cut == sorted(map(tuple, c.chunk_fixed(docs).collect()))
    assert [x[1] for x in cut if x[0] == 9] == list(range(6))


def test_chunk_arguments(spark):
    with pytest.raises(ValueError):
        c.chunk_documents(spark.createDataFrame([(1, "x")], "doc_id int, text string"), 10, 10)


def brute(queries, vectors, k):
    out = []
    for q, qv in queries:
        scored = sorted((float(((np.array(x) - np.array(qv)) ** 2).sum()), i) for i, x in vectors)
        out += [(q, n + 1, i, round(s, 6)) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(500)]
    queries = [(q, [float(x) for x in rng.normal(size=6)]) for q in range(40)] + [(99, vectors[0][1])]
    return queries, vectors


def frames(spark, points):
    queries, vectors = points
    return (
        spark.createDataFrame(queries, "query_id bigint, vector array<float>"),
        spark.createDataFrame(vectors, "id bigint, vector array<float>").repartition(5),
    )


def listed(df):
    return [(x.query_id, x.rank, x.id, round(x.score, 6)) for x in df.orderBy("query_id", "rank").collect()]


def rounded(points):
    """The queries as they are stored, in single precision."""
    queries, vectors = points
    return [(q, [float(np.float32(x)) for x in qv]) for q, qv in queries], vectors


@pytest.mark.parametrize("blocked", [False, True])
def test_search_topk_is_exact(spark, points, monkeypatch, blocked):
    if blocked:
        monkeypatch.setattr(v, "BLOCK_QUERIES", 7)
        monkeypatch.setattr(v, "PART_ITEMS", 100)
    # Equal vectors are many here, so ties by id are tested as well.
    assert listed(v.search_topk(*frames(spark, points), k=7)) == brute(*rounded(points), 7)


def test_search_topk_edges(spark, points):
    queries, vectors = frames(spark, points)
    assert v.search_topk(queries, vectors.limit(0)).count() == 0
    assert v.search_topk(queries.limit(0), vectors).count() == 0
    assert v.search_topk(queries, vectors.limit(3), k=5).count() == 3 * queries.count()
    named = vectors.withColumn("id", F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 4, "0")))
    found = listed(v.search_topk(queries, named, k=2))
    assert [int(x[2][1:]) for x in found] == [x[2] for x in brute(*rounded(points), 2)]


def test_cells_leave_out_what_cannot_be_near(spark, monkeypatch):
    """Many queries over clustered vectors: exact, with most parts never visited, no vector at two places."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(20, 8)) * 20
    vectors = [(i, (middles[i % 20] + rng.normal(size=8)).round(2).tolist()) for i in range(600)]
    queries = [(i, (middles[i % 20] + rng.normal(size=8)).round(2).tolist()) for i in range(100)]
    for name, value in {"BLOCK_QUERIES": 7, "PART_ITEMS": 25, "PIVOTS": 40, "MEETING_QUERIES": 30}.items():
        monkeypatch.setattr(v, name, value)
    asked, have = frames(spark, (queries, vectors))
    # Single precision on both sides.
    points = [[(i, [float(np.float32(x)) for x in p]) for i, p in side] for side in (queries, vectors)]
    assert listed(v.search_topk(asked, have, k=6)) == brute(*points, 6)
    cells = v.Cells(have)
    home = cells.home(asked)
    first = v.best_hits(v.meet(cells.in_parts(), home, ["cell", "part"], v.distances, 6, v.hit_schema(asked, have)), 6)
    reach = first.where("rank = 6").select("query_id", F.col("score").alias("reach"))
    visits = cells.within_reach(home.join(reach, "query_id", "left").na.fill(float("inf"), ["reach"])).count() + len(queries)
    assert cells.in_parts().count() == len(vectors)
    assert visits < 0.25 * sum(cells.parts.values()) * len(queries)


def test_nearest_cells_are_the_cheapest():
    import itertools

    rng = np.random.default_rng(2)
    for n, probes in ((1, 3), (3, 9), (4, 30), (3, 100)):
        within = rng.random(n)
        cost = lambda steps: sum(within[i] ** 2 if step < 0 else (1 - within[i]) ** 2 for i, step in steps)
        every = [[(i, x) for i, x in enumerate(steps) if x] for steps in itertools.product((-1, 0, 1), repeat=n)]
        wanted = sorted(every, key=cost)[:probes]
        assert [sorted(s) for s in pr.nearest_cells(within, probes)] == [sorted(s) for s in wanted]


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(60, 24))
    around = lambda i: (middles[i % 60] + rng.normal(size=24) * 0.25).round(3).tolist()
    return [(i, around(i)) for i in range(60)], [(i, around(i)) for i in range(900)]


@pytest.mark.parametrize("many", [False, True])
def test_approximate_search(spark, clustered, monkeypatch, many):
    """Exact distances, nine tenths of the true hits, a tenth of the pairs; the same for few and many queries."""
    settings = {"bucket_length": 1.0, "tables": 4, "projections": 6, "probes": 16, "seed": 1}
    if many:
        for name, value in {"BLOCK_QUERIES": 7, "MEETING_QUERIES": 20}.items():
            monkeypatch.setattr(v, name, value)
        monkeypatch.setattr(pr, "BUCKET_ROWS", 10)
    asked, have = frames(spark, clustered)
    points = [[(i, [float(np.float32(x)) for x in p]) for i, p in side] for side in clustered]
    exact = {(q, i): s for q, _, i, s in brute(*points, 900)}
    grid = pr.Grid(24, 4, 6, 1.0, 1)
    pairs = {tuple(r) for r in pr.probe_pairs(asked, have, grid, 16).collect()}
    assert len(pairs) <= 0.1 * len(exact)
    found = listed(pr.search_topk_approx(asked, have, k=5, **settings))
    kept = {q for q in range(60) if sum(a == q for a, _ in pairs) >= 5}
    wanted = [(q, n + 1, i, s) for q in range(60) for n, (s, i) in enumerate(sorted((exact[q, i], i) for i in range(900) if q not in kept or (q, i) in pairs)[:5])]
    assert found == wanted
    best = {(q, i) for q, _, i, _ in brute(*points, 5)}
    assert len(best & {(q, i) for q, _, i, _ in found}) / len(best) >= 0.9


def test_approximate_search_fills_up(spark, points):
    queries, vectors = frames(spark, points)
    narrow = pr.search_topk_approx(queries, vectors, k=5, bucket_length=0.001, tables=1, probes=2)
    assert listed(narrow) == brute(*rounded(points), 5)


def test_embedding(spark):
    df = spark.createDataFrame([(1, "red apple"), (2, "Red apple!"), (3, "blue sky"), (4, None)], "id int, text string")
    rows = {x.id: np.array(x.vector) for x in v.embed_text(df, "text").collect()}
    assert len(rows[1]) == v.DIMENSIONS
    assert np.allclose(rows[1], rows[2]) and np.linalg.norm(rows[1]) == pytest.approx(1, abs=1e-6)
    assert rows[1] @ rows[3] < 0.5 and not rows[4].any()
    alone = v.embed_text(df.filter("id = 3"), "text").first()
    assert np.array_equal(alone.vector, rows[3])
    custom = v.embed_text(df, "text", lambda texts: [[len(x), 1] for x in texts])
    assert [list(x.vector) for x in custom.orderBy("id").collect()] == [[9, 1], [10, 1], [8, 1], [0, 1]]


def bm25(queries, pages, k):
    import re

    def words(text):
        return re.findall(r"[^\W_]+", text.lower())

    docs = {i: words(title + " " + content) for i, _, title, content in pages}
    average = sum(map(len, docs.values())) / len(docs)
    out = []
    for q, text in queries:
        scores = {}
        for term in set(words(text)):
            df = sum(term in d for d in docs.values())
            idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
            for i, d in docs.items():
                if tf := d.count(term):
                    scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / average))
        best = sorted(((-round(s, 6), i) for i, s in scores.items()))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_search_pages(spark, monkeypatch, small):
    if small:
        for name, value in {"BLOCK_ROWS": 3, "BLOCK_ASKED": 1, "BROADCAST_ROWS": 2}.items():
            monkeypatch.setattr(r, name, value)
    rng = np.random.default_rng(3)
    vocabulary = ["sun", "moon", "star", "sky", "sea", "über", "x1"]
    pages = [(i, f"u{i}", "Sun", " ".join(rng.choice(vocabulary, rng.integers(0, 30)))) for i in range(40)]
    queries = [(1, "moon sea"), (2, "ÜBER, x1?"), (3, "nothing"), (4, "sun sun")]
    for k in (30, 3):
        found = r.search_pages(
            spark.createDataFrame(queries, "query_id int, text string"),
            spark.createDataFrame(pages, "page_id int, url string, title string, content string"),
            k=k,
        )
        rows = [(x.query_id, x.rank, x.page_id, round(x.score, 6)) for x in found.orderBy("query_id", "rank").collect()]
        assert rows == bm25(queries, pages, k) and max(x[1] for x in rows) == k
    empty = r.search_pages(spark.createDataFrame(queries, "query_id int, text string"), spark.createDataFrame([], "page_id int, url string, title string, content string"))
    assert empty.collect() == []


def test_blocks_without_a_hit_are_not_scored(spark, monkeypatch):
    """Rare terms lead; blocks that only hold frequent ones are passed over, and the ranking stays whole."""
    monkeypatch.setattr(r, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(5)
    common, rare = ["the", "of", "and"], [f"rare{i}" for i in range(40)]
    pages = [(i, f"u{i}", "", " ".join([*rng.choice(common, 30), *rng.choice(rare, 1), *(["gem"] * 3 if 70 <= i < 74 or i == 330 else [])])) for i in range(600)]
    queries = [(1, "the gem of"), (2, "rare3 and"), (3, "the of and")]
    asked = spark.createDataFrame(queries, "query_id int, text string")
    table = spark.createDataFrame(pages, "page_id int, url string, title string, content string").coalesce(1)
    kept = {}
    score_blocks = r.score_blocks

    def counted(pairs, *rest):
        kept["pairs"] = pairs
        return score_blocks(pairs, *rest)

    monkeypatch.setattr(r, "score_blocks", counted)
    found = r.search_pages(asked, table, k=3)
    rows = [(x.query_id, x.rank, x.page_id, round(x.score, 6)) for x in found.orderBy("query_id", "rank").collect()]
    assert rows == bm25(queries, pages, 3)
    blocks = {q: n for q, n in kept["pairs"].groupBy("query_id").count().collect()}
    assert blocks[1] <= 2 and blocks[2] < 20 and blocks[3] <= 30


def test_first_nonempty_source(spark):
    rows = [(1, "a", 1, 1), (1, "b", 2, 1), (2, "b", 2, 2), (2, "b", 2, 1), (2, "b", 2, 3), (2, "c", 3, 1)]
    found = r.first_nonempty_source(spark.createDataFrame(rows, "query_id int, source string, priority int, rank int"), 2)
    assert sorted((x.query_id, x.source, x.rank) for x in found.collect()) == [(1, "a", 1), (2, "b", 1), (2, "b", 2)]


REGISTRY = "id string, filename string, path string, type string, created_at timestamp, size_bytes bigint"


@pytest.fixture
def registry(spark):
    import datetime as dt

    ids = ["ab" + "0" * 62, "ab" + "1" * 62, "cd" + "2" * 62]
    rows = [(i, f"{n}.txt", f"/d/{n}.txt", "txt", dt.datetime(2024, 1, 9 - n), 512 * n) for n, i in enumerate(ids)]
    return ids, spark.createDataFrame(rows, REGISTRY)


def test_get_documents(spark, registry):
    ids, table = registry
    keys = [ids[0], ids[0][:8], ids[1][:8] + "...", "ab", "cd2.", "zz", "f" * 64, ids[2] + "..."]
    rows = {x.key: x.id for x in lib.get_documents(spark.createDataFrame([(k,) for k in keys], "key string"), table).collect()}
    # The prefix "ab" takes the first one registered, which is the second here.
    assert rows == {keys[0]: ids[0], keys[1]: ids[0], keys[2]: ids[1], "ab": ids[1], "cd2.": ids[2], keys[7]: ids[2]}


def test_list_documents(registry):
    _, table = registry
    rows = lib.list_documents(table).orderBy("filename").collect()
    assert [(x.short_id, x.size) for x in rows] == [("ab000000...", "0.0 KB"), ("ab111111...", "0.5 KB"), ("cd222222...", "1.0 KB")]


def test_resolve_hits(spark, registry):
    ids, table = registry
    again = table.filter(F.col("filename") == "0.txt").withColumns({"id": F.lit("later"), "path": F.lit("/e/0.txt"), "created_at": F.lit("2025-01-01").cast("timestamp")})
    hits = spark.createDataFrame([("/d/1.txt",), ("/moved/0.txt",), ("/lost/9.txt",)], "source string")
    rows = {x.source: (x.document_id, x.filename) for x in lib.resolve_hits(hits, table.union(again)).collect()}
    assert rows == {"/d/1.txt": (ids[1], "1.txt"), "/moved/0.txt": (ids[0], "0.txt"), "/lost/9.txt": ("unknown", "9.txt")}


def test_document_summaries(spark):
    pages = spark.createDataFrame(
        [(1, n, "abcd"[n]) for n in range(4)] + [(2, 0, "x" * 999), (2, 1, "y")] + [(3, 0, "z" * 1000)], "doc_id int, page_no int, text string"
    )
    rows = {x.doc_id: x.summary for x in lib.document_summaries(pages).collect()}
    assert rows == {1: "a\n\nb\n\nc", 2: "x" * 999 + "\n...", 3: "z" * 1000}


def test_every_vector_is_a_query_of_a_search(spark, tmp_path):
    checks.load()
    rows = [(i, [float(i % 7), float(i), 1.0] * 21 + [0.5]) for i in range(230)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("search_topk", "search_topk_approx"):
        found = checks.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted((r.query_id, r.rank) for r in found) == [(i, n) for i in range(230) for n in range(1, 6)]
        assert {r.id for r in found if r["rank"] == 1} == set(range(230))
