"""The pipeline against a plain version, and the registered queries against their SQL."""

import glob
import os
import re

import duckdb

import __spark_entry__ as entry_point
import corpus_pipeline
from marginalia.llm.registry import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def test_registered():
    names = [n for n in entry_point.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry_point.queries() and set(ORACLE) <= set(QUERIES)


def test_sql(spark):
    db = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    for name, sql in ORACLE.items():
        relation = db.sql(sql)
        mine = QUERIES[name](spark, SMALL).select(*relation.columns).collect()
        assert sorted(map(tuple, mine)) == sorted(map(tuple, relation.fetchall()))


def test_contracts(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    n = documents.count()
    for number, columns in {
        4: {"doc_id", "n_shingles", "component_id"},
        5: {"doc_id", "held_out", "lang_pred", "score"},
        6: {"doc_id", "held_out", "score", "predicted"},
        9: {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        10: {"doc_id", "start", "n_tokens", "ids_crc32"},
    }.items():
        name = next(q for q in QUERIES if q.startswith(f"op{number}_"))
        found = QUERIES[name](spark, SMALL)
        assert columns <= set(found.columns) and found.count() == n, name
        assert found.select("doc_id").distinct().count() == n


def test_rows_of_one_id(spark, docs_of):
    """A stage drops a row by its id and text, and returns columns whose names it uses itself as they came."""
    text = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"v{i}" for i in range(80))
    docs = docs_of((1, text), (2, text + " end"), (2, other), (2, None), (None, text), (3, ""))
    docs = docs.withColumnsRenamed({"component_id": "_gone_id"}).selectExpr("*", "'x' as lang_pred", "'y' as text_hash")
    kept = corpus_pipeline.ngram_jaccard_join(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted([("1", text), ("2", other), ("2", "None"), ("None", text), ("3", "")])
    known = corpus_pipeline.language_id(spark, docs, SMALL)
    assert known.columns == docs.columns and {(r.score, r.lang_pred, r.text_hash) for r in known.collect()} == {(7, "x", "y")}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        assert kept.columns == docs.columns
        texts[name] = {r.doc_id: r.text for r in kept.collect()}
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    first, near, cut, clean = texts.values()
    assert len(first) >= 195
    # Of every group linked at 0.8 over five words, the smallest stays.
    sets = {i: shingles(t, 5) for i, t in first.items()}
    parent = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = parent[i], parent[j]
                parent = {k: min(a, b) if v in (a, b) else v for k, v in parent.items()}
    assert set(near) == {i for i in sets if parent[i] == i} and near == {i: first[i] for i in near}
    # No passage of fifty words is left in two documents, but for a few that hold no paragraph.
    windows, twice = {}, set()
    for i, t in cut.items():
        words = t.encode().lower().split()
        for k in range(len(words) - 49):
            other = windows.setdefault(tuple(words[k : k + 50]), i)
            twice |= {i} if other != i else set()
    assert len(twice) <= 1
    # What has a ten-word window of the benchmark goes.
    leaks = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        words = WORD.findall(r.text.lower())
        leaks |= {tuple(words[k : k + 10]) for k in range(max(1, len(words) - 9))}
    for i, t in cut.items():
        words = WORD.findall(t.lower())
        hit = any(tuple(words[k : k + 10]) in leaks for k in range(len(words)))
        assert (i in clean) != hit
    run = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in run.select("doc_id").distinct().collect()} == set(clean)


def test_short_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        corpus_pipeline._ship(spark)
        assert spark.conf.get(name) == "1000"
    finally:
        spark.conf.set(name, held)
