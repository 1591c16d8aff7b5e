"""Divergence of sources against its SQL and a dense computation."""

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import divergence
from marginalia.llm.divergence import document_terms, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCALE = 1_000_000_000


def lowered(text):
    return "".join(c.lower() if c < "\x80" else c for c in text)


def dense(rows, least):
    """Every group against every kept term."""
    rows = [(lang or "", source or "", TERM.findall(lowered(text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        documents, groups = Counter(), {}
        for _, source, terms in mine:
            documents.update(set(terms))
            groups.setdefault(source, Counter()).update(terms)
        kept = [t for t, n in documents.items() if n >= least]
        whole = sum(groups.values(), Counter())

        def shares(counts):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + SCALE * (counts[t] + 2) // total for t in kept}

        def apart(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        for s in groups:
            pairs = [(sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(apart(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, values, limit in (("pair", pairs, None), ("term", terms, 10)):
                ordered = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)}
    return out


@pytest.fixture
def docs(spark):
    def make(rows):
        return spark.createDataFrame(
            [(i, t, la, s, 0, "x", 1) for i, (la, s, t) in enumerate(rows)],
            "doc_id long, text string, lang string, source string, n int, term string, rank int",
        )

    return make


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZzé@[`{\x7f\x00 \n9日-_")), max_size=40), st.integers(1, 9))
def test_terms_in_slices(text, size):
    divergence.SLICE, before = size, divergence.SLICE
    try:
        found = {t.decode(): n for t, n in document_terms(text.encode()).items()}
    finally:
        divergence.SLICE = before
    assert found == Counter(TERM.findall(lowered(text)))


def test_against_dense(docs, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    draw = random.Random(3)
    words = ["a", "bé", "C", "日本", "dd", "e9f", "gg", "only"]
    rows = [
        (draw.choice(["en", "fr", None]), draw.choice(["s1", "s2", "s3", "ß", None]), " ".join(draw.choices(words[: draw.randint(1, 7)], k=draw.randint(0, 9))))
        for _ in range(90)
    ]
    rows += [("en", "s1", None), ("en", "bare", ""), ("xx", "alone", "once"), ("yy", "a", "1 2"), ("yy", "b", None), ("en", "s1", "only")] + [("en", "s1", "A a")] * 5
    got = [tuple(r) for r in source_divergence(docs(rows), least_documents=4).collect()]
    assert len(got) == len(set(got))
    assert set(got) == dense(rows, 4)


def test_large_counts_are_exact(spark):
    """Counts whose product with the scale is beyond 64 bits."""
    from pyspark.sql import functions as F

    n, total = 123_456_789_012, 987_654_321_987
    row = spark.createDataFrame([(n, total)], "n long, t long").select(divergence._share(F.col("n"), F.col("t")).alias("p")).first()
    assert row.p == 1 + SCALE * (n + 2) // total


def test_empty(docs):
    assert source_divergence(docs([("en", "s", "x")]).limit(0)).collect() == []
