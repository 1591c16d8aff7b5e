"""Centroid clustering against full scans in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from marginalia.llm import centroids
from marginalia.llm.centroids import assign, cluster_vectors


def scan_all(vectors, starts, rounds):
    """Lloyd's rounds with every distance, ties to the smaller number."""
    places = [list(c) for c in starts]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(places))

    for _ in range(rounds):
        found = [nearest(v)[1] for v in vectors]
        for k in range(len(places)):
            mine = [v for v, c in zip(vectors, found) if c == k]
            if mine:
                places[k] = [sum(x) // len(mine) for x in zip(*mine)]
    return [nearest(v) for v in vectors], places


@pytest.fixture
def table(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, v string")

    return make


def expected(rows, components, clusters, rounds, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    first = sorted((i is None, mark(i), v) for i, v in kept)[:clusters]
    nearest, places = scan_all([v for _, v in kept], [v for *_, v in first], rounds)
    inertia = {k: sum(d for d, c in nearest if c == k) for k in range(len(places))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in places]
    whole = sum(inertia.values())
    return sorted(((i, k, d, inertia[k], whole, digest[k]) for (i, _), (d, k) in zip(kept, nearest)), key=str)


def test_against_full_scans(table):
    draw = np.random.default_rng(5)
    middles = draw.normal(size=(6, 8))
    rows = [(i, (middles[i % 6] * 2 + draw.normal(size=8) * 0.3).tolist()) for i in range(300)]
    rows += [(i, [1.0] * 8) for i in range(300, 320)] + [(7, [0.5] * 8)] * 3 + [(None, [0.25] * 8)]
    rows += [(900, None), (901, []), (902, [1.0] * 7), (903, [float("nan")] * 8), (904, [None] + [1.0] * 7), (905, [float("inf")] + [0.0] * 7)]
    got = sorted(map(tuple, cluster_vectors(table(rows), clusters=12, components=8).collect()), key=str)
    assert got == expected(rows, 8, 12, 5)


def test_few_rows_ties_and_empty(table):
    rows = [(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])]
    for n in range(1, 5):
        got = sorted(map(tuple, cluster_vectors(table(rows[:n]), components=2).collect()), key=str)
        assert got == expected(rows[:n], 2, 40, 5)
    assert cluster_vectors(table([(1, None)]), components=2).collect() == []


def test_large_components_are_exact(table):
    draw = np.random.default_rng(9)
    rows = [(i, (draw.integers(-3, 4, 3) * 1e5 + draw.integers(0, 3, 3)).tolist()) for i in range(80)]
    got = sorted(map(tuple, cluster_vectors(table(rows), clusters=5, components=3).collect()), key=str)
    assert got == expected(rows, 3, 5, 5)
    huge = cluster_vectors(table([(1, [1e300, -1e300]), (2, [0.0, 0.0]), (3, [1e300, 0.0])]), clusters=1, components=2, rounds=0).collect()
    assert {r.distance for r in huge} <= {0, centroids._LARGEST} and len(huge) == 3


def test_bounds_stand_in_for_most_scans():
    """Later rounds leave most vectors unscanned, and what they leave is what a scan would give."""
    draw = np.random.default_rng(1)
    middles = draw.integers(-400, 400, (10, 16))
    vectors = middles[draw.integers(0, 10, 2000)] + draw.integers(-30, 30, (2000, 16))
    history, state, scanned = [vectors[:10].copy()], None, []
    for _ in range(7):
        state, fails = assign(vectors, state, history)
        scanned.append(int(fails.sum()))
        squared = ((vectors[:, None] - history[-1]) ** 2).sum(axis=2)
        assert (state["cluster"] == squared.argmin(axis=1)).all()
        places = history[-1].copy()
        for k in range(10):
            if (state["cluster"] == k).any():
                places[k] = vectors[state["cluster"] == k].sum(axis=0) // (state["cluster"] == k).sum()
        history.append(places)
    assert scanned[0] == 2000 and sum(scanned[3:]) < 0.3 * 4 * 2000


def test_displacement_is_total_not_summed():
    """A centroid that went away and came back has not moved."""
    there, away = np.array([[0, 0], [10, 0]]), np.array([[50, 0], [10, 0]])
    moved, furthest = centroids.displacements([there, away, there])
    assert moved[0].tolist() == [0, 0] and moved[1][0] >= 50 and furthest[1][1] >= 50 and furthest[1][0] == 0
