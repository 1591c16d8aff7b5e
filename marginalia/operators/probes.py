"""Approximate search: buckets of several projections per table, and neighbouring buckets by distance.

The key of a vector in a table is the cell of a grid over several orthogonal directions. A query
looks into the cells nearest to it, in the order of its squared distance to them: a heap goes
through the changes of single steps, the cheapest first. Distances are exact; a neighbour in none
of the cells looked into is missed. Queries that find fewer than k vectors are searched exactly.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.vectors import Best, best_hits, distances, hit_schema, matrix, meet, scan_items, search_topk, travelling, usable, vector_width
from marginalia.session import broadcast_if_small, cut_lineage

# Vectors of one bucket that meet in a task.
BUCKET_ROWS = 20_000
# Distinct odd numbers that mix the steps of a cell into one key.
_MIX = np.uint64(0x9E3779B97F4A7C15)


def directions(width: int, tables: int, projections: int, seed: int) -> np.ndarray:
    """Random directions, orthogonal and of unit length within a table: (table, width, projection)."""
    draw = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(draw.normal(size=(width, projections)))[0] for _ in range(tables)])


def _keys(cells: np.ndarray) -> np.ndarray:
    """One number per cell (last axis). Different cells of one number only add candidates."""
    key = np.zeros(cells.shape[:-1], np.uint64)
    for i in range(cells.shape[-1]):
        key = (key ^ cells[..., i].astype(np.int64).astype(np.uint64)) * _MIX
        key ^= key >> np.uint64(31)
    return key.astype(np.int64)


def nearest_cells(within: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
    """The ``probes`` cells nearest to a point, as lists of (direction, step of -1 or 1).

    ``within`` is where the point lies in its own cell, from 0 to 1 by direction. The costs of
    single steps are sorted; from a set of steps the heap goes on to the set with its last one
    replaced by the next, and to the set with the next one added.
    """
    steps = sorted([(x * x, i, -1) for i, x in enumerate(within)] + [((1 - x) * (1 - x), i, 1) for i, x in enumerate(within)])
    out, heap = [[]], [(steps[0][0], (0,))]
    while heap and len(out) < probes:
        cost, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if len({steps[j][1] for j in chosen}) == len(chosen):
            out.append([steps[j][1:] for j in chosen])
        if last + 1 < len(steps):
            heapq.heappush(heap, (cost - steps[last][0] + steps[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + steps[last + 1][0], (*chosen, last + 1)))
    return out


class Grid:
    """The grids of all tables, the same in every task."""

    def __init__(self, width: int, tables: int, projections: int, length: float, seed: int) -> None:
        self.along = directions(width, tables, projections, seed) / length
        self.tables = tables

    def _places(self, points: np.ndarray) -> np.ndarray:
        return np.einsum("nw,twp->ntp", points, self.along)

    def own(self) -> Column:
        """The key of a vector in each table."""

        @F.arrow_udf("array<bigint>")
        def keys(points: pa.Array) -> pa.Array:
            found = _keys(np.floor(self._places(matrix(points)))) if len(points) else np.empty((0, self.tables), np.int64)
            return pa.array(list(found), pa.list_(pa.int64()))

        return keys("vector")

    def probed(self, probes: int) -> Column:
        """The keys a query looks up in each table."""

        @F.arrow_udf("array<array<bigint>>")
        def keys(points: pa.Array) -> pa.Array:
            out = []
            places = self._places(matrix(points)) if len(points) else []
            for row in places:
                tables = []
                for place in row:
                    cell = np.floor(place)
                    cells = np.tile(cell, (probes, 1))
                    nearest = nearest_cells(place - cell, probes)
                    for n, steps in enumerate(nearest):
                        for i, step in steps:
                            cells[n, i] += step
                    tables.append(_keys(cells[: len(nearest)]).tolist())
                out.append(tables)
            return pa.array(out, pa.list_(pa.list_(pa.int64())))

        return keys("vector")


def _candidates(block: pa.Table):
    """Scorer that compares an item with the queries that look into one of its buckets."""
    wanted = matrix(block["vector"])
    tables = block["keys"].combine_chunks()
    looked = []
    for t in range(len(tables[0]) if block.num_rows else 0):
        keys = [row[t].as_py() for row in tables]
        flat = np.concatenate([np.array(k, np.int64) for k in keys])
        query = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.argsort(flat, kind="stable")
        looked.append((flat[order], query[order]))

    def score(batch, ids, best: Best):
        have, own = matrix(batch.column("vector")), matrix_of_keys(batch.column("keys"))
        pairs = []
        for t, (keys, query) in enumerate(looked):
            first, end = np.searchsorted(keys, own[:, t], "left"), np.searchsorted(keys, own[:, t], "right")
            n = end - first
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            pairs.append(np.repeat(np.arange(len(own)), n) * len(wanted) + query[at])
        pair = np.unique(np.concatenate(pairs))
        row, query = pair // len(wanted), pair % len(wanted)
        if len(pair) > 0.1 * len(have) * len(wanted):
            # Most pairs are candidates: rough distances of all tell which need exact ones.
            have_norm, wanted_norm = (have**2).sum(axis=1)[:, None], (wanted**2).sum(axis=1)
            rough = np.full((len(have), len(wanted)), np.inf)
            rough[row, query] = (have_norm + wanted_norm - 2 * (have @ wanted.T))[row, query]
            slack = 1e-8 * (1 + have_norm + wanted_norm)
            row, query = np.nonzero(rough - slack <= np.where(np.isfinite(rough), best.bound(rough + slack), -np.inf))
        away = ((have[row] - wanted[query]) ** 2).sum(axis=1)
        near = away <= best.limit[query]
        return query[near], away[near], ids[row[near]]

    return score


def matrix_of_keys(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def probe_pairs(queries: DataFrame, vectors: DataFrame, grid: Grid, probes: int) -> DataFrame:
    """(query_id, id) of every query and the vectors in the buckets it looks into, each pair once."""
    mine = vectors.select("id", F.posexplode(grid.own()).alias("table", "key"))
    asked = queries.select("query_id", F.posexplode(grid.probed(probes)).alias("table", "_keys"))
    asked = asked.select("query_id", "table", F.explode("_keys").alias("key"))
    return asked.join(mine, ["table", "key"]).select("query_id", "id").distinct()


def _by_buckets(queries: DataFrame, vectors: DataFrame, grid: Grid, probes: int, k: int, out) -> DataFrame:
    """Many queries meet the vectors bucket by bucket; large buckets are split."""
    mine = vectors.select("id", "vector", F.posexplode(grid.own()).alias("table", "key"))
    asked = queries.select("query_id", "vector", F.posexplode(grid.probed(probes)).alias("table", "_keys"))
    asked = asked.select("query_id", "vector", "table", F.explode("_keys").alias("key"))
    large = mine.groupBy("table", "key").agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).cast("int").alias("_parts"))
    large = broadcast_if_small(cut_lineage(large.where("_parts > 1")))

    def split(df: DataFrame) -> DataFrame:
        return df.join(large, ["table", "key"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))

    mine = split(mine).withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).drop("_parts")
    asked = split(asked).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    # A pair that meets in several tables is one hit.
    return meet(mine, asked, ["table", "key", "part"], distances, k, out).groupBy("query_id", "id").agg(F.min("score").alias("score"))


def search_topk_approx(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    bucket_length: float = 0.5,
    tables: int = 4,
    projections: int = 4,
    probes: int = 16,
    seed: int = 42,
) -> DataFrame:
    """As ``search_topk``, but a query is compared only with vectors in the buckets it looks into.

    A bucket is a cell of edge ``bucket_length`` over ``projections`` directions; ``tables`` grids
    are tried, in each the ``probes`` cells nearest to the query.
    """
    queries, vectors = usable(queries, vectors)
    width = vector_width(queries)
    grid, out = Grid(width, tables, projections, bucket_length, seed), hit_schema(queries, vectors)
    looking = queries.withColumn("keys", grid.probed(probes))
    head = travelling(looking, width + tables * probes)
    if head is None:
        found = _by_buckets(queries, vectors, grid, probes, k, out)
    else:
        found = scan_items(head, vectors.withColumn("keys", grid.own()), _candidates, k, out)
    ranked = cut_lineage(best_hits(found, k))
    full = ranked.filter(F.col("rank") == k).select("query_id")
    short = cut_lineage(queries.join(full, "query_id", "left_anti"))
    return ranked.join(full, "query_id", "left_semi").unionByName(search_topk(short, vectors, k))
