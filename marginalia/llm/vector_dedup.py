"""Near-duplicate vectors by p-stable hashing.

Vectors of one length are normalised and projected on random Gaussian directions; the
projections, shifted and cut into steps, number a bucket in each of several tables. Two
vectors at a small Euclidean distance share a bucket in one of the tables with high
probability: with the defaults at least 0.98 for a pair at cosine 0.95, more for closer ones.
All pairs of a bucket are then compared by exact cosine, inside tasks: what leaves a task is at
most one row per vector, the number of its links and one edge.

Vectors with equal components are taken together first. Large buckets are cut into blocks and
compared block by block, so no task holds more than two blocks. Null, empty and zero vectors,
and those with null, NaN or infinite components, link with nothing. Repeated rows are vectors
of their own and link with each other; a row without an id links with nothing. Vectors of
different lengths never link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.components import connected_components
from marginalia.llm.groups import smallest_labels, sorted_groups
from marginalia.session import broadcast_if_small, cut_lineage

TABLES = 24
PROJECTIONS = 6
STEP = 1.0
# Vectors in one block of a large bucket.
BLOCK = 1024
_KEYS = ["_table", "_bucket", "_i", "_j"]


class Projections:
    """The random directions and shifts for vectors of one length, the same in every task."""

    def __init__(self, length: int, seed: int, tables: int, projections: int, step: float) -> None:
        draw = np.random.default_rng([seed, length])
        self.directions = draw.standard_normal((length, tables * projections)) / step
        self.shifts = draw.random(tables * projections)
        self.odd = draw.integers(1, 1 << 62, projections, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shape = (tables, projections)
        self.length = np.uint64(length)

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """One number per vector and table."""
        steps = np.floor(unit @ self.directions + self.shifts).astype(np.int64).astype(np.uint64)
        mixed = (steps.reshape(len(unit), *self.shape) * self.odd).sum(axis=2, dtype=np.uint64) + self.length
        mixed ^= mixed >> np.uint64(29)
        return (mixed * np.uint64(0xBF58476D1CE4E5B9)).astype(np.int64)


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and values of the vectors of each length, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield at, values.astype(np.float64).reshape(len(at), int(length))


def _unit(values: np.ndarray) -> np.ndarray:
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.95,
    tables: int = TABLES,
    projections: int = PROJECTIONS,
    step: float = STEP,
    seed: int = 7,
    block: int = BLOCK,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``vec_id``, ``embedding``."""
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & ~broken & some, F.lit(False))
    # Vectors with equal components, by their smallest id.
    classes = rows.where(usable).groupBy("embedding").agg(F.min("vec_id").alias("_rep"), F.count(F.lit(1)).alias("_n"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, values in _rows(batch["embedding"]):
                made = Projections(values.shape[1], seed, tables, projections, step)
                found = pa.array(list(made.buckets(_unit(values))), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].take(pa.array(at)) for c in ("embedding", "_rep", "_n")), found],
                    ["embedding", "_rep", "_n", "_buckets"],
                )

    hashed = cut_lineage(
        classes.mapInArrow(project, "embedding array<double>, _rep bigint, _n bigint, _buckets array<bigint>")
    )
    places = hashed.select("_rep", "_n", "embedding", F.posexplode("_buckets").alias("_table", "_bucket"))
    large = places.groupBy("_table", "_bucket").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > block)
    large = cut_lineage(large.select("_table", "_bucket", F.ceil(F.col("_size") / block).cast("int").alias("_blocks")))
    places = places.join(broadcast_if_small(large), ["_table", "_bucket"], "left")
    places = places.withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    places = places.withColumn("_own", F.pmod(F.xxhash64("_rep"), F.col("_blocks")).cast("int"))
    places = places.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    places = places.select(
        "_table", "_bucket", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"),
        "_own", "_rep", "_n", "embedding",
    )
    placed = places.repartition(*_KEYS).sortWithinPartitions(*_KEYS)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Projections] = {}
        for group in sorted_groups(batches, _KEYS):
            if group.num_rows < 2:
                continue
            rep, n, own = (group[c].to_numpy() for c in ("_rep", "_n", "_own"))
            table, i, j = (group[c][0].as_py() for c in ("_table", "_i", "_j"))
            for at, values in _rows(group["embedding"]):
                length = values.shape[1]
                if length not in made:
                    made[length] = Projections(length, seed, tables, projections, step)
                yield from _links(rep[at], n[at], own[at], _unit(values), made[length], table, i != j, threshold)

    found = cut_lineage(placed.mapInArrow(compare, "a bigint, links bigint, b bigint"))
    counts = found.groupBy(F.col("a").alias("_rep")).agg(F.sum("links").alias("_links"))
    components = connected_components(found.select("a", "b"))
    result = hashed.select("embedding", "_rep", "_n").join(counts, "_rep", "left")
    result = result.join(components.withColumnRenamed("node", "_rep"), "_rep", "left")
    result = cut_lineage(
        result.select(
            F.col("embedding"),
            (F.col("_n") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "_rep").alias("component_id"),
        )
    )
    linked = rows.where(usable).join(result, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("bigint"), "vec_id")
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(rep, n, own, unit, made, table, across, threshold) -> Iterator[pa.RecordBatch]:
    """Per vector of a bucket its links not found in an earlier table, and one edge towards the others it reaches here."""
    before = made.buckets(unit)[:, :table]
    links = np.zeros(len(rep), np.int64)
    ends_a, ends_b = [], []
    for start in range(0, len(rep), 256):
        near = unit[start : start + 256] @ unit.T >= threshold
        a, b = np.nonzero(near)
        a += start
        keep = (a < b) & ((own[a] != own[b]) if across else True)
        a, b = a[keep], b[keep]
        new = ~(before[a] == before[b]).any(axis=1)
        np.add.at(links, a[new], n[b[new]])
        np.add.at(links, b[new], n[a[new]])
        ends_a.append(a)
        ends_b.append(b)
    a, b = np.concatenate(ends_a), np.concatenate(ends_b)
    if not len(a):
        return
    label = smallest_labels(len(rep), a, b)
    told = np.flatnonzero((links > 0) | (label != np.arange(len(rep))))
    yield pa.RecordBatch.from_arrays([pa.array(rep[told]), pa.array(links[told]), pa.array(rep[label[told]])], ["a", "links", "b"])
