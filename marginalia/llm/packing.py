"""Best-fit packing of token pieces into sequences of a fixed size.

Best-fit decreasing takes pieces from the longest to the shortest and puts each into the open
sequence with the least room that still holds it. Only lengths matter for that, so the whole
corpus is planned from its histogram of lengths: at most ``capacity`` numbers, whatever the
corpus. A segment tree over remaining room finds the tightest open sequence in logarithmic
time, and pieces of one length go into a run of equally filled sequences at once, which is
what placing them one by one would give. Tasks then look up each piece by its length and its
rank among pieces of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.tokens import encoder, short_batches, with_end
from marginalia.llm.workers import giving_back
from marginalia.session import cut_lineage

# Ranks among pieces of one length are counted in so many groups, so that a length that very
# many pieces share is not numbered by one task.
RANK_GROUPS = 256

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class RoomTree:
    """Open runs of sequences by remaining room, with a segment tree to find the tightest."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        node = room + self.size
        while node:
            self.open[node] += n
            node >>= 1

    def push(self, room: int, first: int, end: int) -> None:
        if room and first < end:
            self.runs[room].append((first, end))
            self._add(room, 1)

    def pop(self, room: int) -> tuple[int, int]:
        self._add(room, -1)
        return self.runs[room].pop()

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that an open sequence has."""
        node = least + self.size
        if self.open[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.size:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over a histogram of lengths.

    Rows (length, first rank, first sequence, pieces per sequence, offset of the first piece),
    sorted by length and rank; each holds for the ranks up to the next row's.
    """
    tree, opened, rows = RoomTree(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                first, room, end = opened, capacity, opened + -(-left // each)
                opened = end
            else:
                first, end = tree.pop(room)
                each = room // length
            full = min(end - first, left // each)
            if not full:  # fewer pieces are left than one sequence takes
                rows.append((length, rank, first, each, capacity - room))
                tree.push(room - left * length, first, first + 1)
                tree.push(room, first + 1, end)
                break
            rows.append((length, rank, first, each, capacity - room))
            tree.push(room - each * length, first, first + full)
            tree.push(room, first + full, end)
            rank, left = rank + full * each, left - full * each
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` token ids, the end id included.

    A null text is an empty one and gives one piece with the end id alone. With ``with_ids``
    the pieces carry their ids.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in short_batches(batches):
            ids, starts = with_end(*words.encode(batch["text"]), end)
            sizes = np.diff(starts)
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, sizes[row] - start)
            at = starts[:-1][row] + start
            crc = [zlib.crc32(ids[i : i + k].astype("<u4").tobytes()) for i, k in zip(at, length)]
            columns = [
                batch["doc_id"].take(pa.array(row)),
                pa.array(piece, pa.int32()),
                pa.array(start),
                pa.array(length),
                pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                values = pa.array(ids.astype(np.int32))
                bounds = np.concatenate([at, [len(ids)]]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), values))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(giving_back(cut, encoder), _PIECES + (", ids array<int>" if with_ids else ""))


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    Every row gets a place; sequences are filled without gaps from 0. Rows may repeat. An
    empty table gives an empty one. ``pieces`` is read several times: pass a written table.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = pieces.select(*names, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_GROUPS)).alias("_group"))
    counts = rows.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n"))
    # At most one row per length.
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(best_fit_plan(histogram, capacity))
    order = W.partitionBy("length").orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("length", "_group", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    ties = ["doc_id", "piece", *(["ids_crc32"] if "ids_crc32" in names else [])]
    ranked = rows.withColumn("_at", F.row_number().over(W.partitionBy("length", "_group").orderBy(*ties)))
    ranked = ranked.join(before, ["length", "_group"]).withColumn("_rank", F.col("_before") + F.col("_at") - 1)
    schema = pieces.select(*names).schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = plan.value
        span = int(max(histogram.values(), default=0)) + 1
        keys = steps[:, 0] * span + steps[:, 1]
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            step = steps[np.searchsorted(keys, length * span + rank, side="right") - 1]
            later = rank - step[:, 1]
            out = [batch[c] for c in names]
            out += [pa.array(step[:, 2] + later // step[:, 3]), pa.array(step[:, 4] + later % step[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(out, [*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(giving_back(place, encoder), schema)


def pack_documents(
    docs: DataFrame, capacity: int = 2048, tokenizer: str = "word_bpe_49k.json", end: int = 0, with_ids: bool = False
) -> DataFrame:
    """Pack ``doc_id``, ``text`` into sequences of at most ``capacity`` ids.

    Only documents longer than a sequence are cut. Null texts are empty, rows may repeat, very
    long texts are encoded whole, an empty table gives an empty result, other columns are not
    read. ``with_ids`` carries every piece's ids; ``sequences`` joins them.
    """
    return pack_pieces(cut_lineage(token_pieces(docs, tokenizer, capacity, end, with_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of every sequence, from pieces with ``ids``: at most one capacity per group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids")
    )
