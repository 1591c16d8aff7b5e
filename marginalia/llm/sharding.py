"""Reproducible shuffle into shards by a Feistel permutation of row numbers.

Rows are numbered from 0 in the order of their keys. A Feistel network over pairs of digits
permutes a range slightly larger than the number of rows, and numbers that fall outside are
permuted again until they fall inside (cycle walking), so every row has its own place. The
place's remainder by the number of shards is the shard, the quotient the slot in it: both are
computed from the row number alone. DataFrame functions throughout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.numbering import number_rows

ROUNDS = 6
# Walks outside are shorter than the larger digit, and each step leaves the range with a
# chance of at most 1 / that digit; a longer walk raises an error.
MAX_WALK = 64
# A prime and multipliers that keep all products within 64 bits.
PRIME, MULTIPLIER, STEP = (1 << 31) - 1, 48271, 69621


def _mixed(x: Column, round_no: Column, seed: int) -> Column:
    y = ((x % PRIME) * MULTIPLIER + round_no * STEP + (seed % PRIME)) % PRIME
    return F.floor((y * y + y * STEP) % PRIME / 7).cast("bigint")


def _permuted(x: Column, high: int, low: int, seed: int) -> Column:
    """One pass of the network over numbers below ``high * low``."""

    def step(pair: Column, i: Column) -> Column:
        a, b = pair["a"], pair["b"]
        return F.when(i % 2 == 0, F.struct(((a + _mixed(b, i, seed)) % high).alias("a"), b.alias("b"))).otherwise(
            F.struct(a.alias("a"), ((b + _mixed(a, i, seed)) % low).alias("b"))
        )

    start = F.struct(F.floor(x / low).cast("bigint").alias("a"), (x % low).cast("bigint").alias("b"))
    rounds = F.sequence(F.lit(0).cast("bigint"), F.lit(ROUNDS - 1).cast("bigint"))
    return F.aggregate(rounds, start, step, lambda pair: pair["a"] * low + pair["b"])


def place_of(row: Column, rows: int, seed: int) -> Column:
    """Place of a row number below ``rows`` after the shuffle: a permutation of 0 to rows - 1."""
    if rows < 2:
        return row.cast("bigint")
    high = math.isqrt(rows - 1) + 1
    low = -(-rows // high)
    again = F.array_repeat(F.lit(0), MAX_WALK - 1)
    walked = F.aggregate(
        again, _permuted(row, high, low, seed), lambda at, _: F.when(at < rows, at).otherwise(_permuted(at, high, low, seed))
    )
    return F.when(walked < rows, walked).otherwise(F.raise_error(F.lit("no place found; choose another seed")).cast("bigint"))


def shard_rows(df: DataFrame, shards: int, seed: int = 0, order: str = "doc_id") -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (from 0, without gaps) to every row.

    Shard sizes differ by one row at most. Rows are numbered by ``order``; rows that tie on it,
    or hold null (first), are numbered in the order they are read. Columns named ``shard`` and
    ``slot`` are replaced. An empty table gives an empty one. All columns of ``df`` are written
    once, so pass narrow rows and join wide ones by key. Shuffles once, by ranges of the order
    and a tie, so that one key with very many rows is spread too.
    """
    rest = df.drop("shard", "slot").withColumn("_tie", F.monotonically_increasing_id())
    numbered = number_rows(rest, [order, "_tie"], "_row", first=0)
    place = place_of(F.col("_row"), numbered.count(), seed)
    placed = numbered.withColumn("_place", place)
    return placed.select(
        *df.drop("shard", "slot").columns,
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("bigint").alias("slot"),
    )


def shard_documents(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Shard, slot, size (UTF-8 bytes and 16) and checksum of every document; texts are not moved.

    A null text counts as empty. Repeated ids and rows keep all their rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col("doc_id"), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return shard_rows(narrow, shards, seed)


def write_shards(df: DataFrame, folder: str) -> None:
    """Write sharded rows as Parquet folders by shard, each file sorted by slot; large shards as several files."""
    rows = df.withColumn("_file", F.floor(F.col("slot") / 1_000_000))
    rows = rows.repartition("shard", "_file").sortWithinPartitions("shard", "slot")
    rows.drop("_file").write.partitionBy("shard").parquet(folder)
