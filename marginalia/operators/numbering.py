"""Sequential row numbers without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.session import cut_lineage


def number_rows(df: DataFrame, order: list[str], out: str, first: int = 1) -> DataFrame:
    """Number the rows in the given order.

    Rows are range-partitioned and sorted, and written with their places so that a lost
    executor cannot change them. Only the row count of each partition is added up in one
    place.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(
        sorted_rows.select(
            "*", F.spark_partition_id().alias("_row_part"), F.monotonically_increasing_id().alias("_row_at")
        )
    )
    per_part = placed.groupBy("_row_part").agg(F.count(F.lit(1)).alias("_row_n"))
    before = F.sum("_row_n").over(W.orderBy("_row_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = per_part.select("_row_part", F.coalesce(before, F.lit(0)).alias("_row_before"))
    within = F.col("_row_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), "_row_part").select(
        *df.columns, (F.col("_row_before") + within + first).cast("bigint").alias(out)
    )
