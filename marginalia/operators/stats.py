"""Run statistics and agent logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import last_wins_map

TIME = r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"



def timing_stats(
    runs: DataFrame,
    keys: list[str],
    seconds: str = "seconds",
    ok: str | None = None,
    steps: str | None = None,
    tokens: str | None = None,
) -> DataFrame:
    """Average, least and most seconds, run counts, and average steps and tokens; 0 where empty."""
    zero = F.lit(0.0)
    measures = [
        F.coalesce(F.avg(seconds), zero).alias("avg_seconds"),
        F.coalesce(F.min(seconds), zero).alias("min_seconds"),
        F.coalesce(F.max(seconds), zero).alias("max_seconds"),
        F.count(F.lit(1)).alias("total"),
        (F.count_if(F.col(ok)) if ok else F.count(seconds)).alias("successful"),
    ]
    for name, column in (("avg_steps", steps), ("avg_tokens", tokens)):
        if column:
            measures.append(F.coalesce(F.avg(column), zero).alias(name))
    return runs.groupBy(*keys).agg(*measures)


def parse_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``time - logger - level - message | k=v | ...`` as columns and a map.

    A line of another form keeps its text as the message.
    """
    rest = [c for c in lines.columns if c != column]
    cut = lines.select(*rest, F.col(column).alias("_line"), F.split(column, " - ", 4).alias("_part"))
    part = [F.get("_part", F.lit(i)) for i in range(4)]
    is_entry = (F.size("_part") == 4) & part[0].rlike(TIME) & part[2].rlike("^[A-Z]+$")
    read = cut.select("*", F.coalesce(is_entry, F.lit(False)).alias("_ok"), F.split(part[3], r" \| (?=\w+=)").alias("_piece"))
    pairs = F.transform(
        F.when(F.col("_ok"), F.slice("_piece", 2, F.greatest(F.size("_piece") - 1, F.lit(0)))).otherwise(F.array().cast("array<string>")),
        lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("key"), F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("value")
        ),
    )
    ok = F.col("_ok")
    return read.select(
        *rest,
        F.when(ok, F.try_to_timestamp(part[0], F.lit("yyyy-MM-dd HH:mm:ss"))).alias("logged_at"),
        F.when(ok, part[1]).alias("logger"),
        F.when(ok, part[2]).alias("level"),
        F.when(ok, F.get("_piece", F.lit(0))).otherwise(F.col("_line")).alias("message"),
        last_wins_map(pairs).alias("fields"),
    )


def parse_agent_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.read.text(path))
