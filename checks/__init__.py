"""The registered queries: one per operator, with equivalent SQL where SQL can say it."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from marginalia.session import adopt, checkpoint_dir, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, directory) under ``name``."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        @functools.wraps(function)
        def run(spark: SparkSession, directory: str) -> DataFrame:
            here = Path(__file__).resolve().parent
            ship(spark, here.parent / "marginalia", here)
            adopt(spark)
            return function(spark, directory)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that every executor can reach."""
    return f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"


def load() -> None:
    from checks import context, files, memory, pages, search, streams, text  # noqa: F401
