import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from marginalia.session import session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    built = session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
            "spark.driver.memory": "8g",
        },
    )
    built.sparkContext.setLogLevel("ERROR")
    ship(built)
    yield built
    built.stop()


@pytest.fixture
def one(spark):
    """Value of a Column expression on one row of one text."""

    def value(text, expression):
        from pyspark.sql import functions as F

        return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("v")).first().v

    return value
