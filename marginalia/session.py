"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Narrow rows (an id, a path) up to this number may be broadcast, once they are counted.
BROADCAST_ROWS = 500_000

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Pages and long documents are wide rows, so Arrow batches are kept short.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


# Of the settings those that any session can take on later.
LATER = ("spark.sql.session.timeZone", "spark.sql.execution.arrow.maxRecordsPerBatch")


def adopt(spark: SparkSession) -> None:
    """Give a session built elsewhere the settings that results and the memory of Python workers depend on.

    A lower number of records in a batch stays.
    """
    for key in LATER:
        held = spark.conf.get(key)
        if key.endswith("maxRecordsPerBatch") and 0 < int(held) < int(SETTINGS[key]):
            continue
        spark.conf.set(key, SETTINGS[key])


def session(app: str = "marginalia", master: str | None = None, **conf) -> SparkSession:
    """Build a session; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme; one without is in Spark's default file system, for driver and executors alike."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(target).toString()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local folder is lost with the machine.
    """
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not known:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        known = tempfile.mkdtemp(prefix="marginalia-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(known)
    return known.rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession):
    """Remove what ``cut_lineage`` writes inside, at the end: for jobs that have finished by then."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame, outlive: bool = False) -> DataFrame:
    """Write the rows to the shared folder and go on from there.

    The rows survive the loss of any executor, are computed once however often they are
    used, and are read by column; their size is known to the optimizer. With ``outlive`` the
    table is left to the scope of ``temporary_tables`` around the present one.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    scopes = _scopes[:-1] if outlive else _scopes
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting, up to the bound, that the rows are few."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def keep_listed(rows: DataFrame, listed: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in ``wanted``, a part of the unique keys in ``listed``.

    The test is made against the shorter of the two possible lists, so that wide rows stay
    where they are read as long as few keys are wanted, or few are not. Both lists should
    be written tables, as they are counted.
    """
    n = wanted.count()
    rest = listed.count() - n
    if n <= rest:
        keys, how, size = wanted.select(key), "left_semi", n
    else:
        keys, how, size = listed.select(key).join(wanted.select(key), key, "left_anti"), "left_anti", rest
    return rows.join(F.broadcast(keys) if size <= BROADCAST_ROWS else keys, key, how)


# Opening a file counts as 64 KB: Spark's 4 MB gives every 32 small files a task of their own. Lists of paths are looked up in a few hundred tasks, not in 10,000.
MANY_FILES = {"spark.sql.files.openCostInBytes": "65536", "spark.sql.sources.parallelPartitionDiscovery.parallelism": "240"}


@contextmanager
def many_files(spark: SparkSession):
    """Tasks that read some hundreds of small files each, for jobs that have finished by the end of the scope."""
    held = {name: spark.conf.get(name) for name in MANY_FILES}
    for name, value in MANY_FILES.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)


_shipped: set[tuple[str, str]] = set()


def ship(spark: SparkSession, *packages: Path) -> None:
    """Send packages to the Python workers, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    for package in packages or (Path(__file__).parent,):
        if (context.applicationId, str(package)) in _shipped:
            continue
        archive = Path(tempfile.mkdtemp(prefix="marginalia-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add((context.applicationId, str(package)))
