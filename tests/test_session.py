from pathlib import Path

import pytest

import checks
from marginalia import session as se
from marginalia.plans import indexing as ix
from marginalia.sources.files import scan_files


def test_checkpoint_folder_is_the_named_one(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert se.checkpoint_dir(spark) == named
    written = se.cut_lineage(spark.range(3))
    assert named in written.inputFiles()[0] and written.count() == 3


class Elsewhere:
    """A cluster session without a checkpoint folder."""

    class conf:
        get = staticmethod(lambda key, default: default)

    class sparkContext:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)


def test_a_cluster_must_name_its_folder():
    with pytest.raises(ValueError):
        se.checkpoint_dir(Elsewhere)


@pytest.mark.parametrize("wanted", [[1], [1, 2, 3, 4]])
@pytest.mark.parametrize("bound", [0, 100])
def test_keep_listed(spark, monkeypatch, wanted, bound):
    monkeypatch.setattr(se, "BROADCAST_ROWS", bound)
    rows = spark.range(6).selectExpr("id AS k", "id * 10 AS v")
    listed = rows.select("k")
    kept = se.keep_listed(rows, listed, spark.createDataFrame([(k,) for k in wanted], "k bigint"), "k")
    assert sorted(r.v for r in kept.collect()) == [k * 10 for k in wanted]


def test_temporary_tables_go(spark, tmp_path):
    kept = se.cut_lineage(spark.range(2))
    with se.temporary_tables(spark):
        inner = se.cut_lineage(spark.range(3))
        path = inner.inputFiles()[0]
        assert inner.count() == 3
    assert not Path(path.removeprefix("file://")).exists() and kept.count() == 2


def test_many_small_files_are_few_tasks(spark, tmp_path, monkeypatch):
    for n in range(700):
        (tmp_path / f"{n}.txt").write_text(f"text {n}")
    files = scan_files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() > 20
    # Indexing reads its files that way, and leaves the session as it was.
    monkeypatch.setattr(ix, "_index", lambda *_: scan_files(spark, str(tmp_path)).rdd.getNumPartitions())
    held = {name: spark.conf.get(name) for name in se.MANY_FILES}
    assert ix.index_documents(files, str(tmp_path / "index")) <= 8
    assert {name: spark.conf.get(name) for name in se.MANY_FILES} == held


@pytest.mark.parametrize("held, then", [("10000", "1000"), ("200", "200"), ("0", "1000")])
def test_queries_keep_arrow_batches_short(spark, held, then):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, held)
        checks.query("probe")(lambda spark, directory: spark.range(1))
        checks.QUERIES["probe"](spark, "nowhere")
        assert spark.conf.get(name) == then
    finally:
        del checks.QUERIES["probe"]
        spark.conf.set(name, before)
