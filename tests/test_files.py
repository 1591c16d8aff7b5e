import csv
import datetime as dt
import hashlib
import io
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

import checks
from checks import search
from marginalia.operators.stats import timing_stats
from marginalia.plans import indexing as ix
from marginalia.sources import csv_rows
from marginalia.sources import files as fs
from marginalia.sources import summaries as su
from marginalia.sources import tables as tb

TEXT = "Salt is won from sea water in shallow ponds, where sun and wind dry it."


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    (root / "below").mkdir(parents=True)
    (root / "salt.txt").write_text(TEXT)
    (root / "UPPER.TXT").write_bytes("café\r\nline".encode())
    (root / "broken.md").write_bytes(b"ok \xff\xfe end")
    (root / "data.json").write_text('{"b": [1, {"c": "ü"}], "a": null}')
    (root / "bad.json").write_text("{no json")
    (root / "t.csv").write_text('name, note \nAda," x ""y"" "\nBob\n')
    (root / "page.html").write_text("<title>T</title><nav><p>no</p></nav><p>body</p>")
    (root / "empty.py").write_text("")  # Spark's file sources leave empty files out
    (root / "scan.pdf").write_bytes(b"%PDF")
    (root / "skip.exe").write_bytes(b"x")
    (root / "below" / "deep.txt").write_text("deep")
    return str(root)


def test_scan_files(spark, folder):
    rows = {r.filename: r for r in fs.scan_files(spark, folder).collect()}
    assert set(rows) == set(os.listdir(folder)) - {"below", "skip.exe", "empty.py"}
    assert rows["UPPER.TXT"].type == "txt" and rows["UPPER.TXT"].path == f"{folder}/UPPER.TXT"
    assert rows["salt.txt"].size_bytes == len(TEXT)


def test_contents_are_read_only_when_used(spark, folder):
    plan = fs.scan_files(spark, folder).select("path", "size_bytes")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_readers(spark, folder):
    files = fs.scan_files(spark, folder)
    texts = {r.filename: r.text for r in fs.read_text_docs(files).collect()}
    assert texts == {"salt.txt": TEXT, "UPPER.TXT": "café\nline", "broken.md": "ok  end"}
    bad, page = fs.read_json_docs(files).orderBy("filename").collect()
    assert bad.text == "{no json"
    assert page.text == json.dumps({"b": [1, {"c": "ü"}], "a": None}, indent=2)
    assert [r.text for r in fs.read_html_docs(files).collect()] == ["T\n\nbody"]
    pages = {(r.filename, r.page_no): r.text for r in fs.extract_pages(files).collect()}
    assert pages == {
        **{(name, 0): text for name, text in texts.items()},
        ("data.json", 0): page.text,
        ("bad.json", 0): bad.text,
        ("page.html", 0): "T\n\nbody",
        ("t.csv", 0): 'name: Ada\nnote: x "y"',
        ("t.csv", 1): "name: Bob\nnote: None",
    }


def dict_rows(content):
    """The pages by the standard library's reader."""
    rows = csv.DictReader(io.StringIO(content.decode("utf-8", "ignore"), newline=""))
    return ["\n".join(fs._csv_line(k, v) for k, v in row.items()) for row in rows]


def test_csv_rows_over_any_splits(spark, tmp_path, monkeypatch):
    """Line ends, quotes and commas in fields, with borders of splits between any lines, against the standard library."""
    rng = random.Random(1)
    parts = ["a", "é", ",", '"', "\n", "\r\n", " ", "x" * 9, '""', '","', '"\n"']
    files = {}
    for n in range(12):
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator=["\n", "\r\n"][n % 2], quoting=[csv.QUOTE_MINIMAL, csv.QUOTE_ALL][n % 3 > 0])
        writer.writerow(["one", "two\nlines", "three"][: 2 + n % 2])
        for _ in range(30):
            writer.writerow(["".join(rng.choices(parts, k=rng.randint(0, 6))) for _ in range(rng.randint(1, 4))])
        files[f"f{n}.csv"] = out.getvalue().encode()
    files["literal.csv"] = b'a,b\n5" pipe,"x"y\n\n\r\nlast "q",1\n"two" more,"open\nto the end'
    files["bytes.csv"] = b'k,v\n\xff1,"\xfe\n2"\n'
    files["head.csv"] = b"only,header\n"
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    wanted = {name: list(enumerate(dict_rows(content))) for name, content in files.items()}
    wanted = {name: rows for name, rows in wanted.items() if rows}

    def found():
        pages = {}
        for r in fs.read_csv_docs(spark, str(tmp_path)).orderBy("path", "page_no").collect():
            pages.setdefault(r.path.rsplit("/", 1)[1], []).append((r.page_no, r.text))
        return pages

    assert found() == wanted
    # The same lines, as if splits of a few lines had been read.
    lines = []
    for name, content in files.items():
        block = 0
        for i, line in enumerate(content.removesuffix(b"\n").split(b"\n")):
            block = i * 10 if rng.random() < 0.4 else block
            lines.append((f"file:{tmp_path}/{name}", block, line))
    split = spark.createDataFrame(lines, "path string, block bigint, line binary").coalesce(1)
    assert split.select("path", "block").distinct().count() > 100
    monkeypatch.setattr(csv_rows, "csv_lines", lambda *_: split)
    assert found() == wanted
    monkeypatch.setattr(csv_rows, "broadcast_if_small", lambda df: df)
    assert found() == wanted


def test_a_csv_file_is_read_in_many_tasks(spark, tmp_path):
    rows = [[str(i), f'line "{i}"\nand, more ' + "y" * (i % 50)] for i in range(4000)]
    with open(tmp_path / "big.csv", "w", newline="") as out:
        csv.writer(out).writerows([["no", "text"], *rows])
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 30_000)
        assert csv_rows.csv_lines(spark, str(tmp_path)).rdd.getNumPartitions() >= 5
        found = [(r.page_no, r.text) for r in fs.read_csv_docs(spark, str(tmp_path)).orderBy("page_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert found == [(i, f"no: {n}\ntext: {t.strip()}") for i, (n, t) in enumerate(rows)]


def test_long_fields_and_broken_files(spark, tmp_path):
    """A field beyond the limit of the standard library, alone and while indexing; a file that cannot be parsed stays text."""
    long = "word " * 40_000
    (tmp_path / "long.csv").write_text(f'k,v\n1,"{long}"\n2,x\n')
    (tmp_path / "null.json").write_text("[" * 100_000)
    assert [len(r.text) for r in fs.read_csv_docs(spark, str(tmp_path)).orderBy("page_no").collect()] == [len("k: 1\nv: ") + len(long) - 1, len("k: 2\nv: x")]
    pages = {(r.filename, r.page_no): len(r.text) for r in fs.extract_pages(fs.scan_files(spark, str(tmp_path))).collect()}
    assert pages == {("long.csv", 0): len("k: 1\nv: ") + len(long) - 1, ("long.csv", 1): 9, ("null.json", 0): 100_000}


def test_read_csv_docs(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,note\nAda,"two\nlines, ""q"""\nBob, x \nCy,1,2,3\n')
    (tmp_path / "b.csv").write_text("z,w\n8,9\n")
    rows = [(r.path[-5:], r.page_no, r.text) for r in fs.read_csv_docs(spark, str(tmp_path)).orderBy("path", "page_no").collect()]
    assert rows == [
        ("a.csv", 0, 'name: Ada\nnote: two\nlines, "q"'),
        ("a.csv", 1, "name: Bob\nnote: x"),
        ("a.csv", 2, "name: Cy\nnote: 1\nNone: 2,3"),
        ("b.csv", 0, "z: 8\nw: 9"),
    ]
    assert {(r.path[-5:], r.page_no, r.text) for r in fs.extract_pages(fs.scan_files(spark, str(tmp_path))).collect()} == set(rows)


def test_names_are_taken_as_they_are(spark, tmp_path):
    (tmp_path / "50%41+x.txt").write_text("a")
    (row,) = fs.scan_files(spark, str(tmp_path)).collect()
    assert row.filename == "50%41+x.txt" and row.path.endswith("/50%41+x.txt")


def test_one_batch_or_many(spark, tmp_path):
    """Scores do not depend on how documents arrived."""
    texts = {"a.txt": "moon and sun", "b.txt": "moon moon tide", "c.py": "import os\nfrom sys import path\nmoon = 1\n"}
    whole, split = str(tmp_path / "whole"), str(tmp_path / "split")
    (tmp_path / "d").mkdir()
    for name, text in texts.items():
        (tmp_path / "d" / name).write_text(text)
        ix.index_documents(fs.scan_files(spark, str(tmp_path / "d")), split)
    ix.index_documents(fs.scan_files(spark, str(tmp_path / "d")), whole)
    asked = spark.createDataFrame([(1, "the moon")], "query_id int, text string")
    one, many = ([(r.rank, r.filename, r.score) for r in ix.search_documents(asked, i).orderBy("rank").collect()] for i in (whole, split))
    assert one == many and len(one) == 3
    code = {r.filename: r.metadata for r in ix.search_documents(asked, whole).collect()}["c.py"]
    assert code["language"] == "python" and code["line_count"] == "4" and code["imports"] == '["import os","from sys import path"]'
    path = f"{tmp_path}/d/c.py"
    keys = spark.createDataFrame([(path,), ("/lost/c.py",), ("zz",)], "key string")
    (found,) = ix.read_documents(keys, whole).collect()
    assert (found.key, found.filename, found.summary) == (path, "c.py", texts["c.py"]) and found.metadata["content_type"] == "code"
    assert ix.read_documents(keys, str(tmp_path / "none")).count() == 0


def search_rows(spark, index, text="the moon"):
    asked = spark.createDataFrame([(1, text)], "query_id int, text string")
    return [(r.rank, r.filename, r.score) for r in ix.search_documents(asked, index, k=9).orderBy("rank").collect()]


def test_runs_that_meet_leave_one_set_of_chunks(spark, tmp_path, monkeypatch):
    """Two runs at once, and a run that is made again, are as one run."""
    (tmp_path / "d").mkdir()
    for n in range(6):
        (tmp_path / "d" / f"{n}.txt").write_text(f"moon {n} " + "tide " * n)
    files = fs.scan_files(spark, str(tmp_path / "d"))
    once, again, both = (str(tmp_path / n) for n in ("once", "again", "both"))
    ix.index_documents(files, once)
    for _ in range(2):
        ix.index_documents(files, again, run="batch-0")
    # What the second run sees is from before the first one wrote.
    seen = ix._known(spark, both, "b")
    ix.index_documents(files.where("filename < '4.txt'"), both, run="a")
    with monkeypatch.context() as patch:
        patch.setattr(ix, "_known", lambda *_: seen)
        ix.index_documents(files, both, run="b")
    wanted = search_rows(spark, once)
    for index in (again, both):
        chunks = ix.read_chunks(spark, index)
        assert chunks.count() == chunks.select("chunk_id").distinct().count() == 6
        assert ix.read_pages(spark, index).count() == 6
        assert search_rows(spark, index) == wanted
    assert {r.run for r in spark.read.parquet(f"{both}/chunks").select("run").distinct().collect()} == {"a", "b"}


def test_look_ups_read_the_runs_of_their_documents(spark, tmp_path):
    """Only files of the runs that hold a document are read, however many runs there are."""
    index = str(tmp_path / "index")
    (tmp_path / "d").mkdir()
    for n in range(4):
        (tmp_path / "d" / f"{n}.txt").write_text(f"text number {n}")
        ix.index_documents(fs.scan_files(spark, str(tmp_path / "d")), index, run=f"r{n}")
    wanted = hashlib.sha256(b"text number 2").hexdigest()
    rows = ix.read_pages(spark, index, spark.createDataFrame([(wanted,)], "doc_id string"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    runs, pushed = (plan.split(f"{name}: [")[1].split("]")[0] for name in ("PartitionFilters", "PushedFilters"))
    assert "run" in runs and "r2" in runs and "r1" not in runs and "doc_id" in pushed
    assert [r.text for r in rows.collect()] == ["text number 2"]


def test_frequencies_merge(spark, tmp_path):
    """A word that all documents have counts less than a rare one."""
    (tmp_path / "d").mkdir()
    for n in range(8):
        (tmp_path / "d" / f"{n}.txt").write_text("common " + ("gem" if n == 5 else f"w{n}") + " filler")
    index = str(tmp_path / "i")
    ix.index_documents(fs.scan_files(spark, str(tmp_path / "d")), index)
    weights = ix.index_weights(spark, index)
    assert weights.min() == 1 and weights.max() == pytest.approx(1 + math.log(9))
    assert search_rows(spark, index, "common gem")[0][1] == "5.txt"


def test_index_and_search(spark, folder, tmp_path):
    index = str(tmp_path / "index")
    files = fs.scan_files(spark, folder)
    questions = spark.createDataFrame([(1, "salt from sea water"), (2, "name Ada")], "query_id int, text string")
    assert ix.search_documents(questions, index).count() == 0
    assert ix.index_documents(files, index) == {"found": 8, "indexed": 7}
    rows = {r.filename: r for r in tb.read_registry(spark, index + "/registry").collect()}
    assert set(rows) == {"salt.txt", "UPPER.TXT", "broken.md", "data.json", "bad.json", "t.csv", "page.html"}
    assert rows["salt.txt"].id == hashlib.sha256(TEXT.encode()).hexdigest()

    # The same again adds no chunk; a copy elsewhere moves its document; a new file is added.
    chunks = ix.read_chunks(spark, index).count()
    with open(f"{folder}/z_copy.txt", "w") as out:
        out.write(TEXT)
    with open(f"{folder}/new.md", "w") as out:
        out.write("moon " * 500)
    assert ix.index_documents(fs.scan_files(spark, folder), index) == {"found": 10, "indexed": 8}
    rows = {r.filename: r for r in tb.read_registry(spark, index + "/registry").collect()}
    assert "z_copy.txt" in rows and "salt.txt" not in rows and len(rows) == 8
    assert ix.read_chunks(spark, index).count() == chunks + 3

    found = ix.search_documents(questions, index, k=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank) for r in found] == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert found[0].content == TEXT and found[0].document_id == rows["z_copy.txt"].id and found[0].filename == "z_copy.txt"
    assert found[2].content == 'name: Ada\nnote: x "y"' and found[2].metadata["source"].endswith("t.csv")


def test_index_with_own_embedder(spark, folder, tmp_path):
    index = str(tmp_path / "index")

    def embed(texts):
        return [[float("Ada" in t), float("moon" in t)] for t in texts]

    ix.index_documents(fs.scan_files(spark, folder), index, embed)
    asked = spark.createDataFrame([(1, "Ada?")], "query_id int, text string")
    (hit,) = ix.search_documents(asked, index, 1, embed).collect()
    assert hit.content.startswith("name: Ada") and hit.score == 0


def test_search_table_finds_the_passage(spark):
    docs = spark.createDataFrame(
        [(1, "red apples grow", "a"), (2, "deep blue sea", "b"), (3, "deep blue sea", "c"), (4, "stars shine at night", "d")],
        "doc_id int, text string, source string",
    )
    asked = spark.createDataFrame([(1, "the blue sea")], "query_id int, text string")
    found = ix.search_table(asked, docs, 4).orderBy("rank").collect()
    assert found[0].doc_id == 2 and found[0].source == "b" and len(found) == 3


def entry(name, path, day):
    return (name, "f", path, "txt", None, dt.datetime(2024, 1, day), 3, None)


def test_registry(spark, tmp_path):
    path = str(tmp_path / "registry")
    assert tb.read_registry(spark, path).count() == 0
    tb.write_registry(spark.createDataFrame([entry("i", "old", 1), entry("j", "only", 1)], tb.REGISTRY_SCHEMA), path)
    tb.write_registry(spark.createDataFrame([entry("i", "new", 2)], tb.REGISTRY_SCHEMA), path)
    assert {(r.id, r.path) for r in tb.read_registry(spark, path).collect()} == {("i", "new"), ("j", "only")}
    for name in os.listdir(path):
        if name.endswith(".parquet"):
            os.remove(f"{path}/.{name}.crc")
            open(f"{path}/{name}", "w").write("broken")
    with pytest.raises(Exception):
        tb.read_registry(spark, path).collect()


def test_summaries(spark, tmp_path):
    root = str(tmp_path / "s")
    long = "why " * 20
    rows = [("Über-Café: what's new?", "# Text\n---\nmore", "2023-01-01 12:00:00"), (long, "b", "2023-01-02 12:00:00"), (long, "c", "2023-01-02 12:00:00")]
    df = spark.createDataFrame(rows, "query string, summary string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    su.write_summaries(df, root)
    su.write_summaries(df, root)
    assert sorted(os.listdir(root))[-1] == "über_café_whats_new_1672574400.md" and len(os.listdir(root)) == 3
    open(f"{root}/plain.md", "w").write("no front")
    open(f"{root}/other.md", "w").write('---\na: "1"\nb:2\na: x: y\n---\nrest')
    os.utime(f"{root}/plain.md", (1, 1))
    read = su.read_summaries(spark, root).collect()
    assert read[-1].filename == "plain.md" and read[-1].query == read[-1].date == "Unknown" and read[-1].body == "no front"
    found = {r.filename: r for r in read}["über_café_whats_new_1672574400.md"]
    assert found.query == "Über-Café: what's new?" and found.written_at == dt.datetime(2023, 1, 1, 12)
    assert found.body == "\n\n# Text\n---\nmore\n"
    assert {r.query for r in read if r.query.startswith("why")} == {(long.strip() + " ")[:50] + "..."}
    fields = {r.filename: r for r in su.summary_fields(su.read_summary_files(spark, root)).collect()}
    assert fields["other.md"].front == {"a": "x: y", "b": "2"} and fields["other.md"].body == "\nrest"
    assert fields["plain.md"].front == {}


def test_write_metrics(spark, tmp_path):
    runs = spark.createDataFrame([(1.0,), (2.0,)], "seconds double")
    tb.write_metrics(timing_stats(runs, []), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().avg_seconds == 1.5


def test_files_of_documents_lie_in_bounded_folders(spark, tmp_path, monkeypatch):
    checks.load()
    texts = [f"text {i % 9} of a document" for i in range(23)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(search, "FOLDER_FILES", 6)
    top, cuts = search.document_files(spark, str(tmp_path))
    held = [sorted(os.listdir(p.removeprefix("file://"))) for p in search.folders(top, cuts)]
    names = [[n for n in one if n.endswith(".txt")] for one in held]
    assert len(names) > 2 and max(map(len, names)) < 12
    assert sum(names, []) == sorted(f"doc_{i}.txt" for i in range(23))
    listed = []
    monkeypatch.setattr(search.fs, "scan_files", lambda s, p, scan=fs.scan_files: listed.append(scan(s, p).count()) or scan(s, p))
    last = {hashlib.sha256(t.encode()).hexdigest(): max(f"doc_{i}.txt" for i in range(23) if texts[i] == t) for t in texts}
    for name in ("index_documents", "index_stream"):
        found = checks.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(r.id for r in found) == sorted(last)
    assert max(listed) < 12 and sum(listed) == 23
    assert {r.id: r.filename for r in checks.QUERIES["index_documents"](spark, str(tmp_path)).collect()} == last
    read = checks.QUERIES["read_documents"](spark, str(tmp_path)).collect()
    assert sorted((r.kind, r.id, r.filename) for r in read) == sorted((k, *x) for x in last.items() for k in ("id", "short", "path"))
