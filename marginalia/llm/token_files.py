"""Token ids in flat binary files that can be memory-mapped.

A folder holds, per part of the documents in ascending order of their ids,
``part-N.tokens`` (unsigned integers, little-endian), ``part-N.offsets`` (64-bit places in
the former where documents begin, and its end) and ``part-N.docs`` (64-bit document ids),
and one ``manifest.json`` with the width of an id and, per partition, its documents, how many of
them at its beginning have a null id, its tokens and its base: the tokens of all partitions before
it, by prefix sums.

Null texts count as empty; every document ends with the end id, so no document is empty.
Rows with equal or null ids keep all their rows, nulls first, those of one id by the checksum of
their tokens. An empty table gives a manifest
without partitions. Texts are encoded whole. Other columns are not read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.tokens import encoder, short_batches, with_end
from marginalia.llm.workers import giving_back
from marginalia.session import qualified

_WRITTEN = "part int, docs bigint, tokens bigint, nulls bigint"
_READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
# Documents read from a file at a time.
_AT_ONCE = 4096


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    uri = "s3" + folder[3:] if folder.startswith(("s3a:", "s3n:")) else folder
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _token_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class _Part:
    """The files of one part while they are written: under names of their own, and renamed at the end."""

    kinds = ("tokens", "offsets", "docs")

    def __init__(self, files: fs.FileSystem, base: str, part: int) -> None:
        self.files, self.base, self.part, self.mark = files, base, part, uuid.uuid4().hex
        self.docs = self.tokens = self.nulls = 0
        files.create_dir(base, recursive=True)
        self.out = {k: files.open_output_stream(f"{base}/.{self.mark}.{k}") for k in self.kinds}

    def add(self, doc_ids: pa.Array, ids: pa.Array, width: int) -> None:
        sizes = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // width
        for row in ids:
            self.out["tokens"].write(row.as_buffer())
        self.out["offsets"].write((np.cumsum(sizes) - sizes + self.tokens).astype("<u8").tobytes())
        self.out["docs"].write(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        self.docs, self.tokens, self.nulls = self.docs + len(ids), self.tokens + int(sizes.sum()), self.nulls + doc_ids.null_count

    def close(self) -> pa.RecordBatch:
        self.out["offsets"].write(np.array([self.tokens], "<u8").tobytes())
        for k, stream in self.out.items():
            stream.close()
            target = f"{self.base}/part-{self.part}.{k}"
            # Another attempt of the task may have written the same file.
            if self.files.get_file_info(target).type != fs.FileType.NotFound:
                self.files.delete_file(target)
            self.files.move(f"{self.base}/.{self.mark}.{k}", target)
        told = {"part": self.part, "docs": self.docs, "tokens": self.tokens, "nulls": self.nulls}
        return pa.RecordBatch.from_pylist([told], pa.schema([("part", pa.int32()), *((k, pa.int64()) for k in ("docs", "tokens", "nulls"))]))


def _bounds(rows: DataFrame) -> np.ndarray:
    """Document ids that cut the rows into about equal parts, as many as there are shuffle partitions; an id of many rows comes several times."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Quantiles of the ids alone; the texts are not read for them.
    found = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10 * parts).alias("b")).first().b
    return np.array(found if found and parts > 1 else [], np.int64)


def _parts(doc_ids: pa.Array, ties: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The part of each row: by its id; rows of an id that is a bound, or several, are dealt out by their checksum, in its order."""
    ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
    below, upto = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    dealt = below + (ties * (upto - below + 1) >> 32)
    return np.where(doc_ids.is_null().to_numpy(zero_copy_only=False), 0, dealt).astype(np.int32)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end: int = 0) -> str:
    """Write ``doc_id``, ``text`` to a new folder that driver and executors share; returns it with its scheme.

    A part's files are written under names of their own and renamed at the end, so a task may
    run again, or twice.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    kind = _token_type(encoder(tokenizer).vocabulary)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    bounds = _bounds(rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in short_batches(batches):
            ids, starts = with_end(*words.encode(batch["text"]), end)
            packed = [ids[a:b].astype(kind).tobytes() for a, b in zip(starts, starts[1:])]
            ties = np.array([zlib.crc32(p) for p in packed], np.int64)
            columns = [pa.array(_parts(batch["doc_id"], ties, bounds)), batch["doc_id"], pa.array(ties), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "tie", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _place(folder)
        width = np.dtype(kind).itemsize
        out: _Part | None = None
        for batch in batches:
            numbers = batch["part"].to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(numbers, prepend=-1)).tolist()
            for a, b in zip(starts, [*starts[1:], len(numbers)]):
                rows, part = batch.slice(a, b - a), int(numbers[a])
                if out is None or out.part != part:
                    if out:
                        yield out.close()
                    out = _Part(files, base, part)
                out.add(rows["doc_id"], rows["ids"], width)
        if out:
            yield out.close()

    # Texts are encoded where they are read, once; ids of two bytes are what moves.
    encoded = rows.mapInArrow(giving_back(encode, encoder), "part int, doc_id bigint, tie bigint, ids binary")
    placed = encoded.repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "doc_id", "tie")
    # One short row per part.
    parts = sorted(placed.select("part", "doc_id", "ids").mapInArrow(giving_back(write, encoder), _WRITTEN).collect())
    base, listed = 0, []
    for p in parts:
        listed.append({"part": p.part, "docs": p.docs, "tokens": p.tokens, "nulls": p.nulls, "base": base})
        base += p.tokens
    manifest = {"type": kind, "end": end, "tokens": base, "parts": listed}
    files, path = _place(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return folder


def open_array(folder: str, name: str, kind: str) -> np.ndarray:
    """One file as an array: memory-mapped where the folder is a mounted one."""
    files, path = _place(folder)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", dtype=kind, mode="r")
    with files.open_input_file(f"{path}/{name}") as source:
        return np.frombuffer(source.read_buffer(), dtype=kind)


def read_manifest(folder: str) -> dict:
    files, path = _place(folder)
    with files.open_input_file(f"{path}/manifest.json") as source:
        return json.loads(source.read())


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: where its ids begin among all, how many, and the crc32 of its
    ids as little-endian unsigned 32-bit integers. One task reads one partition's files."""
    folder = qualified(spark, folder)
    manifest = read_manifest(folder)
    kind = manifest["type"]
    parts = [(p["part"], p["base"], p["nulls"]) for p in manifest["parts"]]
    listed = spark.createDataFrame(parts, "part int, base bigint, nulls bigint").repartition(max(1, len(parts)), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = f"part-{row['part']}"
                tokens = open_array(folder, f"{name}.tokens", kind)
                offsets = open_array(folder, f"{name}.offsets", "<u8")
                docs = open_array(folder, f"{name}.docs", "<i8")
                for a in range(0, len(docs), _AT_ONCE):
                    at = offsets[a : a + _AT_ONCE + 1].astype(np.int64)
                    crc = [zlib.crc32(tokens[i:j].astype("<u4").tobytes()) for i, j in zip(at, at[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs[a : a + _AT_ONCE].astype(np.int64), mask=np.arange(a, a + len(at) - 1) < row["nulls"]),
                            pa.array(at[:-1] + row["base"]),
                            pa.array(np.diff(at)),
                            pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return listed.mapInArrow(giving_back(read, encoder), _READ)
