"""Quality scores by random Fourier features, ridge regression and isotonic calibration.

Each text gives a few statistics (shares of kinds of characters, word and line repetition,
lengths). Random cosine features of the standardised statistics approximate a Gaussian
kernel. Every partition sums its part of the normal equations, Spark adds the parts cell by
cell, and the driver solves a system whose size is the number of features. Raw scores are cut into
a fixed number of steps, counted by label, and made monotone by pooling adjacent violators.

Null and empty texts have statistics of zero and are scored like any other. Rows without a label
teach nothing; without any label all scores are 0. Repeated rows and ids keep all their rows; a
document with several labels teaches all of them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.language import fold
from marginalia.session import cut_lineage

FEATURES = 160
RIDGE = 1e-3
WIDTH = 4.0
STEPS = 400
STATISTICS = 18

_WORD = re.compile(r"[^\W\d_]+")
# Bytes by kind: upper case, lower case, digit, space, line end, sentence marks, other marks, beyond ASCII.
_KIND = np.full(256, 6, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[[32, 9]], _KIND[[10, 13]] = 0, 1, 2, 3, 4
_KIND[[ord(c) for c in ".,;:!?'\"-()"]], _KIND[128:] = 5, 7


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text; zeros for an empty one."""
    if not text:
        return [0.0] * STATISTICS
    coded = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(_KIND[coded], minlength=8) / len(coded)
    chances = np.bincount(coded, minlength=256) / len(coded)
    chances = chances[chances > 0]
    words = text.split()
    n = max(1, len(words))
    different = set(words)
    pairs = max(1, len(words) - 1)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = _WORD.findall(text)
    return [
        *kinds.tolist(),
        float(-(chances * np.log2(chances)).sum()),
        np.log1p(len(coded)),
        len(different) / n,
        np.log1p(n) * len(different) / n,
        sum(a == b for a, b in zip(words, words[1:])) / pairs,
        sum(map(len, words)) / n,
        len(set(lines)) / max(1, len(lines)),
        sum(map(str.isalpha, words)) / n,
        len(zlib.compress(coded.tobytes(), 1)) / len(coded),
        sum(map(len, letters)) / max(1, len(letters)),
    ]


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray | None = None
    edges: np.ndarray | None = None
    levels: np.ndarray | None = None

    def features(self, values: np.ndarray) -> np.ndarray:
        scaled = np.clip((values - self.mean) / self.spread, -6, 6)
        waves = np.cos(scaled @ self.directions + self.shifts) * np.sqrt(2 / len(self.shifts))
        return np.concatenate([waves, np.ones((len(values), 1))], axis=1)

    def raw(self, values: np.ndarray) -> np.ndarray:
        return self.features(values) @ self.weights

    def score(self, values: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(values))
        return np.clip(np.interp(self.raw(values), self.edges, self.levels), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``stats`` of every row, written once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut_lineage(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(read, f"doc_id {kind}, stats array<double>"))


def isotonic(mean: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The closest rising sequence, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for m, w in zip(mean, weight):
        pools.append([m, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            total = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.concatenate([np.full(int(p[2]), p[0]) for p in pools])


def fit(taught: DataFrame, seed: int = 0) -> Model:
    """Fit on rows of ``stats`` and ``quality`` (0 or 1), read twice."""
    spark = taught.sparkSession
    cells = [F.avg(F.get("stats", F.lit(i))).alias(f"m{i}") for i in range(STATISTICS)]
    cells += [F.stddev_pop(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(STATISTICS)]
    about = taught.agg(F.count(F.lit(1)).alias("n"), *cells).first()
    draw = np.random.default_rng(seed)
    model = Model(
        np.array([about[f"m{i}"] or 0.0 for i in range(STATISTICS)]),
        np.maximum(np.array([about[f"s{i}"] or 0.0 for i in range(STATISTICS)]), 1e-6),
        draw.standard_normal((STATISTICS, FEATURES)) / WIDTH,
        draw.random(FEATURES) * 2 * np.pi,
    )
    if not about.n:
        return model
    shared = spark.sparkContext.broadcast(model)
    size = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            x = shared.value.features(_matrix(batch["stats"]))
            y = batch["quality"].to_numpy(zero_copy_only=False).astype(np.float64)
            total += np.concatenate([x.T @ x, (x.T @ y)[:, None]], axis=1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "value"])

    parts = taught.select("stats", "quality").mapInArrow(sums, "cell bigint, value double")
    total = np.zeros(size * (size + 1))
    for r in parts.groupBy("cell").agg(F.sum("value").alias("value")).collect():  # one per pair of features
        total[r.cell] = r.value
    total = total.reshape(size, size + 1)
    penalty = np.eye(size) * RIDGE * about.n
    penalty[-1, -1] = 1e-9 * about.n
    model.weights = np.linalg.solve(total[:, :size] + penalty, total[:, size])
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("int")
    def steps(stats: pa.Array) -> pa.Array:
        raw = shared.value.raw(_matrix(stats))
        return pa.array(np.clip(np.floor((raw + 0.5) / 2 * STEPS), 0, STEPS - 1).astype(np.int32))

    counted = taught.select(steps("stats").alias("step"), "quality").groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("mean"))
    rows = sorted(counted.collect())  # at most one per step
    model.edges = np.array([(r.step + 0.5) * 2 / STEPS - 0.5 for r in rows])
    model.levels = isotonic(np.array([r["mean"] for r in rows]), np.array([r.n for r in rows], float))
    return model


def score_statistics(rows: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` from ``stats``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(stats: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(_matrix(stats)))

    return rows.select("doc_id", score("stats").alias("score"))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Score all documents, learning from the labelled ones outside the held-out fold of ids."""
    stats = with_statistics(docs)
    known = labels.where("quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    taught = cut_lineage(stats.where(fold("doc_id", folds) != held).join(known, "doc_id").select("stats", "quality"))
    scored = score_statistics(stats, fit(taught))
    return scored.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score")
