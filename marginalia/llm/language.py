"""Language identification by a small convolutional network over bytes.

A text's UTF-8 bytes are cut into windows of a fixed length. Bytes are embedded, filters of
several widths slide over them, the largest response of each filter is kept, and a softmax
layer gives a probability per language; a text's probabilities are those of its windows'
mean logits, weighted by their bytes. The network is trained in numpy, on the driver, on at
most ``sample`` windows of labelled rows, of each language the rows with the smallest hashes of
their ids, as many as its quota; every text is then read whole.

A null text, or one without letters, is ``und`` with score 0. Rows without a language teach
nothing; with no labelled row at all every text is ``und``. Repeated rows and ids keep all their
rows, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.workers import giving_back

UNKNOWN = "und"
# Labelled rows that are learned from, at most; one window of each.
SAMPLE = 8000
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 24
EMBEDDED = 8
EPOCHS = 6
BATCH = 64
# Windows in one step of the prediction.
_AT_ONCE = 512
# Places that the hashes of ids take.
_PLACES = 1 << 40


@dataclass
class ByteNet:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.out, self.out_bias]

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The largest response of every filter, and where it is."""
        embedded = self.embedding[windows]
        n, length, size = embedded.shape
        best, places = [], []
        for weights, bias in zip(self.filters, self.biases):
            width = len(weights) // size
            steps = length - width + 1
            flat = np.lib.stride_tricks.as_strided(
                embedded, (n, steps, width * size), (embedded.strides[0], embedded.strides[1], embedded.strides[2])
            )
            response = (flat.reshape(n * steps, width * size) @ weights).reshape(n, steps, -1)
            at = response.argmax(axis=1)
            places.append(at)
            best.append(np.take_along_axis(response, at[:, None], 1)[:, 0] + bias)
        return np.maximum(np.concatenate(best, axis=1), 0), places

    def logits(self, windows: np.ndarray) -> np.ndarray:
        return np.concatenate(
            [self.responses(windows[i : i + _AT_ONCE])[0] @ self.out + self.out_bias for i in range(0, len(windows), _AT_ONCE)]
        )

    def gradients(self, windows: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
        pooled, places = self.responses(windows)
        chances = softmax(pooled @ self.out + self.out_bias)
        chances[np.arange(len(wanted)), wanted] -= 1
        chances /= len(wanted)
        inner = (chances @ self.out.T) * (pooled > 0)
        embedding = np.zeros_like(self.embedding)
        filters, biases, first = [], [], 0
        for weights, at in zip(self.filters, places):
            count, size = weights.shape[1], self.embedding.shape[1]
            width = len(weights) // size
            own = inner[:, first : first + count]
            first += count
            seen = windows[np.arange(len(windows))[:, None, None], at[:, :, None] + np.arange(width)]
            filters.append(np.einsum("nf,nfe->ef", own, self.embedding[seen].reshape(*at.shape, -1)))
            biases.append(own.sum(axis=0))
            back = (own[:, :, None] * weights.T).reshape(*at.shape, width, size)
            np.add.at(embedding, seen.ravel(), back.reshape(-1, size))
        return [embedding, *filters, *biases, pooled.T @ chances, chances.sum(axis=0)]


def softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: list[str], seed: int = 0, epochs: int = EPOCHS) -> ByteNet:
    """Adam over shuffled batches; the same windows give the same network."""
    languages = sorted(set(labels))
    wanted = np.searchsorted(languages, labels)
    draw = np.random.default_rng(seed)
    normal = lambda *shape, scale: (draw.standard_normal(shape) * scale).astype(np.float32)
    net = ByteNet(
        languages,
        normal(256, EMBEDDED, scale=0.5),
        [normal(w * EMBEDDED, FILTERS, scale=(w * EMBEDDED) ** -0.5) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        normal(FILTERS * len(WIDTHS), len(languages), scale=0.1),
        np.zeros(len(languages), np.float32),
    )
    values = net.parameters()
    mean, spread = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step, total = 0, epochs * -(-len(windows) // BATCH)
    for _ in range(epochs):
        order = draw.permutation(len(windows))
        for i in range(0, len(order), BATCH):
            chosen = order[i : i + BATCH]
            step += 1
            rate = 0.01 * (1 - 0.9 * step / total)
            for value, gradient, m, v in zip(values, net.gradients(windows[chosen], wanted[chosen]), mean, spread):
                m += 0.1 * (gradient - m)
                v += 0.01 * (gradient * gradient - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def byte_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, the last filled up with zeros: bytes, text number, own bytes."""
    coded = [t.encode() for t in texts]
    counts = np.array([-(-len(c) // WINDOW) for c in coded], np.int64)
    joined = b"".join(c + bytes(int(n) * WINDOW - len(c)) for c, n in zip(coded, counts))
    of = np.repeat(np.arange(len(texts)), counts)
    sizes = np.full(len(of), WINDOW)
    full = counts > 0
    sizes[np.cumsum(counts)[full] - 1] = [(len(c) - 1) % WINDOW + 1 for c in coded if c]
    return np.frombuffer(joined, np.uint8).reshape(-1, WINDOW), of, sizes


def quotas(sizes: dict[str, int], sample: int) -> dict[str, int]:
    """Rows to take of each language: at most ``sample`` in all, rare languages whole, and one of each at least."""
    found, left = {}, sample
    for k, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        found[lang] = max(1, min(n, left // (len(sizes) - k)))
        left -= found[lang]
    return found


def learn(docs: DataFrame, sample: int = SAMPLE, seed: int = 0) -> ByteNet | None:
    """Train on at most ``sample`` rows of ``doc_id``, ``text``, ``lang``; None without any.

    Of each row one stretch is taken, at a place that a hash of its id gives.
    """
    known = docs.where("lang is not null and length(text) > 0")
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1)
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    # Only rows below a cut of their language come to be ordered at all, about a third more than are taken.
    places = F.pmod(F.xxhash64("doc_id"), F.lit(_PLACES))
    taken = [(lang, n, int(min(1, (1.3 * n + 100) / sizes[lang]) * _PLACES)) for lang, n in quotas(sizes, sample).items()]
    taken = F.broadcast(docs.sparkSession.createDataFrame(taken, "lang string, _taken long, _cut long"))
    rows = known.select(F.substring("text", start.cast("int"), F.lit(WINDOW)).alias("text"), F.col("lang").cast("string").alias("lang"), places.alias("_h"))
    rows = rows.join(taken, "lang").where("_h < _cut")
    rows = rows.withColumn("_rank", F.row_number().over(W.partitionBy("lang").orderBy("_h", "text"))).where("_rank <= _taken")
    rows = rows.select("text", "lang", "_h").orderBy("_h", "lang", "text").collect()
    rows = [r for r in rows if has_letters(r.text)]
    if not rows:
        return None
    windows = np.zeros((len(rows), WINDOW), np.uint8)
    for i, r in enumerate(rows):
        coded = r.text.encode()[:WINDOW]
        windows[i, : len(coded)] = np.frombuffer(coded, np.uint8)
    return train(windows, [r.lang for r in rows], seed)


def has_letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """All columns of ``docs``, with ``lang_pred`` and ``score`` in place of any so named."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)

    def told(texts: pa.Array) -> pa.Array:
        net, found, scores = shared.value, [], []
        for a in range(0, len(texts), 256):
            part = texts.slice(a, 256).to_pylist()
            read = [i for i, t in enumerate(part) if net is not None and has_letters(t)]
            langs, best = [UNKNOWN] * len(part), [0.0] * len(part)
            if read:
                windows, of, sizes = byte_windows([part[i] for i in read])
                sums = np.zeros((len(read), len(net.languages)))
                np.add.at(sums, of, net.logits(windows) * sizes[:, None])
                chances = softmax(sums / np.bincount(of, sizes, len(read))[:, None])
                for i, row in zip(read, chances):
                    langs[i], best[i] = net.languages[int(row.argmax())], float(row.max())
            found += langs
            scores += best
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(told, batches)

    predict = F.arrow_udf(giving_back(read), "struct<lang_pred string, score double>")
    kept = [docs[c] for c in docs.columns if c not in ("lang_pred", "score")]
    guessed = docs.select(*kept, predict(docs["text"]).alias("_language"))
    return guessed.select(*(F.col(c.name) for c in guessed.schema if c.name != "_language"), "_language.lang_pred", "_language.score")


def fold(doc_id: Column | str, folds: int) -> Column:
    """Remainder of the crc32 of the id as text; null ids are in fold 0."""
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds
