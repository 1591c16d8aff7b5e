"""Benchmark decontamination with DataFrame functions alone.

Windows of ``n`` consecutive words of the benchmark are hashed; every place of every document
hashes the same number of words from there, and the places whose hash is among the
benchmark's are verified word by word. The set of windows is broadcast once it is known to be
small; beyond that, places and windows are joined by a shuffle of narrow rows.

Null and empty texts have no words: such documents are never hit, such items have no windows.
An item with fewer than ``n`` words is one window of its own length. Rows with equal ids are
documents of their own; fully equal rows have equal results. Items are told apart by id; a null
item id hits words but is not counted as an item. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.words import plain_words
from marginalia.session import cut_lineage

# Words, and what stands between them, before lower-casing.
_WORD_RUN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OTHER_RUN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Windows that may be broadcast, once counted.
BROADCAST_WINDOWS = 500_000


def _window_hash(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*(F.get(words, at + k) for k in range(length)))


def _windows(benchmark: DataFrame, n: int) -> DataFrame:
    """Windows of the items: (item, length, words)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("_item"), plain_words(F.col("text")).alias("_w"))
    items = items.where(F.size("_w") > 0)
    last = F.greatest(F.size("_w") - n, F.lit(0))
    return items.select("_item", F.explode(F.sequence(F.lit(0), last)).alias("_at"), "_w").select(
        "_item", F.slice("_w", F.col("_at") + 1, n).alias("_words")
    )


def _covered(spans: Column) -> Column:
    """Words covered by spans (from, length), which may overlap."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        end = s["_pos"] + s["_length"]
        new = F.greatest(F.lit(0), end - F.greatest(acc["end"], s["_pos"]))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document text that is hit: ``doc_id``, ``_hash`` of the text, ``spans`` (first word, length), ``items``."""
    windows = cut_lineage(_windows(benchmark, n))
    distinct = windows.select("_words").distinct()
    distinct = cut_lineage(distinct.select("_words", F.size("_words").alias("_length"), F.monotonically_increasing_id().alias("_window")))
    # At most n lengths.
    lengths = sorted(r._length for r in distinct.select("_length").distinct().collect()) or [n]
    keyed = distinct.withColumn("_key", F.xxhash64(*(F.get("_words", F.lit(k)) for k in range(n))))
    texts = docs.select("doc_id", F.xxhash64("text").alias("_hash"), plain_words(F.col("text")).alias("_w"))
    places = texts.select("doc_id", "_hash", "_w", F.posexplode("_w").alias("_pos", "_word"))
    if lengths == [n]:
        places = places.withColumn("_key", _window_hash(F.col("_w"), F.col("_pos"), n))
    else:
        keys = F.array(*(_window_hash(F.col("_w"), F.col("_pos"), k) for k in lengths))
        places = places.withColumn("_key", F.explode(F.array_distinct(keys)))
    same = F.slice("_w", F.col("_pos") + 1, F.col("_length")) == F.col("_words")
    if distinct.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        hits = places.join(F.broadcast(keyed), "_key").where(same)
    else:
        found = places.select("doc_id", "_hash", "_pos", "_key").join(keyed, "_key")
        again = texts.withColumnRenamed("doc_id", "_doc").withColumnRenamed("_hash", "_same")
        hits = found.join(again, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_same"))).where(same)
    hits = cut_lineage(hits.select("doc_id", "_hash", "_pos", "_length", "_window").distinct())
    spans = hits.groupBy("doc_id", "_hash").agg(F.collect_set(F.struct("_pos", "_length")).alias("spans"))
    of = windows.where("_item is not null").join(distinct, "_words").select("_window", "_item").distinct()
    named = hits.select("doc_id", "_hash", "_window").distinct().join(of, "_window")
    items = named.groupBy("doc_id", "_hash").agg(F.array_sort(F.collect_set("_item")).alias("items"))
    items = items.select(F.col("doc_id").alias("_doc"), F.col("_hash").alias("_same"), "items")
    both = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_same"))
    none = F.array().cast("array<string>")
    return spans.join(items, both, "left").select("doc_id", "_hash", "spans", F.coalesce("items", none).alias("items"))


def _hits_for(docs: DataFrame, benchmark: DataFrame, n: int) -> tuple[DataFrame, Column]:
    """The hits under names of their own, and the condition that joins them to whole documents."""
    hits = find_hits(docs, benchmark, n)
    hits = hits.select(F.col("doc_id").alias("_hit_doc"), F.col("_hash").alias("_hit_hash"), F.col("spans").alias("_hit_spans"))
    return hits, docs["doc_id"].eqNullSafe(hits["_hit_doc"]) & (F.xxhash64(docs["text"]) == hits["_hit_hash"])


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document: words, words inside occurrences of benchmark windows, items, and their digest."""
    hits = find_hits(docs, benchmark, n).withColumnRenamed("doc_id", "_doc").withColumnRenamed("_hash", "_same")
    counted = docs.select("doc_id", F.xxhash64("text").alias("_hash"), F.size(plain_words(F.col("text"))).cast("bigint").alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_same"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("bigint")
    return counted.join(hits, same, "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents without any hit word, with all their columns."""
    hits, same = _hits_for(docs, benchmark, n)
    return docs.join(hits, same, "left_anti")


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """All documents with all their columns, the hit words taken out of ``text`` and the rest of it left as it is."""
    hits, same = _hits_for(docs, benchmark, n)
    text = docs["text"]
    pieces = F.regexp_extract_all(text, F.lit(f"{_WORD_RUN}|{_OTHER_RUN}"), F.lit(0))
    skipped = F.when(text.rlike(f"^{_WORD_RUN}"), 0).otherwise(1)
    words = F.flatten(F.transform("_hit_spans", lambda s: F.sequence(s["_pos"], s["_pos"] + s["_length"] - 1)))
    kept = F.filter(
        pieces, lambda _, i: ((i - skipped) % 2 != 0) | ~F.array_contains(words, F.floor((i - skipped) / 2).cast("int"))
    )
    cut = F.when(F.col("_hit_spans").isNull(), text).otherwise(F.array_join(kept, ""))
    return docs.join(hits, same, "left").select(*(cut.alias("text") if c == "text" else docs[c] for c in docs.columns))
