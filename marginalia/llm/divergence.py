"""How far the sources of a language differ in their use of words.

Words are counted inside tasks: one ``bytes.translate`` lowers A-Z and blanks every separator,
``bytes.split`` gives the terms and a ``Counter`` per document their numbers. What leaves a task
is one row per (lang, source, term) it met, with occurrences and documents; Spark adds them up.
A language keeps the terms that enough of its documents have.

Every group of a language gives each kept term the smoothed, scaled share
``p = 1 + floor(10^9 (count + 2) / (N + 2 V))``, and two distributions differ at a term by
``f = floor((p - q)^2 / (p + q))``. Terms that a group lacks all have one share, so sums over the
vocabulary are made from terms that are there: the value of a pair is that of two groups without
any term, corrected once per distinct count of either group and once per term both have. All
numbers are exact integers.

Null text, lang and source are read as ''. Every (lang, source) that occurs is a group, also
without terms. Repeated rows are documents of their own; very long texts are counted in slices;
an empty table gives an empty result; columns but these three are not read. Equal values are
ranked by their item. The result has a row per ordered pair of sources of a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.session import broadcast_if_small, cut_lineage

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000

# Terms of all groups that a task holds before it sends them on.
HELD_TERMS = 300_000
# Bytes of a text that are split at a time.
SLICE = 1 << 22

_COUNTED = "lang string, source string, term string, n bigint, docs bigint"
_LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
# One byte for each: letters in lower case, bytes beyond ASCII as they are, all others a blank.
_TABLE = bytes(ord(chr(b).lower()) if b < 0x80 else b for b in range(256))
_TABLE = bytes(_TABLE[b] if b in _LETTERS else 0x20 for b in range(256))


def split_terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, a slice at a time; slices end at a blank."""
    blanked = text.translate(_TABLE)
    start = 0
    while start < len(blanked):
        end = start + SLICE
        if end < len(blanked):
            end = blanked.find(b" ", end)
            end = len(blanked) if end < 0 else end
        yield blanked[start:end].split()
        start = end


def document_terms(text: bytes) -> Counter:
    terms: Counter = Counter()
    for part in split_terms(text):
        terms.update(part)
    return terms


def _sent(groups: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (occurrences, documents) in groups.items():
        # The row of the empty term says that the group is there.
        terms = [b"", *occurrences]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(terms), pa.string()),
                pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array([0, *occurrences.values()], pa.int64()),
                pa.array([0, *map(documents.__getitem__, occurrences)], pa.int64()),
            ],
            ["lang", "source", "term", "n", "docs"],
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0
    for batch in batches:
        langs, sources = batch["lang"].to_pylist(), batch["source"].to_pylist()
        for key, text in zip(zip(langs, sources), batch["text"]):
            occurrences, documents = groups.setdefault(key, (Counter(), Counter()))
            before = len(occurrences)
            own = document_terms(text.as_py())
            documents.update(own.keys())
            for term, n in own.items():
                occurrences[term] += n
            held += len(occurrences) - before
            if held > HELD_TERMS:
                yield from _sent(groups)
                groups, held = {}, 0
    yield from _sent(groups)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, its occurrences ``n`` and its documents ``docs``; a row with term '' per group."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")}
    rows = docs.select(text["lang"], text["source"], text["text"]).select("lang", "source", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_count, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column) -> Column:
    """The scaled share of a term with ``n`` occurrences; ``total`` is N + 2 V."""
    exact = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), total.cast("decimal(20,0)"))
    small = F.call_function("div", F.lit(SCALE) * (n + 2), total)
    return 1 + F.when(n < 9_000_000_000, small).otherwise(exact)


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), F.greatest(p + q, F.lit(1)))


def source_divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    Part ``pair`` holds every other source of the language with the summed difference, part
    ``term`` the ``top_terms`` terms by which the group's share exceeds the language's the most.
    """
    counted = cut_lineage(term_counts(docs))
    of_term = W.partitionBy("lang", "term")
    rows = counted.where("term <> ''").withColumns(
        {
            "_docs": F.sum("docs").over(of_term),
            "_all": F.sum("n").over(of_term),
            "_first": (F.row_number().over(of_term.orderBy("source")) == 1).cast("bigint"),
        }
    )
    rows = cut_lineage(rows.where(F.col("_docs") >= least_documents).select("lang", "source", "term", "n", "_all", "_first"))
    langs = rows.groupBy("lang").agg(F.sum("_first").alias("_v"), F.sum("n").alias("_n"))
    sizes = rows.groupBy("lang", "source").agg(F.sum("n").alias("_own"))
    known = counted.where("term = ''").select("lang", "source").join(broadcast_if_small(cut_lineage(langs)), "lang", "left")
    known = known.join(sizes, ["lang", "source"], "left").na.fill(0, ["_v", "_n", "_own"])
    known = known.withColumns({"_total": F.col("_own") + 2 * F.col("_v"), "_lang_total": F.col("_n") + 2 * F.col("_v")})
    absent = F.when(F.col("_v") > 0, _share(F.lit(0).cast("bigint"), F.col("_total"))).otherwise(F.lit(0).cast("bigint"))
    # One row per source of a language.
    groups = cut_lineage(known.select("lang", "source", "_v", "_total", "_lang_total", absent.alias("_absent")))
    sources = broadcast_if_small(groups)

    used = rows.join(sources, ["lang", "source"])
    over = used.select(
        "lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("_total")).alias("_p"), _share(F.col("_all"), F.col("_lang_total")).alias("_q")
    ).where("_p > _q")
    terms = over.select("lang", "source", F.lit("term").alias("part"), "item", _apart(F.col("_p"), F.col("_q")).alias("value"))
    terms = _ranked(terms).where(F.col("rank") <= top_terms)
    pairs = _pair_values(rows, sources, used)
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", both.alias("_"), "value").select("lang", "_.source", F.lit("pair").alias("part"), "_.item", "value")
    return _ranked(pairs).unionByName(terms)


def _ranked(values: DataFrame) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return values.withColumn("rank", F.row_number().over(order))


def _pair_values(rows: DataFrame, sources: DataFrame, used: DataFrame) -> DataFrame:
    """``lang``, ``a``, ``b``, ``value`` of every two sources of a language, a before b."""
    other = sources.select("lang", F.col("source").alias("other"), F.col("_absent").alias("_other_absent"))
    absent = _apart(F.col("_absent"), F.col("_other_absent"))
    some = F.col("_v") > 0
    bare = sources.join(other, "lang").where("source < other")
    bare = bare.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), F.when(some, F.col("_v") * absent).otherwise(0).alias("value"))
    # The terms of one source against those the other lacks, by how often they occur.
    spread = used.groupBy("lang", "source", "_absent", _share(F.col("n"), F.col("_total")).alias("_p")).agg(F.count(F.lit(1)).alias("_m"))
    alone = spread.join(other, "lang").where("source <> other")
    alone = alone.select(
        "lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"),
        (F.col("_m") * (_apart(F.col("_p"), F.col("_other_absent")) - absent)).alias("value"),
    )
    shares = used.select("lang", "term", "source", _share(F.col("n"), F.col("_total")).alias("_p"), "_absent")
    theirs = shares.select("lang", "term", F.col("source").alias("other"), F.col("_p").alias("_other_p"), F.col("_absent").alias("_other_absent"))
    shared = shares.join(theirs, ["lang", "term"]).where("source < other")
    change = _apart(F.col("_p"), F.col("_other_p")) - _apart(F.col("_p"), F.col("_other_absent")) - _apart(F.col("_absent"), F.col("_other_p")) + absent
    shared = shared.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), change.alias("value"))
    return bare.union(alone).union(shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
