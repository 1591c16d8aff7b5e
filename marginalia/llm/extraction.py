"""Main text of web pages.

A page is read once into blocks; what sits in menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments is left out by its element, role, class or id. The
blocks of the page's ``article`` (else its ``main`` element, else all) are its stream of tokens,
and the suffixes of all streams of a host are brought together by their first ``min_tokens``
tokens, as neighbours in a suffix array are. No host meets in one task.

What such neighbours repeat is boilerplate, and goes; the unique runs stay. On a page without an
article, runs that another stream of the host has go, and repeated whole blocks that are shorter.
Copied articles and common sentences repeat too, so an article loses only runs that at least
``SHARE`` of the host's articles have, ``MIN_ARTICLES`` of them or more; and where these make up
more than half of its tokens, it is a copy and stays whole.

Null pages are empty and give an empty text, as do pages without text. A page without a URL
belongs to the empty host. Repeated rows and ids keep all their rows; equal streams count as
one, so copies don't remove each other. Pages of any length are read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import url_host
from marginalia.session import broadcast_if_small, cut_lineage

MIN_TOKENS = 8
# A run is boilerplate of a host's articles from this share and this number of them on.
SHARE = 0.8
MIN_ARTICLES = 8
# Suffixes that a task holds at a time.
HELD = 1_000_000

# Elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td"
    " tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "aside button canvas datalist dialog fieldset footer form frameset head header iframe input label math menu nav"
    " noframes noscript object select svg template textarea".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie"
    " cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager"
    " pagination popup promo promotion related replies reply respond share sharing sidebar social sponsor sponsored"
    " subscribe toolbar widget".split()
)
READERS_NAMES = frozenset("comment comments replies reply respond".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|title|textarea|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|([^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"([^\s=>/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z]+")


def _dropped(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for name, a, b, c in _NAMED.findall(attributes):
        value = (a or b or c).lower()
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name == "role" and value in DROPPED_ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body"):
            if _marked(value, READERS_NAMES if tag in ("article", "main") else DROPPED_NAMES):
                return True
    return False


def _marked(value: str, marks: frozenset[str]) -> bool:
    """Whether one of the names, or its first or last part, marks something that is not text."""
    for name in value.split():
        parts = _NAME.findall(name)
        if parts and (parts[0] in marks or parts[-1] in marks):
            return True
    return False


def page_blocks(page: str) -> tuple[list[str], bool]:
    """Blocks of text in page order, and whether an article or main element settles them."""
    open_tags: list[tuple[str, bool, str]] = []  # tag, dropped from here, container
    found: dict[str, list[str]] = {"article": [], "main": [], "": []}
    text: list[str] = []

    def flush() -> None:
        if text:
            block = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if block:
                found[open_tags[-1][2] if open_tags else ""].append(block)

    for _raw, closing, tag, attributes, data in _TOKEN.findall(page):
        if data:
            if not (open_tags and open_tags[-1][1]):
                text.append(data)
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCKS or tag in DROPPED:
            flush()
        if closing:
            for depth in range(len(open_tags) - 1, -1, -1):
                if open_tags[depth][0] == tag:
                    flush()
                    del open_tags[depth:]
                    break
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag == "p" or tag == "li":  # closes an open one of its kind
            for depth in range(len(open_tags) - 1, -1, -1):
                if open_tags[depth][0] == tag:
                    del open_tags[depth:]
                    break
                if open_tags[depth][0] in BLOCKS and open_tags[depth][0] != "p":
                    break
        _, dropped, container = open_tags[-1] if open_tags else ("", False, "")
        if tag == "article" and container != "article":
            container = "article"
        elif tag == "main" and not container:
            container = "main"
        dropped = dropped or _dropped(tag, attributes)
        open_tags.append((tag, dropped, container))
    flush()
    for container in ("article", "main"):
        if found[container]:
            return found[container], True
    return found[""], False


def _stream(blocks: list[str]) -> list[str]:
    """Tokens of the blocks, with an empty one at the start of each."""
    return [token for block in blocks for token in ("", *block.split(" "))]


def _suffixes(blocks: list[str], k: int) -> Iterator[tuple[int, list[str]]]:
    """Place and first k tokens of the suffixes of each block; a shorter block is one, marked at both ends."""
    at = 0
    for block in blocks:
        tokens = block.split(" ")
        if len(tokens) < k:
            yield at, ["", *tokens, ""]
        for i in range(len(tokens) - k + 1):
            yield at + 1 + i, tokens[i : i + k]
        at += len(tokens) + 1


def _windows(host: str, blocks: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Place in the stream and key of every suffix that has k tokens in its block."""
    hashes, ends, at = [0], [], 0
    for block in blocks:
        tokens = block.split(" ")
        hashes += map(xxhash.xxh64_intdigest, tokens)
        hashes.append(0)
        at += len(tokens) + 1
        ends.append(at)
    n = len(hashes) - 1
    if n < k:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    values = np.array(hashes[:n], np.uint64)
    keys = np.full(n - k + 1, xxhash.xxh64_intdigest(host), np.uint64)
    for i in range(k):
        keys *= np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
        keys += values[i : n - k + 1 + i]
    # A suffix begins at a token, and no block begins in its first k.
    starts = np.zeros(n + 1, np.int64)
    starts[[0, *ends]] = 1
    before = np.concatenate(([0], np.cumsum(starts[:n])))
    places = np.flatnonzero(before[k : n + 1] == before[: n - k + 1])
    return places, keys[places].view(np.int64)


def extract_pages(pages: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` for every row of ``page_id``, ``url``, ``html``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_blocks(page or "") for page in batch["html"].to_pylist()]
            streams = [blocks for blocks, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c] for c in ("page_id", "url", "_host", "_row")),
                    pa.array([xxhash.xxh64_intdigest("\n".join(blocks)) >> 1 for blocks in streams], pa.int64()),
                    pa.array([settled for _, settled in found], pa.bool_()),
                    pa.array(streams, pa.list_(pa.string())),
                ],
                ["page_id", "url", "_host", "_row", "_of", "_settled", "_blocks"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    source = pages.select("page_id", F.col("url").cast("string"), F.coalesce(url_host(F.col("url").cast("string")), F.lit("")).alias("_host"), F.monotonically_increasing_id().alias("_row"), F.col("html").cast("string"))
    streams = cut_lineage(source.mapInArrow(read, f"page_id {kind}, url string, _host string, _row bigint, _of bigint, _settled boolean, _blocks array<string>"))
    settled = _without(streams.where("_settled"), _common_runs(streams.where("_settled"), min_tokens), copies_stay=True)
    unsettled = _without(streams.where("not _settled"), _repeated_runs(streams.where("not _settled"), min_tokens))
    return settled.union(unsettled).withColumn("n_chars", F.length("text").cast("bigint"))


def _common_runs(articles: DataFrame, k: int) -> DataFrame | None:
    """``_row`` and ``_starts``, the runs of k tokens in it that most articles of its host have; None if there are none.

    A run that a share of all articles have is had by that share of some group, however they are grouped, so the
    articles that a task holds at a time name what may be such a run; then these are counted over all.
    """
    firsts = cut_lineage(articles.groupBy("_host", "_of").agg(F.min("_row").alias("_row")))
    sizes = firsts.groupBy("_host").agg(F.count("_of").alias("_n")).where(F.col("_n") >= MIN_ARTICLES)
    firsts = cut_lineage(firsts.join(broadcast_if_small(sizes), "_host").select("_row", "_n"))
    distinct = articles.select("_row", "_host", "_blocks").join(broadcast_if_small(firsts), "_row")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        of: dict[str, int] = {}

        def most() -> Iterator[pa.RecordBatch]:
            for host, lists in held.items():
                keys, n = np.unique(np.concatenate(lists), return_counts=True)
                keys = keys[n >= SHARE * len(lists)]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), of[host]))], ["_key", "_n"])
            held.clear()

        size = 0
        for batch in batches:
            for host, n, blocks in zip(*(batch[c].to_pylist() for c in ("_host", "_n", "_blocks"))):
                keys = np.unique(_windows(host, blocks, k)[1])
                held.setdefault(host, []).append(keys)
                of[host] = n
                size += len(keys)
                if size >= HELD:
                    yield from most()
                    size = 0
        yield from most()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, blocks in zip(*(batch[c].to_pylist() for c in ("_host", "_blocks"))):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_windows(host, blocks, k)[1]))], ["_key"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, host, blocks in zip(*(batch[c].to_pylist() for c in ("_row", "_host", "_blocks"))):
                at, key = _windows(host, blocks, k)
                columns = [pa.array(np.full(len(at), row, np.int64)), pa.array(at.astype(np.int32)), pa.array(key)]
                yield pa.RecordBatch.from_arrays(columns, ["_row", "_at", "_key"])

    maybe = cut_lineage(distinct.mapInArrow(named, "_key bigint, _n bigint").distinct())
    counted = distinct.mapInArrow(keys, "_key bigint").join(broadcast_if_small(maybe), "_key").groupBy("_key", "_n").count()
    common = cut_lineage(counted.where((F.col("count") >= SHARE * F.col("_n")) & (F.col("count") >= MIN_ARTICLES)).select("_key"))
    if common.isEmpty():
        return None
    found = articles.mapInArrow(places, "_row bigint, _at int, _key bigint").join(broadcast_if_small(common), "_key")
    return cut_lineage(found.groupBy("_row").agg(F.collect_set(F.struct("_at", F.lit(k).alias("_n"))).alias("_starts")))


def _repeated_runs(streams: DataFrame, k: int) -> DataFrame:
    """``_row`` and ``_starts``, the runs of k tokens and shorter whole blocks in it that another stream of the host has."""

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, of, host, blocks in zip(*(batch[c].to_pylist() for c in ("_row", "_of", "_host", "_blocks"))):
                found = list(_suffixes(blocks, k))
                n = len(found)
                columns = [
                    pa.array([row] * n, pa.int64()),
                    pa.array([of] * n, pa.int64()),
                    pa.array([i for i, _ in found], pa.int32()),
                    pa.array([k if t[0] else len(t) - 1 for _, t in found], pa.int32()),
                    pa.array([xxhash.xxh64_intdigest("\0".join((host, *t))) >> 1 for _, t in found], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["_row", "_of", "_at", "_n", "_key"])

    places = streams.mapInArrow(suffixes, "_row bigint, _of bigint, _at int, _n int, _key bigint")
    keys = places.groupBy("_key").agg(F.min("_of").alias("_a"), F.max("_of").alias("_b")).where("_a <> _b").select("_key")
    return places.join(keys, "_key").groupBy("_row").agg(F.collect_set(F.struct("_at", "_n")).alias("_starts"))


def _without(streams: DataFrame, runs: DataFrame | None, copies_stay: bool = False) -> DataFrame:
    """``page_id``, ``url`` and the text of each stream without its runs; with ``copies_stay`` whole where they are most of it."""
    if runs is None:
        return streams.select("page_id", "url", F.array_join("_blocks", "\n").alias("text"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for blocks, starts in zip(batch["_blocks"].to_pylist(), batch["_starts"].to_pylist()):
                tokens = _stream(blocks)
                steps = np.zeros(len(tokens) + 1, np.int64)
                for s in starts or ():
                    steps[s["_at"]] += 1
                    steps[s["_at"] + s["_n"]] -= 1
                covered = np.cumsum(steps[:-1]) > 0
                if copies_stay and 2 * int(covered.sum()) > len(tokens) - len(blocks):
                    covered[:] = False
                lines: list[list[str]] = []
                for token, gone in zip(tokens, covered):
                    if not token:
                        lines.append([])
                    elif not gone:
                        lines[-1].append(token)
                texts.append("\n".join(" ".join(line) for line in lines if line))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = streams.schema["page_id"].dataType.simpleString()
    marked = broadcast_if_small(runs) if copies_stay else runs
    joined = streams.join(marked, "_row", "left")
    return joined.mapInArrow(rebuild, f"page_id {kind}, url string, text string")
