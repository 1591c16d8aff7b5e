"""Web pages as tables: titles, text, links, structure, allowlists, caches, frontiers."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.text import (
    bind,
    cache_key,
    collapse_blank,
    dates_in,
    date_mentions,
    markdown_headings,
    strip,
    url_host,
)
from marginalia.operators.dom import (
    content_text_of,
    inside,
    nodes_of,
    text_of,
    tight_text_of,
    with_dom,
)
from marginalia.session import broadcast_if_small, cut_lineage

# A domain list up to this size becomes a literal set in the filter; a longer one is joined.
LITERAL_DOMAINS = 20_000

# What stands for a page that may not be read.
ERROR_TITLE = "Access Error"
ERROR_CONTENT = "This domain is not in the allowed domains list."


# ---- domains -------------------------------------------------------------------------------


def host_suffixes(host: Column) -> Column:
    """``a.b.org`` as ``[a.b.org, b.org, org]``."""
    return bind(
        F.split(host, r"\.", -1),
        lambda parts: F.transform(
            parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), ".")
        ),
    )


def _domain_rule(pages: DataFrame, domains: DataFrame | list[str]) -> tuple[str, object]:
    if isinstance(domains, DataFrame):
        column = domains.columns[0]
        names = domains.select(column).distinct()
        head = [row[0] for row in names.limit(LITERAL_DOMAINS + 1).collect()]
        if len(head) > LITERAL_DOMAINS:
            return "table", names.toDF("domain")
        domains = head
    names = sorted({d for d in domains if d is not None})
    if len(names) > LITERAL_DOMAINS:
        return "table", pages.sparkSession.createDataFrame([(d,) for d in names], "domain string")
    return "literal", names


def _allowed_hosts(pages: DataFrame, names: DataFrame, url: str) -> DataFrame:
    """Hosts below a listed domain. Hosts are made distinct first, so no page is shuffled here."""
    hosts = pages.select(url_host(F.col(url)).alias("host")).distinct()
    tails = hosts.select("host", F.explode(host_suffixes(F.col("host"))).alias("domain"))
    return tails.join(names, "domain", "left_semi").select("host").distinct()


def _by_domain(pages: DataFrame, domains, url: str, wanted: bool) -> DataFrame:
    kind, names = _domain_rule(pages, domains)
    host = url_host(F.col(url))
    if kind == "literal":
        if not names:
            return pages if wanted else pages.filter(F.lit(False))
        listed = F.exists(host_suffixes(host), lambda tail: tail.isin(*names))
        keep = F.coalesce(listed, F.lit(False))
        return pages.filter(keep if wanted else ~keep)
    hosts = _allowed_hosts(pages, names, url)
    how = "left_semi" if wanted else "left_anti"
    return pages.withColumn("host", host).join(hosts, "host", how).drop("host")


def allowed_pages(pages: DataFrame, domains: DataFrame | list[str], url: str = "url") -> DataFrame:
    """Pages whose network location is a listed domain or below one; an empty list passes all.

    A list of usual size is a literal set tested row by row: no shuffle, and the
    test runs before any HTML is read. A longer list is joined on the host.
    """
    return _by_domain(pages, domains, url, wanted=True)


def blocked_pages(pages: DataFrame, domains: DataFrame | list[str], url: str = "url") -> DataFrame:
    """The other pages, as error rows."""
    rest = _by_domain(pages, domains, url, wanted=False)
    return rest.drop("html").select(
        "*",
        F.lit(ERROR_TITLE).alias("title"),
        F.lit(ERROR_CONTENT).alias("content"),
        F.lit("").alias("html"),
        F.lit(403).alias("status_code"),
        F.lit("Domain not allowed").alias("error"),
        F.lit(False).alias("fetch_success"),
    )


def domain_list_diff(domains: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    names = domains.select("domain").union(add.select("domain")).distinct()
    return names.join(remove.select("domain"), "domain", "left_anti")


# ---- what a page holds ---------------------------------------------------------------------


def title_column() -> Column:
    title = F.get(nodes_of("title"), 0)
    return F.when(title.isNotNull(), strip(text_of(title))).otherwise(F.lit("No title"))


def content_column() -> Column:
    """Title, all headings, all paragraphs, then all list items, without the noise elements."""

    def clean(*tags):
        return F.filter(nodes_of(*tags), lambda n: ~n["noise"])

    title = F.get(clean("title"), 0)
    head = F.when(title.isNotNull(), F.concat(strip(content_text_of(title)), F.lit("\n\n")))

    def heading(text: Column, i: Column) -> Column:
        gap = F.when(i > 0, F.lit("\n\n")).otherwise(F.lit(""))
        return F.when(text != "", F.concat(gap, text, F.lit("\n"))).otherwise(F.lit(""))

    def lines(texts: Column, before: str, after: str) -> Column:
        full = F.filter(texts, lambda t: t != "")
        return F.array_join(F.transform(full, lambda t: F.concat(F.lit(before), t, F.lit(after))), "")

    def texts(nodes: Column) -> Column:
        return F.transform(nodes, lambda n: strip(content_text_of(n)))

    headings = F.transform(texts(clean("h1", "h2", "h3", "h4", "h5", "h6")), heading)
    items = F.transform(
        clean("ul", "ol"),
        lambda n: F.concat(
            lines(texts(F.filter(inside(n, "li"), lambda i: ~i["noise"])), "• ", "\n"),
            F.lit("\n"),
        ),
    )
    return collapse_blank(
        F.concat(
            F.coalesce(head, F.lit("")),
            F.array_join(headings, ""),
            lines(texts(clean("p")), "", "\n\n"),
            F.array_join(items, ""),
        )
    )


def headings_column() -> Column:
    return F.transform(
        nodes_of("h1", "h2", "h3"),
        lambda n: F.struct(
            F.substring(n["tag"], 2, 1).cast("int").alias("level"), tight_text_of(n).alias("text")
        ),
    )


def lists_column() -> Column:
    found = F.transform(
        nodes_of("ul", "ol"),
        lambda n: F.struct(
            n["tag"].alias("type"), F.transform(inside(n, "li"), tight_text_of).alias("items")
        ),
    )
    return F.filter(found, lambda x: F.size(x["items"]) > 0)


def tables_column() -> Column:
    def headers(table: Column) -> Column:
        thead = F.get(inside(table, "thead"), 0)
        return F.when(
            thead.isNotNull(), F.transform(inside(thead, "th"), tight_text_of)
        ).otherwise(F.array().cast("array<string>"))

    def rows(table: Column) -> Column:
        cells = F.transform(
            inside(table, "tr"), lambda r: F.transform(inside(r, "td", "th"), tight_text_of)
        )
        return F.filter(cells, lambda row: F.size(row) > 0)

    found = F.transform(
        nodes_of("table"),
        lambda n: F.struct(headers(n).alias("headers"), rows(n).alias("data")),
    )
    return F.filter(found, lambda x: F.size(x["data"]) > 0)


def links_column() -> Column:
    """Text and raw target of every link that leads somewhere."""
    anchors = F.transform(
        nodes_of("a"),
        lambda n: F.struct(strip(text_of(n)).alias("text"), n["attrs"]["href"].alias("href")),
    )
    return F.filter(
        anchors,
        lambda a: a["href"].isNotNull() & (a["href"] != "") & ~a["href"].startswith("javascript:"),
    )


def main_text_column(content: Column) -> Column:
    main = F.get(nodes_of("article", "main"), 0)
    return F.when(main.isNotNull(), tight_text_of(main)).otherwise(content)


def parse_pages(pages: DataFrame) -> DataFrame:
    """Everything a page holds, as nested columns, from one reading of its HTML."""
    dom = with_dom(pages)
    read = dom.select(
        *[c for c in pages.columns if c not in ("dom", "html", "title", "content")],
        "dom",
        title_column().alias("title"),
        content_column().alias("content"),
    )
    return read.select(
        *[c for c in read.columns if c != "dom"],
        main_text_column(F.col("content")).alias("main_text"),
        headings_column().alias("headings"),
        lists_column().alias("lists"),
        tables_column().alias("tables"),
        links_column().alias("links"),
        dates_in(F.col("content")).alias("extracted_dates"),
    )


def _pages(pages: DataFrame) -> DataFrame:
    """Only what the page operators need is carried through the HTML step."""
    wanted = [c for c in pages.columns if c in ("page_id", "url", "html", "dom")]
    return with_dom(pages.select(*wanted))


def page_title(pages: DataFrame) -> DataFrame:
    return _pages(pages).select("page_id", title_column().alias("title"))


def page_text(pages: DataFrame) -> DataFrame:
    return _pages(pages).select("page_id", content_column().alias("content"))


def page_headings(pages: DataFrame) -> DataFrame:
    found = _pages(pages).select("page_id", F.posexplode(headings_column()))
    return found.select("page_id", "pos", "col.level", "col.text")


def page_lists(pages: DataFrame) -> DataFrame:
    found = _pages(pages).select("page_id", F.posexplode(lists_column()).alias("list_no", "l"))
    return found.select("page_id", "list_no", "l.type", "l.items")


def page_tables(pages: DataFrame) -> DataFrame:
    """One row per table row; the header row is among them."""
    found = _pages(pages).select("page_id", F.posexplode(tables_column()).alias("table_no", "t"))
    return found.select(
        "page_id", "table_no", "t.headers", F.posexplode("t.data").alias("row_no", "cells")
    )


def page_main_text(pages: DataFrame) -> DataFrame:
    return _pages(pages).select("page_id", main_text_column(content_column()).alias("main_text"))


def page_dates(pages: DataFrame) -> DataFrame:
    return date_mentions(page_text(pages), "content")


@F.arrow_udf(T.StringType())
def _join_url(base: pa.Array, href: pa.Array) -> pa.Array:
    def join(b, h):
        if h is None:
            return None
        try:
            return urljoin(b or "", h)
        except ValueError:
            return h

    return pa.array([join(b, h) for b, h in zip(base.to_pylist(), href.to_pylist())], pa.string())


def absolute_url(base: Column, href: Column) -> Column:
    """Full links stay, root-relative ones get scheme and host; only the rest goes to Python."""
    full = href.startswith("http://") | href.startswith("https://")
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    plain = href.rlike(r"^/[^/]") & ~href.contains("/.") & ~href.rlike(r"[\s;]") & (root != "")
    bare = (href == "/") & (root != "")
    known = full | plain | bare
    joined = _join_url(F.when(~known, base), F.when(~known, href))
    return F.when(full, href).when(known, F.concat(root, href)).otherwise(joined)


def page_links(pages: DataFrame) -> DataFrame:
    found = _pages(pages).select("page_id", F.col("url").alias("base"), F.posexplode(links_column()))
    return found.select(
        "page_id", "pos", "col.text", absolute_url(F.col("base"), F.col("col.href")).alias("url")
    )


# ---- selectors -----------------------------------------------------------------------------

_SIMPLE = re.compile(r"\*|[A-Za-z][\w-]*|\.[\w-]+|#[\w-]+|\[[\w-]+(?:\*?=(?:\"[^\"]*\"|'[^']*'|[\w-]+))?\]")


def _matcher(compound: str):
    """Test of one compound selector (``div.note#top[rel*=x]``) on an element."""
    parts = _SIMPLE.findall(compound)
    if not parts or "".join(parts) != compound:
        raise ValueError(f"selector not supported: {compound!r}")

    def part_holds(part: str, node: Column) -> Column:
        if part == "*":
            return F.lit(True)
        if part[0] == ".":
            return F.array_contains(F.split(F.coalesce(node["attrs"]["class"], F.lit("")), " "), part[1:])
        if part[0] == "#":
            return F.coalesce(node["attrs"]["id"] == part[1:], F.lit(False))
        if part[0] != "[":
            return node["tag"] == part.lower()
        name, operator, value = re.fullmatch(r"([\w-]+)(\*?=)?(.*)", part[1:-1]).groups()
        attribute, value = node["attrs"][name.lower()], value.strip("\"'")
        if operator is None:
            return attribute.isNotNull()
        held = attribute == value if operator == "=" else attribute.contains(value) & F.lit(value != "")
        return F.coalesce(held, F.lit(False))

    def matches(node: Column) -> Column:
        test = F.lit(True)
        for part in parts:
            test = test & part_holds(part, node)
        return test

    return matches


def _placed(children: list[bool]):
    """Numbers of the elements that match the last step and stand below matches of the steps before."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def place(parents: pa.Array, lasts: pa.Array, *matches: pa.Array) -> pa.Array:
        found = []
        for i in range(len(parents)):
            if not parents[i].is_valid:
                found.append([])
                continue
            parent, last = (np.array(column[i].as_py(), np.int64) for column in (parents, lasts))
            hit = np.array(matches[0][i].as_py(), bool)
            for child, column in zip(children, matches[1:]):
                if child:
                    above = (parent >= 0) & hit[parent]
                else:
                    # Elements are in document order: how far the matches before an element reach.
                    reach = np.maximum.accumulate(np.where(hit, last, -1))
                    above = np.concatenate([[-1], reach[:-1]]) >= np.arange(len(hit))
                hit = np.array(column[i].as_py(), bool) & above
            found.append(np.flatnonzero(hit).tolist())
        return pa.array(found, pa.list_(pa.int32()))

    return place


def select_text(pages: DataFrame, selector: str) -> DataFrame:
    """Text of the elements a selector matches, one per line; ``''`` where none does.

    Supported: tag, ``*``, ``.class``, ``#id``, ``[a]``, ``[a=x]``, ``[a*=x]``, descendant and ``>``.
    """
    steps = re.findall(r"(>?)\s*((?:\[[^\]]*\]|[^\s>\[])+)", selector.strip())
    if not steps or steps[0][0] or re.sub(r"\s", "", selector) != "".join(a + re.sub(r"\s", "", b) for a, b in steps):
        raise ValueError(f"selector not supported: {selector!r}")
    nodes = F.col("dom.nodes")
    place = _placed([bool(child) for child, _ in steps[1:]])
    matches = [F.transform(nodes, _matcher(compound)) for _, compound in steps]
    hits = place(F.transform(nodes, lambda n: n["parent"]), F.transform(nodes, lambda n: n["last_node"]), *matches)
    found = _pages(pages).withColumn("hits", hits)
    texts = F.transform("hits", lambda i: strip(text_of(F.get(F.col("dom.nodes"), i))))
    return found.select("page_id", F.array_join(texts, "\n").alias("text"))


def analyze_pages(pages: DataFrame) -> DataFrame:
    """The full analysis row; a page that could not be fetched keeps its URL and its error."""
    defaults = {
        "fetch_success": F.lit(True),
        "error": F.lit(None).cast("string"),
        "status_code": F.lit(None).cast("int"),
        "fetched_at": F.lit(None).cast("timestamp"),
    }
    for name, value in defaults.items():
        if name not in pages.columns:
            pages = pages.withColumn(name, value)
    ok = F.coalesce(F.col("fetch_success"), F.lit(False))
    parsed = parse_pages(pages.withColumn("html", F.when(ok, F.col("html"))))
    return parsed.select(
        "page_id",
        "url",
        ok.alias("success"),
        F.when(~ok, F.coalesce("error", F.lit("Failed to fetch webpage"))).alias("error"),
        F.when(ok, F.col("title")).otherwise(F.lit(ERROR_TITLE)).alias("title"),
        F.when(ok, F.col("fetched_at")).alias("fetched_at"),
        F.when(ok, F.col("main_text")).alias("main_content"),
        F.when(ok, F.struct("headings", "lists", "tables")).alias("structure"),
        F.when(ok, F.col("extracted_dates")).alias("extracted_dates"),
        F.struct("status_code", ok.alias("fetch_success")).alias("metadata"),
    )


# ---- crawl log, cache, frontier --------------------------------------------------------------

# Answers worth another attempt, and how many attempts there are.
RETRY_STATUS = [403, 429, 503]
RETRY_ERRORS = ["ConnectionError", "Timeout"]
MAX_ATTEMPTS = 3


def attempt_class(status: Column, error_type: Column) -> Column:
    return (
        F.when(status == 200, F.lit("ok"))
        .when(status.isin(*RETRY_STATUS) | error_type.isin(*RETRY_ERRORS), F.lit("retryable"))
        .otherwise(F.lit("final"))
    )


def fetch_outcomes(crawl_log: DataFrame) -> DataFrame:
    """One row per URL from its logged attempts: ok, final error, or attempts exhausted.

    Input: url, attempt, status, error_type. Attempts after the deciding one do not count.
    """
    kind = attempt_class(F.col("status"), F.col("error_type"))
    log = crawl_log.select("url", "attempt", "status", (kind != "retryable").alias("decided"))
    # The window and the grouping need the same partitioning, so the log is shuffled once.
    end = F.min(F.when(F.col("decided"), F.col("attempt"))).over(W.partitionBy("url"))
    counted = log.withColumn("end", end).filter(F.col("end").isNull() | (F.col("attempt") <= F.col("end")))
    per_url = counted.groupBy("url").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(~F.col("decided")).alias("retryable"),
        F.max("end").alias("end"),
        F.max_by("status", "attempt").alias("last_status"),
    )
    ended = F.col("end").isNotNull()
    return per_url.select(
        "url",
        "attempts",
        "retryable",
        F.col("last_status").alias("status"),
        F.when(ended & F.col("last_status").eqNullSafe(200), F.lit("ok"))
        .when(ended, F.lit("final"))
        .when(F.col("retryable") >= MAX_ATTEMPTS, F.lit("exhausted"))
        .otherwise(F.lit("pending"))
        .alias("outcome"),
    )


def page_cache_rows(fetched: DataFrame, now: Column, page: str = "html") -> DataFrame:
    """What the cache keeps of fetched pages: the successful ones, stamped. Input: url, fetch_success and the page's column."""
    return fetched.filter(F.coalesce("fetch_success", F.lit(False))).select(
        cache_key(F.col("url")).alias("cache_key"), now.alias("cached_at"), F.col(page).alias("page")
    )


def store_pages(fetched: DataFrame, path: str, now: Column, page: str = "html") -> None:
    """Append successful pages to the cache; ``cached_pages`` takes the newest of a key."""
    page_cache_rows(fetched, now, page).write.mode("append").parquet(path)


def cached_pages(requests: DataFrame, cache: DataFrame, now: Column, ttl_hours: int = 24) -> DataFrame:
    """Requests with the newest cached page of their key, unless it is older than the TTL.

    Input: requests(url, ...), cache(cache_key, cached_at, page). The newest time of each key
    that is asked for comes first; only the pages of these times are moved.
    """
    asked = requests.withColumn("cache_key", cache_key(F.col("url")))
    valid = cache.filter(now - F.col("cached_at") <= F.make_dt_interval(hours=F.lit(ttl_hours)))
    keys = broadcast_if_small(cut_lineage(asked.select("cache_key").distinct()))
    times = valid.select("cache_key", "cached_at").join(keys, "cache_key", "left_semi")
    times = broadcast_if_small(cut_lineage(times.groupBy("cache_key").agg(F.max("cached_at").alias("cached_at"))))
    # A page that was stored twice at a time counts once.
    newest = valid.select("cache_key", "cached_at", "page").join(times, ["cache_key", "cached_at"], "left_semi").dropDuplicates(["cache_key"])
    return asked.join(newest.select("cache_key", "page", F.lit(True).alias("hit")), "cache_key", "left").withColumn(
        "hit", F.coalesce("hit", F.lit(False))
    )


def frontier(search_results: DataFrame, known: DataFrame, n: int = 2) -> DataFrame:
    """The top URLs of each query that have not been visited."""
    best = W.partitionBy("query_id").orderBy("rank", "url")
    top = search_results.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n)
    return top.join(known.select("url").distinct(), "url", "left_anti").select(
        "query_id", "place", "url"
    )


# ---- references to files -------------------------------------------------------------------


def resolve_sources(refs: DataFrame, registry: DataFrame) -> DataFrame:
    """Split references into web pages and files; file names match the registry in any case."""
    ref = F.col("ref")
    remote = ref.rlike(r"^(?:https?|ftp)://")
    filed = ref.rlike(r"/[^/]+\.(?:txt|pdf|md|json|csv|docx?)$")
    name = F.when(remote & ~filed, None).otherwise(F.regexp_extract(ref, r"([^/]+)$", 1))
    known = registry.groupBy(F.lower("filename").alias("name_key")).agg(
        F.min_by("path", F.struct("created_at", "id")).alias("known_path")
    )
    local = F.regexp_replace(ref, r"^file://", "")
    found = refs.withColumn("name_key", F.lower(name)).join(known, "name_key", "left")
    is_file = ~remote | F.col("known_path").isNotNull()
    return found.select(
        *refs.columns,
        F.when(is_file, F.lit("file")).otherwise(F.lit("web")).alias("kind"),
        F.when(is_file, F.coalesce("known_path", local)).otherwise(ref).alias("path"),
    )


def documents_as_pages(paths: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents in page form; a path without a document becomes a placeholder row.

    Input: paths(path), docs(path, filename, text, size_bytes, last_modified), one row per path.
    """
    known = docs.select("path", "filename", "text", "size_bytes", "last_modified")
    joined = paths.join(known, "path", "left")
    name = F.regexp_extract("path", r"([^/]+)/*$", 1)
    missing = F.concat(F.lit("[Document not found: "), F.col("path"), F.lit("]"))
    return joined.select(
        "path",
        F.concat(F.lit("file://"), F.col("path")).alias("url"),
        F.coalesce("filename", name).alias("title"),
        F.coalesce("text", missing).alias("content"),
        F.lit(None).cast("string").alias("html"),
        F.col("last_modified").alias("fetched_at"),
        "size_bytes",
    )


def document_headings(pages: DataFrame) -> DataFrame:
    """Markdown headings of documents in page form."""
    return markdown_headings(pages.select("url", "content"), "content")
