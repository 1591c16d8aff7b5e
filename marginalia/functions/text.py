"""Scalar text, date and JSON functions. Every one is a Column expression."""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip() and str.split() treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same characters, and those of Python's \w, inside a Java character class under (?U).
SPACE = r"\s\x1c-\x1f"
WORD = r"\p{L}\p{N}_"

# File extension to language name; other extensions name themselves.
LANGUAGES = {
    "py": "python",
    "js": "javascript",
    "ts": "typescript",
    "jsx": "javascript react",
    "tsx": "typescript react",
    "cpp": "c++",
    "h": "c/c++ header",
    "cs": "c#",
    "rb": "ruby",
    "kt": "kotlin",
    "rs": "rust",
    "sh": "shell/bash",
}

# How an import line starts, per language.
IMPORT_PREFIXES = {
    "python": ["import ", "from "],
    "javascript": ["import ", "require("],
    "typescript": ["import ", "require("],
    "javascript react": ["import ", "require("],
    "typescript react": ["import ", "require("],
    "java": ["import "],
    "kotlin": ["import "],
}

# Fixed value: English month, day and four-digit year.
DATE_PATTERN = (
    r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    r"\s+\d{1,2},\s+\d{4}\b"
)

HEADING_PATTERN = rf"(?mdU)^(#+)[{SPACE}]+(.+)$"
MAX_QUERY_CHARS = 500


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def last_wins_map(entries: Column) -> Column:
    """Map from an array of (key, value) structs; of equal keys the last one counts."""

    def is_last(entry: Column, i: Column) -> Column:
        later = F.slice(entries, i + 2, F.size(entries))
        return ~F.exists(later, lambda other: other["key"] == entry["key"])

    return F.map_from_entries(F.filter(entries, is_last))


def strip(text: Column) -> Column:
    """Drop white space at both ends (all of it, not only spaces)."""
    return F.btrim(text, F.lit(WHITESPACE))


def content_id(content: Column) -> Column:
    """SHA-256 of the content: equal bytes are the same document."""
    return F.sha2(content, 256)


def clean_extracted_text(text: Column) -> Column:
    """One space per white-space run, and words broken by a hyphen joined again."""
    flat = F.regexp_replace(text, f"(?U)[{SPACE}]+", " ")
    return F.regexp_replace(flat, f"([{WORD}])- ([{WORD}]+)", "$1$2")


def collapse_blank(text: Column) -> Column:
    few_lines = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(few_lines, r" {2,}", " "))


def language_of(extension: Column) -> Column:
    bare = F.lower(F.regexp_replace(extension, r"^\.+", ""))
    names = F.create_map(*[F.lit(v) for pair in LANGUAGES.items() for v in pair])
    return F.coalesce(F.element_at(names, bare), bare)


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def import_lines(text: Column, language: Column, keep: int = 10) -> Column:
    """The first import lines of a source text; NULL where there is none."""

    def starts(line: Column) -> Column:
        rules = [
            (language == lang) & reduce(lambda a, b: a | b, [line.startswith(p) for p in prefixes])
            for lang, prefixes in IMPORT_PREFIXES.items()
        ]
        return reduce(lambda a, b: a | b, rules)

    lines = F.filter(F.transform(F.split(text, "\n", -1), strip), starts)
    return F.when(F.size(lines) > 0, F.slice(lines, 1, keep))


def code_metadata(files: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """Language, line count, byte size and imports of source files."""
    name = F.regexp_extract(F.col(path), r"([^/]+)$", 1)
    language = language_of(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.select(
        "*",
        language.alias("language"),
        name.alias("filename"),
        line_count(F.col(text)).alias("line_count"),
        F.octet_length(F.col(text)).cast("bigint").alias("file_size_bytes"),
        F.lit("code").alias("content_type"),
    )


def code_imports(files: DataFrame, text: str = "text", language: str = "language") -> DataFrame:
    return files.withColumn("imports", import_lines(F.col(text), F.col(language)))


def markdown_headings(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per Markdown heading, numbered from 0 within its row of ``df``."""
    rest = [c for c in df.columns if c != text]
    found = df.select(*rest, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(HEADING_PATTERN), 0)))
    return found.select(
        *rest,
        F.col("pos"),
        F.length(F.regexp_extract("col", r"^(#+)", 1)).alias("level"),
        strip(F.regexp_extract("col", HEADING_PATTERN, 2)).alias("heading"),
    )


def dates_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + DATE_PATTERN), 0)


def date_mentions(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per written-out date, with its value (NULL for a day that does not exist)."""
    rest = [c for c in df.columns if c != text]
    found = df.select(*rest, F.posexplode(dates_in(F.col(text))).alias("pos", "mention"))
    flat = F.regexp_replace("mention", f"(?U)[{SPACE}]+", " ")
    return found.withColumn("date", F.try_to_timestamp(flat, F.lit("MMMM d, yyyy")).cast("date"))


def slug(text: Column, size: int = 50) -> Column:
    kept = F.regexp_replace(F.lower(text), f"(?U)[^{WORD}{SPACE}-]+", "")
    return F.substring(F.regexp_replace(kept, f"(?U)[{SPACE}-]+", "_"), 1, size)


def clip(text: Column, size: int, suffix: str = "...") -> Column:
    """Cut to ``size`` characters, adding the suffix only where something was cut."""
    cut = F.concat(F.substring(text, 1, size), F.lit(suffix))
    return F.when(F.length(text) > size, cut).otherwise(text)


def cap_query(text: Column, size: int = MAX_QUERY_CHARS) -> Column:
    return F.substring(text, 1, size)


@F.arrow_udf(T.StringType())
def _last_of_keys(texts: pa.Array) -> pa.Array:
    """JSON texts written again, so that of a repeated key the last value stays; NULL for what is no JSON."""

    def written(text):
        try:
            return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, allow_nan=False)
        except (ValueError, RecursionError):
            return None

    return pa.array([written(t) for t in texts.to_pylist()], pa.string())


def repair_json(reply: Column) -> Column:
    """A model reply as a variant: fences, stray commas and cut tails are mended.

    What still does not parse is an empty object.
    """
    text = F.regexp_replace(reply, r"^```(?:json)?", "")
    text = strip(F.regexp_replace(text, r"```\z", ""))
    text = F.regexp_replace(text, r",(\s*[}\]])", "$1")
    text = F.regexp_replace(text, r"([}\]])(\s*)([{\[])", "$1,$2$3")

    def cut(text: Column) -> Column:
        whole = text.endswith("}") | text.endswith("]") | (F.instr(text, "}") <= 1)
        return F.when(whole, text).otherwise(F.regexp_extract(text, r"(?s)^.*\}", 0))

    def read(text: Column) -> Column:
        # Spark's parser stops after the first value; the closing member proves that all was read.
        framed = F.try_parse_json(F.concat(F.lit('{"reply":'), text, F.lit(',"all_read":1}')))
        return bind(
            framed,
            lambda v: F.when(
                F.try_variant_get(v, "$.all_read", "int").isNotNull(), F.try_variant_get(v, "$.reply", "variant")
            ),
        )

    mended = bind(text, cut)
    # Whether a repeated key is an error depends on the session; where it is, the last one is kept first.
    unread = F.when(read(mended).isNull(), mended)
    return F.coalesce(read(mended), read(_last_of_keys(unread)), F.parse_json(F.lit("{}")))


def token_estimate(text: Column) -> Column:
    """Words times 1.3."""
    return F.regexp_count(text, F.lit(f"(?U)[^{SPACE}]+")) * F.lit(1.3)


def shift_timestamps(
    df: DataFrame, column: str, years: int = 0, months: int = 0, days: int = 0
) -> DataFrame:
    """Correct a clock that runs ahead; a year counts 365 days and a month 30."""
    offset = years * 365 + months * 30 + days
    return df.withColumn(column, F.col(column) - F.make_interval(days=F.lit(offset)))


def cache_key(url: Column, is_search: bool = False) -> Column:
    return F.concat(F.lit("search_" if is_search else "page_"), F.md5(url), F.lit(".json"))


def short_id(document_id: Column) -> Column:
    """List view."""
    return F.concat(F.substring(document_id, 1, 8), F.lit("..."))


def hit_id(document_id: Column) -> Column:
    """Search view: both ends of a long id."""
    ends = F.concat(F.substring(document_id, 1, 8), F.lit("..."), F.substring(document_id, -8, 8))
    return F.when(F.length(document_id) > 20, ends).otherwise(document_id)


def size_kb(size_bytes: Column) -> Column:
    # Halves go to the even digit, as they do in the listings this must equal.
    return F.format_string("%.1f KB", F.bround(F.coalesce(size_bytes, F.lit(0)) / 1024, 1))


def mask_secret(secret: Column) -> Column:
    """First and last four characters; a secret of eight or fewer is starred in full."""
    size = F.length(secret)
    ends = F.concat(
        F.substring(secret, 1, 4), F.repeat(F.lit("*"), size - 8), F.substring(secret, -4, 4)
    )
    return F.when(size > 8, ends).otherwise(F.repeat(F.lit("*"), size))


def url_host(url: Column) -> Column:
    """Network location, with port and user part where the URL has them."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def display_score(distance: Column) -> Column:
    return F.round(F.lit(1.0) - distance, 4)
