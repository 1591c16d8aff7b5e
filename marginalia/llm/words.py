"""Words and lower case as the operators define them."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a word is a run of digits, a to z and characters beyond ASCII.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def plain_words(text: Column) -> Column:
    """Words in lower case; none in a null text."""
    found = F.regexp_extract_all(ascii_lower(text), F.lit(PLAIN_WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))
