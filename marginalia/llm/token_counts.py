"""How many tokens a text has, by byte-pair merging without token identifiers.

A text is cut at special strings (one token each) and into pieces as the tokenizer's file says.
The symbols of a piece, its bytes, form a linked list; a heap gives the adjacent pair of the
lowest rank, the leftmost of equal ones, which is merged until no pair has a rank. The count is
the number of initial symbols less the number of merges.

Workers remember the counts of short pieces, in a memory of bounded size. Null and empty texts
have no tokens. Texts are read whole; nothing is shuffled, so repeated rows, ties and hot keys
make no difference, an empty table gives an empty result, and no column but the text is read.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.tokens import byte_alphabet, tokenizer_path

# Pieces whose counts a Python worker remembers; beyond it the memory starts afresh.
REMEMBERED_PIECES = 500_000
# Longer pieces are merged each time.
REMEMBERED_LENGTH = 64
# Texts of more characters are cut into pieces one by one.
LISTED_LENGTH = 1 << 20

# Fixed value: the pattern of byte-level tokenizers.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Outside these ranges the installed libraries may follow different versions of Unicode;
# texts with such characters are cut by the tokenizer's own library.
_SETTLED = [(0x00, 0x52F), (0x590, 0x85F), (0x900, 0xBFF), (0x1E00, 0x206F), (0x20A0, 0xA6FF), (0xAC00, 0xD7A3)]
_UNSETTLED = regex.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _SETTLED) + "]")


def merges_of(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges byte-pair encoding makes over the symbols, lowest rank first, leftmost among equals."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    held: list[str | None] = list(symbols)
    merged = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        # Entries of pairs that were merged away or changed since are passed over.
        if held[i] is None or j >= n or ranks.get((held[i], held[j])) != rank:
            continue
        held[i], held[j] = held[i] + held[j], None
        merged += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (rank := ranks.get((held[i], held[k]))) is not None:
                heapq.heappush(heap, (rank, i))
        if (h := before[i]) >= 0 and (rank := ranks.get((held[h], held[i]))) is not None:
            heapq.heappush(heap, (rank, h))
    return merged


class Counter(dict):
    """Counts of pieces, filled as they are asked for; ``of`` counts a text."""

    def __init__(self, tokenizer: str) -> None:
        from tokenizers import Tokenizer

        with open(tokenizer_path(tokenizer), encoding="utf-8") as source:
            known = json.load(source)
        model, cut = known["model"], known["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
        if model["type"] != "BPE" or not plain or known["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut["use_regex"]:
            raise ValueError(f"{tokenizer}: only plain byte-level byte-pair vocabularies can be counted")
        special = known["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
            raise ValueError(f"{tokenizer}: special strings that take in their surroundings cannot be counted")
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.alphabet = byte_alphabet()
        names = sorted((t["content"] for t in special), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.own_cut = Tokenizer.from_file(tokenizer_path(tokenizer)).pre_tokenizer

    def __missing__(self, piece: str) -> int:
        symbols = list(piece.encode().decode("latin-1").translate(self.alphabet))
        count = len(symbols) - merges_of(symbols, self.ranks)
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED_PIECES:
                self.clear()
            self[piece] = count
        return count

    def pieces(self, text: str) -> Iterator[str]:
        if _UNSETTLED.search(text):
            return (text[a:b] for _, (a, b) in self.own_cut.pre_tokenize_str(text))
        if len(text) > LISTED_LENGTH:
            return (found.group() for found in PIECES.finditer(text))
        return PIECES.findall(text)

    def of(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(part))) for part in parts if part)


@functools.lru_cache(maxsize=2)
def counter(tokenizer: str) -> Counter:
    return Counter(tokenizer)


def token_count(text: Column, tokenizer: str = "byte_bpe_50k.json") -> Column:
    """The number of tokens of a text column as bigint; 0 for null."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        tokens = counter(tokenizer)
        return pa.array([tokens.of(t.as_py()) if t.is_valid else 0 for t in texts], pa.int64())

    return count(text.cast("string"))


def count_tokens(docs: DataFrame, limit: int = 1024, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """``doc_id``, bytes and tokens of every text, and whether it has more tokens than ``limit``."""
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint")
    counted = docs.select("doc_id", size.alias("n_bytes"), token_count(F.col("text"), tokenizer).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
