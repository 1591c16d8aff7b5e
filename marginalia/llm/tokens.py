"""Token ids of whole texts, with a bounded memory of words seen before.

Texts are cut at single spaces and words are numbered by Arrow. Plain words are cut into pieces by
their bytes, all of a batch at once; of pieces and of other words only those that a worker
has not met are given to the tokenizer. The result is that of encoding each whole text.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marginalia.llm.workers import let_go_later

# Words, and pieces of words, whose ids a Python worker remembers: half of them those met last.
REMEMBERED_WORDS = 200_000
REMEMBERED_PIECES = 500_000
# Longer words are encoded each time.
REMEMBERED_LENGTH = 64
# Bytes of text that are encoded in one step, or one text.
AT_ONCE = 6_000_000

_SPACE = r"\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")
# Texts in which a space stands beside white space or at an end are cut by _CHUNK instead.
_UNEVEN = r"[\s\x{85}\p{Z}] | [\s\x{85}\p{Z}]|^ | $"
# How the two kinds of tokenizers split printable ASCII and the accented letters of Latin-1.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(" ?[!-~À-ÖØ-öø-ÿ]+")
_LINES = re.compile("( ?[!-~À-ÖØ-öø-ÿ]+\n)+[!-~À-ÖØ-öø-ÿ]+")
_SPACED_PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^ {_LETTER}0-9]+")
_LOWER_PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9]+")
_PROBES = ["Don't", "we'LL", "a1b22", "x--y.", "(3.5%)", "'sun", "~!@#", "It's", "Élan,", "«straße»ÿ", "é1", "on.\nThe", "a\nb,\nc"]
# The same by bytes: letters (those of Latin-1 have two bytes, the first 0xC3), digits, other printable ones, the space before a
# word, a line end. Words with any other byte, and those with an apostrophe, are cut by the expressions above.
_OTHER, _LETTERS, _DIGIT, _MARK, _BEFORE, _END = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _MARK
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = _LETTERS
_KIND[48:58], _KIND[32], _KIND[10], _KIND[39] = _DIGIT, _BEFORE, _END, _OTHER
# Byte-level vocabularies spell bytes as characters: printable ones as they are, the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


def byte_alphabet() -> dict[int, int]:
    """The characters that stand for bytes where they are not printable, for ``str.translate``."""
    return _ALPHABET


def tokenizer_path(tokenizer: str) -> str:
    """A path as it is; a bare file name is one of the installed public vocabularies."""
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def _bytes_of(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins, with the end."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8)
    return held, at - at[0]


def _spread(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ``flat``, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"={len(ids)}I", *ids)


class Memory:
    """Ids as bytes by text, in two halves: when the young one is full it becomes the old one, whose rest goes."""

    def __init__(self, size: int) -> None:
        self.half = size // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, text: str) -> bytes | None:
        ids = self.young.get(text)
        if ids is None and (ids := self.old.get(text)) is not None:
            self.put(text, ids)
        return ids

    def put(self, text: str, ids: bytes) -> None:
        if len(text) <= REMEMBERED_LENGTH:
            if len(self.young) >= self.half:
                self.old, self.young = self.young, {}
            self.young[text] = ids

    def clear(self) -> None:
        self.young, self.old = {}, {}


class Encoder:
    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(tokenizer))
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.spaced = self.whole(" a") != self.whole("a")
        # Ids as bytes of unsigned 32-bit integers, which join fast and take little room.
        self.memory, self.pieces = Memory(REMEMBERED_WORDS), Memory(REMEMBERED_PIECES)
        self.quick = True
        probes = [" " + p if self.spaced else p for p in _PROBES]
        self.quick = all(self.chunk(p) == _packed(self.whole(p)) for p in probes)
        self.memory.clear()
        self.pieces.clear()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def chunk(self, text: str) -> bytes:
        """Ids of a word with the space before it, or of a run of white space."""
        known = self.memory.get(text)
        if known is not None:
            return known
        if self.quick and _LINES.fullmatch(text):
            ids = self.chunk("\n").join(map(self.chunk, text.split("\n")))
        elif not (self.quick and _PLAIN.fullmatch(text)):
            ids = _packed(self.whole(text))
        else:
            found = _SPACED_PIECES.findall(text) if self.spaced else _LOWER_PIECES.findall(text.lower())
            ids = self.piece(found[0]) if len(found) == 1 else b"".join(map(self.piece, found))
        self.memory.put(text, ids)
        return ids

    def piece(self, text: str) -> bytes:
        known = self.pieces.get(text)
        if known is None:
            if text.isascii():  # printable, but for a space before it
                symbols = "\u0120" + text[1:] if text[0] == " " else text
            else:
                symbols = text.encode().decode("latin-1").translate(_ALPHABET)
            known = _packed([t.id for t in self.model.tokenize(symbols)])
            self.pieces.put(text, known)
        return known

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (uint32), and where each text's begin, with the end."""
        texts = pc.fill_null(pa.array(texts, pa.string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
        parts = [self._encode(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if a < b]
        if not parts:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        counts = np.concatenate([np.diff(starts) for _, starts in parts])
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([[0], np.cumsum(counts)])

    def _words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has. Plain words are cut into pieces by their bytes."""
        plain = self._plain(words)
        rest = words.filter(pa.array(~plain)).to_pylist()
        ids = [self.chunk(w) if w else b"" for w in rest]
        size = np.zeros(len(words), np.int64)
        size[~plain] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        if not plain.any():
            return flat, size
        cut = words.filter(pa.array(plain))
        held, at = _bytes_of(cut if self.spaced else pc.utf8_lower(cut))
        kind = _KIND[held]
        new = np.ones(len(held), bool)
        new[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != _BEFORE)
        if not self.spaced:
            new |= kind == _DIGIT
        new[at[:-1]] = True
        bounds = np.append(np.flatnonzero(new), len(held)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(held)).dictionary_encode()
        get = self.pieces.young.get
        met = [get(p) or (self.chunk(p) if p == "\n" else self.piece(p)) for p in pieces.dictionary.to_pylist()]
        piece = pieces.indices.to_numpy(zero_copy_only=False)
        sizes = np.fromiter(map(len, met), np.int64, len(met)) // 4
        lengths = sizes[piece]
        found = _spread(np.frombuffer(b"".join(met), np.uint32), (np.cumsum(sizes) - sizes)[piece], lengths)
        before = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(bounds, at)]
        size[plain] = np.diff(before)
        if not rest:
            return found, size
        # Both kinds in the order of the words.
        own = size[plain]
        starts = np.empty(len(words), np.int64)
        starts[plain] = np.cumsum(own) - own
        own = size[~plain]
        starts[~plain] = len(found) + np.cumsum(own) - own
        return _spread(np.concatenate([found, flat]), starts, size), size

    def _plain(self, words: pa.StringArray) -> np.ndarray:
        """Which words can be cut by their bytes."""
        held, at = _bytes_of(words)
        if not self.quick or not len(held):
            return np.zeros(len(words), bool)
        kind = _KIND[held]
        odd = kind == _OTHER
        # The signs of multiplication and division are the only ones of their block that are not letters.
        odd[1:] |= (held[:-1] == 0xC3) & ((held[1:] == 0x97) | (held[1:] == 0xB7))
        # A line end stands between two others.
        end = kind == _END
        inner = (kind != _END) & (kind != _BEFORE)
        odd |= end & ~(np.append(False, inner[:-1]) & np.append(inner[1:], False))
        full = at[1:] > at[:-1]
        odd[at[:-1][full]] |= end[at[:-1][full]]
        odd[at[1:][full] - 1] |= end[at[1:][full] - 1]
        counted = np.concatenate([[0], np.cumsum(odd)])
        return (counted[at[1:]] == counted[at[:-1]]) & (at[1:] - at[:-1] > int(self.spaced))

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        uneven = np.zeros(len(texts), bool)
        if self.spaced:
            uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
        even = pc.if_else(pa.array(uneven), "", texts) if uneven.any() else texts
        words = pc.split_pattern(even, " ")
        n_words = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        listed = words.flatten().dictionary_encode()
        number = listed.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = listed.dictionary
        first = np.concatenate([[0], np.cumsum(n_words)])[:-1]
        if self.spaced:
            starts = known.take(pa.array(number[first])).to_pylist()
            number[first] = len(known) + np.arange(len(first))
            known = pc.binary_join_element_wise("", known, " ")
        flat, size = self._words(known)
        if self.spaced:
            ids = [self.chunk(w) if w else b"" for w in starts]
            flat = np.concatenate([flat, np.frombuffer(b"".join(ids), np.uint32)])
            size = np.concatenate([size, np.fromiter(map(len, ids), np.int64, len(ids)) // 4])
        lengths = size[number]
        ends = np.cumsum(lengths)
        out = _spread(flat, (np.cumsum(size) - size)[number], lengths)
        by_text = np.concatenate([[0], ends])[np.concatenate([first, [len(number)]])]
        if not uneven.any():
            return out, by_text
        parts = []
        for i, text in enumerate(texts.to_pylist()):
            if uneven[i]:
                parts.append(np.frombuffer(b"".join(map(self.chunk, _CHUNK.findall(text))), np.uint32))
            else:
                parts.append(out[by_text[i] : by_text[i + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def short_batches(batches: Iterable[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that less is held at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


@let_go_later
@functools.lru_cache(maxsize=2)
def encoder(tokenizer: str) -> Encoder:
    return Encoder(tokenizer)


def with_end(ids: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids followed by the end id."""
    n = len(starts) - 1
    out = np.insert(ids, starts[1:], np.uint32(end)) if n else ids
    return out.astype(np.uint32), starts + np.arange(n + 1)
