"""Token counts against the tokenizer's own library."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import token_counts
from marginalia.llm.token_counts import Counter, count_tokens, counter, merges_of
from marginalia.llm.tokens import tokenizer_path

NAME = "byte_bpe_50k.json"
ODD = [
    "", " ", "a  b ", "\n\n x", "don't WE'LL we'll 12 3x..", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "<|endoftext", "naïve İstanbul ß",
    "日本語 テキスト", "ش ىي عربي", "a\u0085b c", "!\x1c! a\x1c b", "\U00010940౜ x", "🙂🙂 🙂", "\x00\x01 a", "word " * 50 + "x" * 400, "ab" * 3000,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokenizer_path(NAME))
    return lambda text: len(known.encode(text, add_special_tokens=False).ids)


def plain_merges(symbols, ranks):
    """Join the leftmost of the pairs of the lowest rank until none is left."""
    symbols, merged = list(symbols), 0
    while True:
        known = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        if not known:
            return merged
        _, i = min(known)
        symbols[i : i + 2] = ["".join(symbols[i : i + 2])]
        merged += 1


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=25), st.permutations([("a", "b"), ("b", "a"), ("ab", "a"), ("a", "a"), ("aa", "aa"), ("c", "ab"), ("b", "c"), ("ba", "ba")]))
def test_merges_are_those_of_repeated_search(text, order):
    ranks = {pair: i for i, pair in enumerate(order)}
    assert merges_of(list(text), ranks) == plain_merges(text, ranks)


def test_whole_texts(documents, library):
    tokens = counter(NAME)
    for text in ODD + [r.text for r in documents.select("text").collect()]:
        assert tokens.of(text) == library(text), text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_any_text(library, text):
    assert counter(NAME).of(text) == library(text)


def test_settled_characters_are_cut_alike():
    """Every character that is not left to the library, beside a letter, a digit, a mark and a space."""
    tokens = counter(NAME)
    settled = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not token_counts._UNSETTLED.search(chr(c))]
    for around in ("a{}", "1{}", "!{}", " {}x"):
        text = "\n".join(around.format(c) for c in settled)
        assert [len(p) for p in tokens.pieces(text)] == [b - a for _, (a, b) in tokens.own_cut.pre_tokenize_str(text)]


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(token_counts, "REMEMBERED_PIECES", 20)
    monkeypatch.setattr(token_counts, "LISTED_LENGTH", 50)
    tokens = Counter(NAME)
    text = " ".join(f"word{i} {'y' * i}" for i in range(200))
    assert tokens.of(text) == library(text)
    assert len(tokens) <= 20 and max(map(len, tokens)) <= token_counts.REMEMBERED_LENGTH


def test_rows(spark, docs_of, library):
    text = "It's 12 o'clock. " * 4000
    docs = docs_of((1, None), (2, ""), (3, text), (3, text), (None, "a b"), (4, "é")).withColumnRenamed("score", "n_tokens")
    got = sorted(map(tuple, count_tokens(docs, limit=1).collect()), key=str)
    n = library(text)
    assert got == sorted(
        [(1, 0, 0, False), (2, 0, 0, False), (3, len(text), n, True), (3, len(text), n, True), (None, 3, 2, True), (4, 2, 1, False)], key=str
    )
    assert count_tokens(docs.limit(0)).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        Counter("word_bpe_49k.json")
