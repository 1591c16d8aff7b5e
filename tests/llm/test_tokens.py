"""Token ids, packing and token files against plain encoding of whole texts."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm.packing import RoomTree, best_fit_plan, pack_documents, sequences
from marginalia.llm.token_files import read_manifest, read_token_files, write_token_files
from marginalia.llm.tokens import encoder

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = [
    "a  b", " x", "x ", "a\n b", "a \nb", "", "\n\n", "a\n\nb", "tab\tq", "  c d  e  f", "!\x1c! a\x1c b", None,
    "<|endoftext|> hi", "é café naïve İstanbul ΑΣ", "don't WE'LL 12 3x..", "日本語 テキスト", "a\u0085b", "a  b",
    "word " * 3 + "x" * 300, "Don't\nWE'll Élan,\nfin.", "ªº µ½ «ß»",
]


@pytest.mark.parametrize("name", NAMES)
def test_encoding_is_that_of_whole_texts(name, documents):
    words = encoder(name)
    texts = ODD + [r.text for r in documents.select("text").collect()]
    ids, starts = words.encode(texts)
    for i, text in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == words.whole(text or ""), text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'stLé ß\n\t.9 ́ﬁ")), max_size=12), max_size=4))
def test_encoding_of_any_text(texts):
    for name in NAMES:
        words = encoder(name)
        ids, starts = words.encode(texts)
        for i, text in enumerate(texts):
            assert ids[starts[i] : starts[i + 1]].tolist() == words.whole(text), text


@pytest.mark.parametrize("name", NAMES)
def test_plain_words_are_cut_together(name, monkeypatch):
    """Words of printable characters are not cut one by one, but for the first of a text; others are."""
    words, cut = encoder(name), []
    chunk = type(words).chunk
    monkeypatch.setattr(type(words), "chunk", lambda self, text: cut.append(text) or chunk(self, text))
    texts = ["One,two (3.5%) x_y\nElan: Éßÿ 12-a. end", "a×b ÷ ÿ÷ Ã× 日本 it's", "\na b\n c\n\nd", None, "x y"]
    ids, starts = words.encode(texts)
    assert "One,two" in cut or not words.spaced
    assert not {s + w for s in ("", " ") for w in ("(3.5%)", "x_y\nElan:", "Éßÿ", "12-a.", "end", "y")} & set(cut)
    for i, text in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == words.whole(text or ""), text


def plain_best_fit(lengths, capacity):
    """Rooms after placing pieces one by one, the longest first, each into the tightest room that holds it."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        room = min(fits, default=capacity)
        if fits:
            rooms.remove(room)
        rooms.append(room - n)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = best_fit_plan(counts, 20)
    filled = {}
    for n, count in counts.items():
        rows = plan[plan[:, 0] == n]
        for rank in range(count):
            row = rows[np.searchsorted(rows[:, 1], rank, side="right") - 1]
            later = rank - row[1]
            filled.setdefault(int(row[2] + later // row[3]), []).append((int(row[4] + later % row[3] * n), n))
    assert sorted(filled) == list(range(len(filled)))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 20
    assert sorted(20 - sum(n for _, n in p) for p in filled.values()) == plain_best_fit(lengths, 20)


def test_tightest_room():
    tree = RoomTree(100)
    for room in (3, 50, 100):
        tree.push(room, 0, 1)
    assert [tree.tightest(n) for n in (1, 3, 4, 50, 51, 100)] == [3, 3, 50, 50, 100, 100]
    tree.pop(100)
    assert tree.tightest(51) is None


def test_packing(spark, docs_of):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.choice([1, 5, 40, 200])))) for i in range(40)]
    rows += [(5, "again"), (7, None), (None, "no id"), (8, ""), (9, "same"), (9, "same")]
    packed = pack_documents(docs_of(*rows), capacity=64, with_ids=True)
    found = packed.collect()
    words = encoder(NAMES[0])
    wanted = {}
    for doc_id, text in rows:
        ids = words.whole(text or "") + [0]
        for k in range(0, len(ids), 64):
            wanted.setdefault((doc_id, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())), []).append(ids[k : k + 64])
    assert sorted(map(str, (tuple(r)[:5] for r in found))) == sorted(str(k) for k, v in wanted.items() for _ in v)
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, r.ids))
    for parts in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    joined = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    assert joined == {s: [i for _, _, ids in sorted(p) for i in ids] for s, p in by_sequence.items()}
    assert sorted(64 - sum(p[1] for p in v) for v in by_sequence.values()) == plain_best_fit([r.length for r in found], 64)


def test_packing_nothing(docs_of):
    assert pack_documents(docs_of()).collect() == []


def test_files(spark, documents, tmp_path):
    folder = write_token_files(documents, str(tmp_path / "a"))
    rows = read_token_files(spark, folder).orderBy("doc_id").collect()
    words, at = encoder(NAMES[1]), 0
    for r, d in zip(rows, documents.orderBy("doc_id").collect(), strict=True):
        ids = np.array(words.whole(d.text or "") + [0], "<u4")
        assert tuple(r) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    manifest = read_manifest(folder)
    assert manifest["tokens"] == at and manifest["type"] == "<u2"
    stored = sum((tmp_path / "a" / f"part-{p['part']}.tokens").stat().st_size for p in manifest["parts"])
    assert stored == 2 * at
    assert not [p for p in (tmp_path / "a").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_files_of_odd_rows(spark, docs_of, tmp_path):
    rows = [(2, None), (1, ""), (2, "b"), (2, "b"), (None, "none"), (0, "word " * 5000), (-7, "minus")]
    folder = write_token_files(docs_of(*rows), str(tmp_path / "b"))
    found = read_token_files(spark, folder).orderBy("start").collect()
    assert [r.n_tokens for r in found if r.doc_id == 1] == [1]
    assert sorted(r.n_tokens for r in found if r.doc_id == 2) == [1, 2, 2]
    assert [r.doc_id for r in found] == [None, -7, 0, 1, 2, 2, 2]
    assert len(found) == 7 and [r.start for r in found] == list(np.cumsum([0] + [r.n_tokens for r in found])[:-1])
    assert read_token_files(spark, write_token_files(docs_of(), str(tmp_path / "c"))).count() == 0


def test_one_id_in_many_parts(spark, docs_of, tmp_path):
    """An id that most rows have is dealt out over several parts, in one order."""
    rows = [(5, f"row {i}") for i in range(300)] + [(i, "x") for i in range(10)]
    folder = write_token_files(docs_of(*rows), str(tmp_path / "d"))
    found = read_token_files(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted(i for i, _ in rows)
    assert [r.start for r in found] == list(np.cumsum([0] + [r.n_tokens for r in found])[:-1])
    assert max(p["docs"] for p in read_manifest(folder)["parts"]) < 250


def test_other_operators_let_go_of_the_encoder():
    """A worker that goes on to another operator drops the encoder; one that goes on encoding keeps it."""
    from marginalia.llm.workers import giving_back

    first = encoder(NAMES[0])
    list(giving_back(iter, encoder)([]))
    assert encoder(NAMES[0]) is first
    list(giving_back(iter)([]))
    assert encoder.cache_info().currsize == 0
