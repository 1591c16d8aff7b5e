"""Decontamination, language, quality and extraction."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import decontamination, extraction
from marginalia.llm.decontamination import clean_documents, contamination, cut_spans
from marginalia.llm.extraction import extract_pages, page_blocks
from marginalia.llm.language import byte_windows, fold, identify, learn, quotas, train
from marginalia.llm.quality import isotonic, quality_scores, statistics

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(text, items, n=10):
    words, hit, found = plain_words(text), set(), set()
    for item_id, item in items:
        own = plain_words(item)
        windows = {tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))} if own else set()
        for w in windows:
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found |= {str(item_id)} if item_id is not None else set()
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit)


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (2, "Alpha, beta gamma!"),
    (10, "one two three four five six seven eight nine ten"),
    (3, None), (4, ""), (5, " ... "), (None, "omega psi chi phi"), (2, "Alpha, beta gamma!"),
]
TEXTS = [
    (1, "x ONE two,three four five six seven-eight nine ten eleven twelve y"),
    (2, "one two three four five six seven eight nine ten"),
    (3, "one two three four five six seven eight nine eleven"),
    (4, "alpha beta gamma alpha beta gamma"), (5, "alpha beta"), (6, None), (7, ""), (8, "the omega psi chi phi end"),
    (9, "é one two three four five six seven eight nine ten one two three four five six seven eight nine ten eleven twelve"),
    (2, "clean words of the same id"), (1, "x ONE two,three four five six seven-eight nine ten eleven twelve y"),
    (None, "so alpha beta gamma"), (None, "nothing"), (11, "gammaé beta alpha " * 900 + "alpha beta gamma"),
]


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_contamination(spark, docs_of, monkeypatch, broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", broadcast)
    benchmark = spark.createDataFrame([(i, t, 3) for i, t in ITEMS], "item_id bigint, text string, n_words int")
    found = contamination(docs_of(*TEXTS), benchmark).collect()
    wanted = [(i, *plain_contamination(t, ITEMS)) for i, t in TEXTS]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))


def test_clean_and_cut(spark, docs_of):
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = docs_of(*TEXTS)
    clean = clean_documents(docs, benchmark)
    assert clean.columns == docs.columns
    kept = sorted(str((r.doc_id, r.text)) for r in clean.collect())
    assert kept == sorted(str(r) for r in TEXTS if not plain_contamination(r[1], ITEMS)[4])
    cut = {r.doc_id: r.text for r in cut_spans(docs, benchmark).where("doc_id in (1, 4, 8, 9, 6, 7)").collect()}
    assert cut[1] == "x  ,    -     y"
    assert plain_words(cut[1]) == ["x", "y"] and plain_words(cut[9]) == ["é"] and plain_words(cut[8]) == ["the", "end"]
    assert cut[4].strip() == "" and cut[6] is None and cut[7] == ""


def test_empty_benchmark(spark, docs_of):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {r.contaminated for r in contamination(docs_of(*TEXTS), none).collect()} == {False}
    assert contamination(docs_of(), none).collect() == []
    assert clean_documents(docs_of(*TEXTS), none).count() == len(TEXTS)


def test_no_python_in_decontamination(spark, docs_of):
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    plan = contamination(docs_of(*TEXTS), benchmark)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


def test_language_held_out(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = learn(docs.where(fold("doc_id", 4) != 2))
    held = docs.where(fold("doc_id", 4) == 2)
    right = identify(held, net).agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert right >= 0.97


def test_language_of_odd_rows(spark, docs_of):
    taught = [(i, ("der und die das " if i % 2 else "the and of that ") * 20) for i in range(60)]
    docs = docs_of(*taught).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "de").otherwise("en"))
    net = learn(docs)
    odd = docs_of((1, None), (1, ""), (2, "12 .. \n"), (None, "the and of"), (3, "the and of " * 3000), (4, "der die und das")).drop("score")
    odd = odd.withColumn("lang_pred", F.lit("old"))
    out = identify(odd, net)
    assert out.columns == [c for c in odd.columns if c != "lang_pred"] + ["lang_pred", "score"]
    found = [(r.doc_id, r.lang_pred) for r in out.collect()]
    assert found == [(1, "und"), (1, "und"), (2, "und"), (None, "en"), (3, "en"), (4, "de")]
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert [r.lang_pred for r in identify(odd, learn(docs.where("lang is null"))).collect()] == ["und"] * 6
    assert identify(odd.limit(0), net).collect() == []


def test_rare_languages_are_learned(spark, docs_of):
    docs = docs_of(*[(i, ("der und die das " if i >= 1997 else "the and of that ") * 20) for i in range(2000)])
    net = learn(docs.withColumn("lang", F.when(F.col("doc_id") >= 1997, "de").otherwise("en")), sample=40)
    assert net.languages == ["de", "en"]
    assert quotas({"a": 3, "b": 10**9, "c": 10**6}, 8000) == {"a": 3, "b": 3999, "c": 3998}


def test_windows_hold_all_bytes():
    texts = ["a" * 128, "é" * 100, "x", "b" * 300]
    windows, of, sizes = byte_windows(texts)
    assert of.tolist() == [0, 1, 1, 2, 3, 3, 3] and sizes.tolist() == [128, 128, 72, 1, 128, 128, 44]
    for i, t in enumerate(texts):
        assert windows[of == i].tobytes().rstrip(b"\0") == t.encode()


def test_gradients():
    draw = np.random.default_rng(1)
    windows = draw.integers(1, 255, (3, 128)).astype(np.uint8)
    net = train(windows, ["a", "b", "a"], epochs=1)
    for name in ("embedding", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.filters, net.biases = [f.astype(np.float64) for f in net.filters], [b.astype(np.float64) for b in net.biases]
    wanted = np.array([0, 1, 0])

    def loss():
        logits = net.logits(windows)
        top = logits.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(logits - top).sum(axis=1)) + top[:, 0] - logits[np.arange(3), wanted]))

    for value, gradient in zip(net.parameters(), net.gradients(windows, wanted)):
        place = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        value[place] += 1e-5
        above = loss()
        value[place] -= 2e-5
        below = loss()
        value[place] += 1e-5
        assert abs((above - below) / 2e-5 - gradient[place]) < 1e-3 * max(1, abs(gradient[place]))


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality_scores(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([(r.score >= 0.3) == (r.quality == 1) for r in scored]) >= 0.93
    assert np.mean([(r.score - r.quality) ** 2 for r in scored]) < 0.05


def test_quality_of_odd_rows(spark, docs_of):
    rows = [(1, None), (1, ""), (2, "a"), (2, "a"), (None, "no id"), (3, "word " * 20000), (4, "x\n" * 9)]
    labels = spark.createDataFrame([(2, 1, 9), (2, None, 9), (3, 0, 9), (None, 1, 9), (77, 1, 9)], "doc_id bigint, quality int, score int")
    found = quality_scores(docs_of(*rows), labels).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    assert {r.score for r in quality_scores(docs_of(*rows), labels.limit(0)).collect()} == {0.0}
    assert quality_scores(docs_of(), labels).collect() == []
    assert len(statistics("a b")) == len(statistics(None)) == len(statistics("é" * 100000))


def test_isotonic():
    draw = np.random.default_rng(0)
    mean, weight = draw.random(50), draw.random(50) + 0.1
    fitted = isotonic(mean, weight)
    assert (np.diff(fitted) >= -1e-12).all() and abs((fitted * weight).sum() - (mean * weight).sum()) < 1e-9
    # The min-max formula of isotonic regression.
    mean_of = lambda a, b: (mean[a:b] * weight[a:b]).sum() / weight[a:b].sum()
    for i in range(50):
        assert abs(fitted[i] - max(min(mean_of(a, b) for b in range(i + 1, 51)) for a in range(i + 1))) < 1e-9


@pytest.mark.parametrize(
    "page,blocks",
    [
        ("<body><nav>m</nav><article><h1>T &amp; a</h1><p><b>one<br>two<p>thr<i>ee</i></p><aside>s</aside></article><footer>f</footer>", ["T & a", "one two", "three"]),
        ("<main>top<div class='ad'>buy</div><p hidden>no<p>yes&nbsp; &#233;</main>after", ["top", "yes é"]),
        ("<main>m<article>a<section id=comments>c</section><ul><li>x<li>y</ul></article></main>", ["a", "x", "y"]),
        ("<div class='cookie-notice'>c</div><div class=content>plain <!-- x --> text</div><form>f</form><script>var a='</p>'</script>", ["plain text"]),
        ("<article><div role=navigation>n</div><p style='display: none'>h</p>a &lt;b&gt; 1 < 2</article>", ["a <b> 1 < 2"]),
        ("<article class='comment'>reader</article><article>own</article>", ["own"]),
        ("", []), ("no tags", ["no tags"]), ("<p", ["<p"]), ("<article><p></article>", []),
    ],
)
def test_blocks(page, blocks):
    assert page_blocks(page)[0] == blocks


def test_names_and_values_of_attributes():
    kept = ['href="/hidden-valley"', "title='so hidden'", "alt=hidden", 'data-topic="hidden costs"', 'data-class="ad"', 'data-id=menu', "data-role='dialog'", 'href=/a/hidden', 'title="x id=menu"']
    gone = ["hidden", "HIDDEN", 'hidden=""', "hidden = 'until-found'", 'title="x" hidden', 'class = "ad"', "id=menu", "href=/a/ hidden", "role='dialog'", 'aria-hidden="true"']
    for tag in ("a", "p"):
        assert [page_blocks(f"<article><{tag} {x}>text</{tag}></article>")[0] for x in kept] == [["text"]] * len(kept)
        assert [page_blocks(f"<article><{tag} {x}>text</{tag}></article>")[0] for x in gone] == [[]] * len(gone)


def test_pages(spark):
    body = "<div>All news of the day on one page for you all</div><p>Story {0} tells of {0} and only that, at some length.</p><p>Write to us at the usual place by Friday of the week</p>"
    rows = [(i, "http://a.example/x", body.format(f"n{i} m{i}")) for i in range(20)]
    rows += [(3, "http://a.example/y", rows[3][2]), (30, "http://b.example/", body.format("q")), (31, None, None), (None, "http://a.example", ""), (32, "http://a.example", "<article>" + "w " * 50000 + "</article>")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id bigint, url string, html string, text string, _host int")
    found = [(r.page_id, r.url, r.text, r.n_chars) for r in extract_pages(pages).collect()]
    assert len(found) == len(rows) and all(len(t) == n for _, _, t, n in found)
    texts = {}
    for i, _, t, _ in found:
        texts.setdefault(i, set()).add(t)
    for i in range(20):
        assert texts[i] == {f"Story n{i} m{i} tells of n{i} m{i} and only that, at some length."}
    assert len(texts[30].pop().split("\n")) == 3
    assert texts[31] == {""} and texts[None] == {""} and len(texts[32].pop()) == 99999
    assert extract_pages(pages.limit(0)).collect() == []


def test_table_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r.text for r in extract_pages(pages).collect()}
    import html

    for r in pages.collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert found[r.page_id] == "\n".join(b for b in blocks if b)


def plain_common_runs(articles, k=8, share=0.8, least=8):
    """Texts of the articles of one host without the runs that most of them have, by comparing all runs."""
    def runs(blocks):
        return {(b, i): tuple(words[i : i + k]) for b, words in enumerate(blocks) for i in range(len(words) - k + 1)}

    distinct = [set(runs(a).values()) for a in {tuple(map(tuple, a)) for a in articles}]
    counts = {r: sum(r in d for d in distinct) for d in distinct for r in d}
    common = {r for r, n in counts.items() if n >= least and n >= share * len(distinct)}
    texts = []
    for blocks in articles:
        gone = {(b, i + j) for (b, i), r in runs(blocks).items() if r in common for j in range(k)}
        if 2 * len(gone) > sum(map(len, blocks)):
            gone = set()
        lines = [" ".join(w for i, w in enumerate(words) if (b, i) not in gone) for b, words in enumerate(blocks)]
        texts.append("\n".join(line for line in lines if line))
    return texts


@pytest.mark.parametrize("held", [1_000_000, 50])
def test_common_runs_of_articles(spark, monkeypatch, held):
    monkeypatch.setattr(extraction, "HELD", held)
    draw = np.random.default_rng(7)
    notice = "you may read three more stories for free this month".split()
    hosts = {}
    for n, size in enumerate((7, 8, 30, 40)):
        for i in range(size):
            own = [[f"w{x}" for x in draw.integers(0, 400, draw.integers(1, 30))] for _ in range(3)]
            told = own[1][:5] + notice + own[1][5:] if i % 10 != 3 or n == 1 else own[1]
            hosts.setdefault(f"h{n}.example", []).append([["Summary"], own[0], told, own[2] + ["by"]])
    hosts["near.example"] = [[[f"t{i}"], [f"s{j}" for j in range(30)]] for i in range(12)]
    hosts["few.example"] = [[*a[:2], notice if i % 2 else ["none"], *a[2:]] for i, a in enumerate(hosts["h0.example"] * 2)]
    hosts["h3.example"] += hosts["h3.example"][:5] * 30
    rows, wanted = [], {}
    for host, articles in hosts.items():
        for blocks, text in zip(articles, plain_common_runs(articles)):
            html = "<article>" + "".join(f"<p>{' '.join(b)}</p>" for b in blocks) + "</article>"
            wanted[len(rows)] = text
            rows.append((len(rows), f"http://{host}/{len(rows)}", html))
    assert "three more stories" not in wanted[9] and "three more stories" in wanted[0]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in extract_pages(pages).collect()} == wanted
