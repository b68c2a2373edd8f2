"""Networks, trees and searches: held-out accuracy, brute force, and odd rows."""

import math
import random
import time

import numpy as np
import pyspark.sql.functions as F
import pytest

from tesselark.llm import langid, nets, pages, quality, topk, toxicity
from tesselark.llm.shared import crc_mod

ODD = [(None, "no id here", None), (1, None, "x"), (2, "", "x"), (3, "123 ... 456", "x"), (4, "word " * 20000, "x"), (4, "word " * 20000, "x"), (5, "é", None), (6, "a", "x")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, score string")


def numeric(loss, params, name, at, eps=1e-2):
    old = params[name][at]
    params[name][at] = old + eps
    up = loss()
    params[name][at] = old - eps
    down = loss()
    params[name][at] = old
    return (up - down) / (2 * eps)


class Catch:
    def __init__(self):
        self.grads = None

    def step(self, grads, scale=1.0):
        self.grads = grads


def test_gradients_through_time_are_right():
    rng = np.random.default_rng(0)
    net = langid.ByteGru.fresh(["a", "b"], hidden=4)
    x, y = rng.integers(0, 256, (7, 3)), np.array([0, 1, 0])
    mask = np.ones((7, 3), bool)
    mask[5:, 1] = False
    catch = Catch()

    def loss():
        return net.learn(x, mask, y, Catch(), 1.0)

    net.learn(x, mask, y, catch, 1.0)
    for name in ("fu", "bu", "fo", "bo", "fx", "bx"):
        at = (int(x[2, 0]), 1) if name.endswith("x") else (1, 1)
        assert numeric(loss, net.p, name, at) == pytest.approx(float(catch.grads[name][at]), abs=3e-3)


def test_fast_positions_equal_the_training_states():
    net = langid.ByteGru.fresh(["a", "b", "c"])
    x = np.random.default_rng(1).integers(0, 256, (9, 5))
    s = net._states(x)
    want = nets.softmax(s["f"][0][1:] @ net.p["fo"] + (s["b"][0][1:] @ net.p["bo"])[::-1] + net.p["o"])
    assert np.allclose(net.positions(x), want, atol=1e-5)


def test_language_windows_cover_texts():
    ends = np.array([0, 0, 5, 5 + langid.WINDOW, 5 + 3 * langid.WINDOW + 1])
    start, length, owner = langid.windows_of(None, ends)
    seen = np.zeros(ends[-1], int)
    for s, n in zip(start, length):
        seen[s : s + n] += 1
    assert (seen == 1).all() and set(owner) == {1, 2, 3}


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = crc_mod(F.col("doc_id"), 4) == 2
    net = langid.train(docs, ~held)
    got = langid.label(docs.where(held), net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    rows = langid.label(odd(spark), net).collect()
    assert len(rows) == len(ODD)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert langid.label(spark.createDataFrame([], "doc_id long, text string"), net).count() == 0


def test_language_id_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    net = langid.train(docs, F.lit(True))
    assert [tuple(r)[:3] for r in langid.label(docs, net).collect()] == [(1, "und", 0.0)]


def test_quality_chunks_cover_texts():
    for n in (0, 1, 4, quality.CHUNK, quality.CHUNK + 1, 5 * quality.CHUNK + 17):
        start, length, _ = quality.chunks_of(np.array([0, n]))
        seen = np.zeros(n, int)
        for s, k in zip(start, length):
            seen[s : s + k] += 1
        assert (seen >= 1).all() and len(start) >= 1


def test_quality_paths_agree():
    net = quality.ByteConv.fresh()
    data = np.random.default_rng(2).integers(0, 256, 1700).astype(np.uint8)
    start, length, _ = quality.chunks_of(np.array([0, 1, 1, 700, 1700]))
    assert np.allclose(net.activations(data, start, length), net.pooled(data, start, length)[0], atol=1e-4)


@pytest.mark.parametrize(("module", "label", "mod", "out", "least"), [(quality, "quality", 5, 0, 0.9), (toxicity, "toxic", 4, 2, 0.85)])
def test_classifiers_on_held_out_documents(spark, module, label, mod, out, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = crc_mod(F.col("doc_id"), mod) == out
    model = module.train(docs, labels, ~held)
    got = module.score(docs.where(held), model).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r[label] for r in got]) > least
    rows = module.score(odd(spark), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert module.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    one = module.train(docs, labels.where("quality = 9"), F.lit(True))  # nothing to learn from
    assert module.score(odd(spark), one).count() == len(ODD)


def test_isotonic_pools_and_trees():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0, 1, 0, 1]), np.ones(4))
    assert list(y) == [0, 0.5, 1] and (np.diff(x) > 0).all()
    rng = np.random.default_rng(0)
    f = rng.normal(size=(600, 4))
    t = ((f[:, 0] > 0.3) ^ (f[:, 2] > 0)).astype(int)
    assert ((toxicity.Trees.fit(f, t).raw(f) > 0) == t).mean() > 0.97


def brute(rows, k):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in dict((i, v) for i, v in good if i % 50 == 0).items():
        scores = sorted(((-sum(x * y for x, y in zip(a, v)), i) for i, v in good if i != q))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)}
    return out


def test_top_k_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice((-1.0, -0.5, 0.0, 0.25, 1.5)) for _ in range(6)]) for i in range(400)]
    rows += [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1050, [float("nan")] * 6), (None, [1.0] * 6), (1100, [float("inf")] + [0.0] * 5), (1150, [0.0] * 6)]
    frame = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, score long")
    got = {tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0, block=64, queries=3).collect()}
    assert got == brute(rows, 5)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(few, F.col("vec_id") == 0).collect()} == {(0, 1, 1, 256 * 512)}
    assert topk.top_k(few.where("false"), F.col("vec_id") == 0).count() == 0


def test_samples_do_not_depend_on_the_order_of_rows(spark):
    rows = [(i % 20, f"text {i} of many", ("aa", "bb")[i % 3 == 0]) for i in range(200)]
    marks = [(i, i % 2) for i in range(20)] + [(3, 0), (3, 1), (4, None)]
    found = []
    for seed in (1, 2):
        docs = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "doc_id long, text string, lang string").repartition(seed + 1)
        labels = spark.createDataFrame(random.Random(seed).sample(marks, len(marks)), "doc_id long, quality int").repartition(seed)
        found.append((langid.sample(docs, F.lit(True), "doc_id", "text", "lang", 7), quality.labelled(docs, labels, F.lit(True), "quality", 6)))
    assert found[0] == found[1] and len(found[0][0]) >= 7


def test_document_scores_are_pooled_over_all_positions():
    """Windows and chunks by themselves, one at a time, give a document's scores."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 95, 96, 97, 700)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    net = langid.ByteGru.fresh(["a", "b", "c"])
    for text, got in zip(texts, net.texts(data, ends)):
        parts = []
        for i in range(0, len(text), langid.WINDOW):
            window = text[i : i + langid.WINDOW]
            filled = np.frombuffer(window.ljust(langid.WINDOW, b"\0"), np.uint8)
            parts.append(net.positions(filled[:, None])[: len(window), 0])
        assert np.allclose(np.concatenate(parts).mean(0), got, atol=1e-5)
        alone = net.texts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert np.allclose(alone[0], got, atol=1e-6)


def test_top_k_of_repeated_ids_and_lengths(spark):
    rows = [(50, [2.0, 1.0]), (50, [1.0, 3.0]), (50, [9.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [5.0]), (3, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, topk.top_k(frame, F.col("vec_id") == 50).collect()))
    assert got == [(50, 1, 2, 2304 * 1280)]
    got = sorted(map(tuple, topk.top_k(frame.where("size(embedding) = 2"), F.col("vec_id") == 50).collect()))
    assert got == [(50, 1, 1, 4 * 65536), (50, 2, 1, 4 * 65536)]
    many = spark.createDataFrame([(7, [float(i % 3)]) for i in range(3000)] + [(50, [1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(many, F.col("vec_id") == 50, k=2, block=100).collect()] == [(50, n, 7, 2 * 65536) for n in (1, 2)]


def test_threshold_stops_early():
    rng = np.random.default_rng(0)
    v = rng.integers(-3, 3, (5000, 3))
    v[7] = 100
    found = topk.threshold_top(topk.Lists(v, np.arange(5000)), np.array([[1, 1, 1]]), np.array([-1]), 1)
    assert found[0][0].tolist() == [7] and found[0][1].tolist() == [300]


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body><nav><a href=/x>Home</a></nav>
<div class="cookie-notice">We use cookies here</div><article><h1>A &amp; B</h1><p>First   part<br>goes on &eacute;&#233;.<p>Second <b>bold</b> part, and more words in it.</p>
<!-- hidden <p>x</p> --><div class="ad">Buy this now</div><p>Third part of the text is here, with a few words.</p></article>
<section class="comments"><p>Nice one, I liked it.</p></section><footer>(c) 2020</footer>"""


def article_of(page):
    """The article by the standard library's parser: what stands in an article element, but for its adverts."""
    from html.parser import HTMLParser

    inline = "a abbr b br code em i img q small span strong sub sup u wbr".split()

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.blocks, self.parts, self.article, self.boxes = [], [], 0, []

        def flush(self):
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(text)
            self.parts = []

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.parts.append(" ")
            if tag not in inline:
                self.flush()
            self.article += tag == "article"
            if tag in ("div", "aside", "section", "nav", "footer", "form"):
                self.boxes.append(tag != "div" or bool({"ad", "promo", "related", "share"} & set((dict(attrs).get("class") or "").split())))

        def handle_endtag(self, tag):
            if tag not in inline:
                self.flush()
            self.article -= tag == "article"
            if tag in ("div", "aside", "section", "nav", "footer", "form") and self.boxes:
                self.boxes.pop()

        def handle_data(self, data):
            if self.article and not any(self.boxes) and self.cdata_elem is None:
                self.parts.append(data)

    reader = Reader()
    reader.feed(page)
    reader.close()
    reader.flush()
    return "\n\n".join(reader.blocks)


def test_elements_without_an_end_lose_no_other_text():
    def texts(page):
        return [b.text for b in pages.blocks_of(page)]

    for odd in ("<svg/>", "<svg>", "<select>", "<select><option>o", "<textarea>", "<iframe src=x>", "<iframe/>", "<noscript>", "<template>", "<script src=x />", "<script>x<y</script >", "<!-->", "<style/>", "<br/>", "<a b='>\">", "<p class=\"x>y\">"):
        assert texts(f"<article><p>a</p>{odd}<p>b</p><p>c</article><p>d")[-3:] == ["b", "c", "d"], odd
    assert texts("<article><p>a</p><noscript><p>n</p></noscript><svg><title>t</title></svg></article>") == ["a", "n"]
    assert texts("<p>a<svg><text>t</text></svg> b <select><option>o</select>c") == ["a b c"]
    assert texts("<table><tr><td>a<svg>b</td><td>c</table>") == ["a", "c"]


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<div class='a b'>x" * 50_000, '<a x="' * 100_000, '<a x="\'>' * 100_000, "<p><b>t" * 50_000, "<svg><p>x" * 50_000, "<b><i>x</b>" * 50_000, "<script>" * 50_000], ids=range(8))
def test_deep_and_broken_pages_take_linear_time(page):
    began = time.time()
    blocks = pages.blocks_of(page)
    v = pages.vectors([blocks])
    pages.path_means(np.ones((pages.PATH_BUCKETS, 2)), v)
    assert time.time() - began < 15 and len(v["own_n"]) <= 100_001


def test_main_text_of_pages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    net = pages.train(rows)
    more = spark.createDataFrame([(1, "u", PAGE, "t"), (None, None, None, None), (2, "u", "", None), (2, "u", "", None), (3, "u", "<p unclosed 'x", None)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in pages.extract(more, net).collect()}
    assert got[1].text == "A & B\n\nFirst part goes on éé.\n\nSecond bold part, and more words in it.\n\nThird part of the text is here, with a few words."
    assert got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[None].text == "" and pages.extract(more, net).count() == 5
    assert {r.page_id: r.text for r in pages.extract(rows, net).collect()} == {r.page_id: article_of(r.html) for r in rows.collect()}
    with pytest.raises(ValueError):
        pages.extract(more, net, keep=("page_id", "text"))
    assert pages.extract(rows.where("false"), net).count() == 0


def test_labeller_on_unseen_layouts():
    words = [f"w{i}" for i in range(500)]
    net = pages.fit(pages.drawn(300, words))
    test = pages.drawn(100, words, seed=99)
    pairs = [(bool(y), z) for (b, labels), found in zip(test, net.label([b for b, _ in test])) for y, z in zip(labels, found)]
    assert np.mean([a == b for a, b in pairs]) > 0.98


def test_labeller_sees_the_whole_path_of_a_block(monkeypatch):
    """The container that tells comments from the article stands more than 40 words above its blocks."""
    inner = "".join(f'<div class="wrap outer inner level{i}">' for i in range(15))
    text = "plain words that could stand anywhere on a page, and more of them in a row."
    found = [pages.blocks_of(f'<body><{tag}>{inner}<p>{text}</p>{"</div>" * 15}</{tag}></body>')[0] for tag in ("article", "footer")]
    assert len(found[0].path) > 60 and found[0].path[-40:] == found[1].path[-40:]
    assert [pages.marked([b]) for b in found] == [[1], [0]]
    v = pages.vectors([[b] for b in found])
    assert v["path_n"].tolist() == [len(b.path) for b in found]
    table = np.random.default_rng(7).normal(size=(pages.PATH_BUCKETS, 3))
    whole = pages.path_means(table, v)
    for b, got in zip(found, whole):
        assert np.allclose(got, np.mean([table[pages.zlib.crc32(w.encode()) % pages.PATH_BUCKETS] for w in b.path], 0), atol=1e-6)
    monkeypatch.setattr(pages, "TOGETHER", 2)
    assert np.allclose(pages.path_means(table, v), whole)
    d = np.random.default_rng(8).normal(size=whole.shape)  # the gradient is the transpose of the means
    assert np.isclose((pages.path_gradient(v, d) * table).sum(), (whole * d).sum(), rtol=1e-4)
    net = pages.fit([([b], pages.marked([b])) for b in found], steps=240, batch=8)
    assert [bool(x[0]) for x in net.label([[b] for b in found])] == [True, False]


def test_every_language_is_learned(spark):
    """Seventy values sort before the last one."""
    names = [f"a{i:02}" for i in range(70)] + ["zz"]
    docs = spark.createDataFrame([(100 * k + i, f"text {i} in language {name}", name) for k, name in enumerate(names) for i in range(3)], "doc_id long, text string, lang string")
    rows = langid.sample(docs, F.lit(True), "doc_id", "text", "lang", 2)
    assert sorted(r.lang for r in rows) == sorted(names * 2)
    assert langid.fit([r.text for r in rows], [r.lang for r in rows], steps=1).languages == names


def test_top_k_keeps_large_finite_vectors(spark):
    big = float(1 << 41)
    rows = [(0, [1.0, 2.0]), (1, [big, -1.0]), (2, [3.0, big * 4]), (3, [-big * 1024, 0.5]), (4, [0.25, 0.5]), (5, [float("inf"), 0.0]), (6, [float("nan"), 0.0]), (7, [2.0, 2.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = {0, 4, 7}
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows if all(map(math.isfinite, v))}
    want = []
    for q in asked:
        best = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:4]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    got = topk.top_k(docs, F.col("vec_id").isin(*asked), k=4)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    for wide in ([1e300, 1.0], [float(1 << 55), 1.0]):
        with pytest.raises(Exception, match="does not fit a long"):
            topk.top_k(spark.createDataFrame([(0, wide), (1, [1.0, 1.0])], "vec_id long, embedding array<double>"), F.lit(True)).collect()
    huge = spark.createDataFrame([(0, [big * 4096, 1.0]), (1, [big * 4096, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="[Ii]nt too|[Oo]verflow|too large"):
        topk.top_k(huge, F.lit(True)).collect()
