"""Features, lexicon, trees, pooled filters and thumbnails against plain Python."""

import math
import random
import re

import numpy as np
import pytest

from tesselark.llm import media, quality, shared, toxicity
from tesselark.llm import text as tx

LETTERS = re.compile(rb"[A-Za-z\x80-\xff]+")
TOKENS = re.compile(rb"[^\x20\x09-\x0d]+")


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def term(word, n=0):
    """The hash of a word, or of its first n bytes where it is longer."""
    part = np.frombuffer(word[:n] if n else word, np.uint8)
    return int(tx.span_hashes(part, np.array([0]), np.array([len(part)]))[0]) ^ n


def terms_of(raw):
    """Per word its hash and those of its beginnings."""
    return [[term(w)] + [term(w, n) for n in toxicity.BEGINNINGS if len(w) > n] for w in map(bytes.lower, LETTERS.findall(raw))]


def plain_features(raw, lexicon):
    weight = dict(zip(*(a.tolist() for a in lexicon), strict=True))
    words = terms_of(raw)
    per = 100 / max(len(words), 1)
    out = dict.fromkeys(toxicity.FEATURES, 0.0)
    for name, terms in (("word", [(k, w[0]) for k, w in enumerate(words)]), ("begin", [(k, t) for k, w in enumerate(words) for t in w[1:]])):
        hits = [t for _, t in terms if t in weight]
        out[f"{name}_density"], out[f"{name}_kinds"] = len(hits) * per, len(set(hits))
        out[f"{name}_weight"] = max([weight[t] for t in hits], default=0.0)
        out["mean_weight"] += sum(weight[t] for t in set(hits))
    out["mean_weight"] /= math.log(len(words) + 3)
    second = [k for k, w in enumerate(words) if w[0] in {term(s.encode()) for s in toxicity.SECOND_PERSON}]
    hit = [k for k, w in enumerate(words) if any(t in weight for t in w)]
    out["second_person"] = len(second) * per
    for k in hit if second else []:
        after = sum(s < k for s in second)  # the nearest before and from the word on
        out["near_second_person"] += sum(abs(second[j] - k) <= toxicity.NEAR for j in (after - 1, after) if 0 <= j < len(second)) * per
    n = max(len(raw), 1)
    letter, capital = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128, lambda c: 65 <= c <= 90
    symbol = lambda c: not (letter(c) or 48 <= c <= 57 or c == 32 or 9 <= c <= 13)
    out["capitals"], out["exclamations"], out["questions"] = sum(map(capital, raw)) / n, raw.count(b"!") / n, raw.count(b"?") / n
    out["punctuation"], out["symbols"] = sum(map(symbol, raw)) / n, sum(c in b"@#$%*&_~|" for c in raw) / n
    tokens = TOKENS.findall(raw)
    for t in tokens:
        letters = sum(map(letter, t))
        masked = sum(symbol(c) or 48 <= c <= 57 for c in t[1:-1])
        out["capital_words"] += (letters >= 3 and letters == sum(map(capital, t))) / len(tokens)
        out["obfuscated"] += (letters >= 2 and 0 < masked <= 3 and letters > masked) / len(tokens)
    out["repeated"] = sum(raw[i] == raw[i - 1] == raw[i - 2] and letter(raw[i]) for i in range(2, len(raw))) / n
    out["words"] = math.log1p(len(words))
    return [out[f] for f in toxicity.FEATURES]


def made_texts(count, seed):
    rng = random.Random(seed)
    words = ["you", "YOUR", "idiot", "stupid", "house", "vous", "tu", "sie", "été", "i.d", "st*pid", "b4d!", "soooo", "AAA", "?!", "x", "#@", "nächste", "trees", "Hello,"]
    return ["", "   \n", "a", "?!"] + [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(count)]


def test_features_text_by_text():
    texts = made_texts(60, 1)
    kinds = sorted([term(b"idiot"), term(b"stupid"), term(b"stupid", toxicity.BEGINNINGS[0]), term(b"hello")])
    for lexicon in ((np.array(kinds, np.uint64), np.array([0.5, 1.5, 2.0, 0.7])), (np.zeros(0, np.uint64), np.zeros(0))):
        got = toxicity.features(*packed(texts), lexicon)
        want = [plain_features(t.encode(), lexicon) for t in texts]
        for t, g, w in zip(texts, got.tolist(), want, strict=True):
            for name, a, b in zip(toxicity.FEATURES, g, w, strict=True):
                assert a == pytest.approx(b, abs=1e-12), (t, name)


def test_lexicon_term_by_term():
    texts, rng = made_texts(80, 2), random.Random(3)
    y = np.array([int("idiot" in t or rng.random() < 0.2) for t in texts])
    counts = {}
    for t, label in zip(texts, y.tolist(), strict=True):
        for h in {h for w in terms_of(t.encode()) for h in w}:
            counts.setdefault(h, [0, 0])[label] += 1
    toxic = int(y.sum())
    odds = {h: math.log(((pos + 0.5) / (toxic + 1)) / ((neg + 0.5) / (len(y) - toxic + 1))) for h, (neg, pos) in counts.items()}
    good = [h for h in odds if counts[h][1] >= toxicity.LEAST_TEXTS and odds[h] >= toxicity.LEAST_ODDS]
    got = dict(zip(*(a.tolist() for a in toxicity.learn_lexicon(*packed(texts), y)), strict=True))
    assert len(good) <= toxicity.ENTRIES and set(got) == set(good) and len(got) > 0
    assert all(got[h] == pytest.approx(odds[h]) for h in got)


def test_trees_row_by_row():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)).round(1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] * x[:, 1] > 0.5)).astype(float)
    model = toxicity.Trees.fit(x, y, count=12)
    for row, got in zip(x[:60], model.raw(x[:60]).tolist(), strict=True):
        want = model.base
        for tree, leaf in model.trees:
            node = 0
            for f, cut in tree:
                node = 2 * node + (1 if row[f[node]] > cut[node] else 0)
            want += model.rate * leaf[node]
        assert got == pytest.approx(want)
    assert ((model.raw(x) > 0) == (y > 0)).mean() > 0.9
    # the first tree's leaves are the Newton steps of the rows that fall into them
    p = np.clip(y.mean(), 0.01, 0.99)
    tree, leaf = model.trees[0]
    place = []
    for row in x:
        node = 0
        for f, cut in tree:
            node = 2 * node + int(row[f[node]] > cut[node])
        place.append(node)
    for node in range(len(leaf)):
        own = [t for t, k in zip(y, place, strict=True) if k == node]
        assert leaf[node] == pytest.approx(-(sum(p - t for t in own)) / (len(own) * p * (1 - p) + 1))


def test_isotonic_curve_is_the_best_rising_one():
    rng = np.random.default_rng(6)
    raw, w = np.arange(9.0), rng.uniform(0.5, 2, 9)
    y = rng.integers(0, 2, 9).astype(float)
    at, value = toxicity.isotonic(raw, y, w)
    assert (np.diff(at) > 0).all() and (np.diff(value) > 0).all()
    best = math.inf
    for cuts in range(1 << 8):  # the best rising steps of any split into runs
        runs, start = [], 0
        for i in range(9):
            if i == 8 or cuts >> i & 1:
                runs.append((start, i + 1))
                start = i + 1
        means = [np.average(y[a:b], weights=w[a:b]) for a, b in runs]
        if all(a <= b for a, b in zip(means, means[1:], strict=False)):
            best = min(best, sum((w[a:b] * (y[a:b] - m) ** 2).sum() for (a, b), m in zip(runs, means, strict=True)))
    pools, start = [], 0
    for m in at:  # pools by their weighted means
        end = next(e for e in range(start + 1, 10) if np.average(raw[start:e], weights=w[start:e]) == pytest.approx(m))
        pools.append((start, end))
        start = end
    assert sum((w[a:b] * (y[a:b] - v) ** 2).sum() for (a, b), v in zip(pools, value, strict=True)) == pytest.approx(best)


def test_quality_scores_text_by_text():
    net = quality.ByteConv.fresh(9)
    rng = np.random.default_rng(1)
    net.p["b"] = rng.normal(0, 0.1, quality.FILTERS).astype(np.float32)
    texts = ["", "a", "short text", "word " * 300, "é" * 700, "mixed 123 !? " * 200]
    got = net.score(*packed(texts))
    for t, score in zip(texts, got.tolist(), strict=True):
        raw = t.encode()
        start, length, _ = quality.chunks_of(np.array([0, len(raw)]))
        assert not raw or (start[0] == 0 and max(s + n for s, n in zip(start, length, strict=True)) == len(raw))
        chunks = []
        for s, n in zip(start.tolist(), length.tolist(), strict=True):
            part = raw[s : s + n] + bytes(max(0, quality.WIDTH - n))
            best = np.full(quality.FILTERS, -np.inf)
            for i in range(len(part) - quality.WIDTH + 1):
                best = np.maximum(best, sum(net.p["e"][part[i + k]].astype(float) @ net.p["w"][k] for k in range(quality.WIDTH)))
            chunks.append(np.maximum(best + net.p["b"], 0))
        f = np.concatenate([np.mean(chunks, 0), np.min(chunks, 0), np.max(chunks, 0), [math.log1p(len(raw)) / 8]])
        h = np.tanh(f @ net.p["h"] + net.p["hb"])
        assert score == pytest.approx(1 / (1 + math.exp(-(h @ net.p["o"] + net.p["ob"][0]))), abs=1e-5), t


def test_thumbnails_are_the_means_of_blocks():
    rng = np.random.default_rng(2)
    for size in (64, 640, 64 * 77):
        data = rng.integers(0, 256, size).astype(np.uint8).tobytes()
        parsed, coefficients = media.decode(media.encode([data]))[0]
        image = media.thumbnail(parsed, coefficients)
        assert image.shape == (parsed.rows, parsed.columns) and parsed.rows * 8 == parsed.height and parsed.columns * 8 == parsed.width
        step = int(parsed.quantisers[parsed.quantiser][0])
        cells = [[min(max(round(float(coefficients[r * parsed.columns + c][0]) * step / 8 + 128), 0), 255) for c in range(parsed.columns)] for r in range(parsed.rows)]
        assert (image == cells).all()
        bits = "".join(str(int(cells[k * parsed.rows // 8][j * parsed.columns // 9] > cells[k * parsed.rows // 8][(j + 1) * parsed.columns // 9])) for k in range(8) for j in range(8))
        assert media.thumbnail_hash(image) == f"{int(bits, 2):016x}"


def test_long_texts_are_told_by_pieces_of_all_of_them(spark):
    long = "".join(chr(97 + (i // 1000) % 26) for i in range(100_000)) + "END"
    texts = [None, "", "short", "x" * shared.TEXT_CHARS, long]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(shared.bounded_text(shared.F.col("t")).alias("t")).collect()]
    assert got[:4] == texts[:4]
    assert len(got[4]) == shared.TEXT_CHARS + shared.TEXT_PIECES - 1 and got[4].startswith(long[:2048]) and got[4].endswith(long[-2048:])
    assert all(p in long for p in got[4].split(" "))
