"""Toxicity scores by gradient-boosted trees over dense features of whole texts.

Words and word beginnings whose share among toxic training texts stands out
form a weighted lexicon.  The features are densities of lexicon hits, their
nearness to second-person words, and rates of capitals, punctuation and
obfuscated words.  Boosted trees score the features; isotonic regression on
out-of-fold scores turns them into probabilities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselark.llm import text as tx
from tesselark.llm.quality import labelled

#: Bound of the sample: texts of each label.
TEXTS_EACH = 900
THRESHOLD = 0.3
#: Lengths in bytes of word beginnings, next to whole words.
BEGINNINGS = (5, 6, 7)
#: Lexicon: least number of toxic texts, least log odds, most entries.
LEAST_TEXTS, LEAST_ODDS, ENTRIES = 4, 1.6, 600
#: Second-person words in the languages at hand (fixed values).
SECOND_PERSON = ("you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "ihr", "euch", "sie", "tu", "te", "toi", "ton", "vous", "votre", "usted", "ustedes", "vos", "ti", "su")
NEAR = 5
FEATURES = ("word_density", "word_kinds", "word_weight", "begin_density", "begin_kinds", "begin_weight", "mean_weight", "second_person", "near_second_person", "capitals", "capital_words", "exclamations", "questions", "punctuation", "symbols", "obfuscated", "repeated", "words")


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, stops, text) of runs of letters (any byte from 0x80 on counts as one)."""
    low = tx.lowered(data)
    return low, *tx.runs(((low >= 97) & (low <= 122)) | (low >= 128), ends)


def term_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of every word, and of its beginnings (0 where the word is not longer); the words' texts; word sizes."""
    low, starts, stops, owner = _words(data, ends)
    out = [tx.span_hashes(low, starts, stops)]
    for n in BEGINNINGS:
        h = tx.span_hashes(low, starts, np.minimum(starts + n, stops)) ^ np.uint64(n)
        out.append(np.where(stops - starts > n, h, 0))
    return out, owner, stops - starts


def learn_lexicon(data: np.ndarray, ends: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, weights) of the terms that mark label 1."""
    terms, owner, _ = term_hashes(data, ends)
    h, o = np.concatenate(terms), np.tile(owner, len(terms))
    pairs = np.unique(np.stack([h[h != 0], o[h != 0].astype(np.uint64)]), axis=1)
    kinds, at = np.unique(pairs[0], return_inverse=True)
    toxic = y[pairs[1].astype(np.int64)] == 1
    pos, neg = np.bincount(at, toxic, len(kinds)), np.bincount(at, ~toxic, len(kinds))
    odds = np.log((pos + 0.5) / (toxic_count := (y == 1).sum() + 1) / ((neg + 0.5) / (len(y) - toxic_count + 2)))
    good = np.flatnonzero((pos >= LEAST_TEXTS) & (odds >= LEAST_ODDS))
    good = np.sort(good[np.argsort(-(odds[good] * np.sqrt(pos[good])), kind="stable")[:ENTRIES]])
    return kinds[good], odds[good]


def features(data: np.ndarray, ends: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(text, feature) in the order of FEATURES."""
    n = len(ends) - 1
    kinds, weights = lexicon
    terms, owner, size = term_hashes(data, ends)
    words = np.bincount(owner, minlength=n)
    per = 100 / np.maximum(words, 1)
    out = np.zeros((n, len(FEATURES)))
    hit_any = np.zeros(len(owner), bool)
    total = np.zeros(n)
    for k, hashes in enumerate((terms[0], np.concatenate(terms[1:]))):
        who = np.tile(owner, len(hashes) // max(1, len(owner))) if len(owner) else owner
        at = np.searchsorted(kinds, hashes)
        at[at == len(kinds)] = 0
        hit = np.flatnonzero(kinds[at] == hashes) if len(kinds) else np.zeros(0, np.int64)
        hit_any[hit % max(1, len(owner))] = True
        o, w = who[hit], weights[at[hit]] if len(kinds) else hit.astype(float)
        out[:, 3 * k] = np.bincount(o, minlength=n) * per
        if len(hit):
            pairs = np.unique(np.stack([o, at[hit]]), axis=1)
            out[:, 3 * k + 1] = np.bincount(pairs[0], minlength=n)
            np.maximum.at(out[:, 3 * k + 2], o, w)
            total += np.bincount(pairs[0], weights[pairs[1]], n)
    out[:, 6] = total / np.log(words + 3)
    second = np.isin(terms[0], np.array([tx.word_hash(w) for w in SECOND_PERSON], np.uint64))
    out[:, 7] = np.bincount(owner, second, n) * per
    at_second, at_hit = np.flatnonzero(second), np.flatnonzero(hit_any)
    if len(at_second) and len(at_hit):
        i = np.searchsorted(at_second, at_hit)
        for j in (i - 1, i):  # the second-person word before, and the one from here on
            there = (j >= 0) & (j < len(at_second))
            j = np.where(there, j, 0)
            near = there & (np.abs(at_second[j] - at_hit) <= NEAR) & (owner[at_second[j]] == owner[at_hit])
            out[:, 8] += np.bincount(owner[at_hit], near, n) * per
    size_of = np.maximum(np.diff(ends), 1)

    def rate(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return (sums[ends[1:]] - sums[ends[:-1]]) / size_of

    capital, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    letter = capital | ((data >= 97) & (data <= 122)) | (data >= 128)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    symbol = ~(letter | digit | space)
    out[:, 9], out[:, 11], out[:, 12] = rate(capital), rate(data == 33), rate(data == 63)
    out[:, 13], out[:, 14] = rate(symbol), rate(np.isin(data, np.frombuffer(b"@#$%*&_~|", np.uint8)))
    starts, stops, who = tx.words_of(data, ends)
    if len(starts):
        sums = [np.concatenate([[0], np.cumsum(f)]) for f in (letter, capital, digit | symbol)]
        letters, capitals = sums[0][stops] - sums[0][starts], sums[1][stops] - sums[1][starts]
        inner = np.maximum(stops - 1, starts + 1)
        masked = sums[2][inner] - sums[2][np.minimum(starts + 1, inner)]
        tokens = np.maximum(np.bincount(who, minlength=n), 1)
        out[:, 10] = np.bincount(who, (letters >= 3) & (letters == capitals), n) / tokens
        out[:, 15] = np.bincount(who, (letters >= 2) & (masked > 0) & (masked <= 3) & (letters > masked), n) / tokens
        same = np.zeros(len(data), bool)
        same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & letter[2:]
        for k in (0, 1):  # a run of three lies in one text
            same[np.minimum(ends[:-1] + k, len(data) - 1)] = False
        out[:, 16] = rate(same)
    out[:, 17] = np.log1p(words)
    return out


class Trees:
    """Boosted regression trees of one depth on the logistic loss; splits between quantiles."""

    def __init__(self, base: float, rate: float, trees: list):
        self.base, self.rate, self.trees = base, rate, trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, count: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32) -> Trees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)  # bin k holds x <= edges[k]
        p = np.clip(y.mean(), 0.01, 0.99)
        model = cls(float(np.log(p / (1 - p))), rate, [])
        raw = np.full(len(y), model.base)
        width = bins + 1
        for _ in range(count):
            prob = 1 / (1 + np.exp(-raw))
            g, h = prob - y, prob * (1 - prob)
            node = np.zeros(len(y), np.int64)
            tree = []
            for level in range(depth):
                nodes = 1 << level
                best = np.full(nodes, 1e-6)
                choice = np.zeros((nodes, 2), np.int64)
                choice[:, 1] = width  # no split: all go left
                for f in range(x.shape[1]):
                    key = node * width + binned[:, f]
                    gs, hs = (np.bincount(key, v, nodes * width).reshape(nodes, width) for v in (g, h))
                    gl, hl = np.cumsum(gs, 1), np.cumsum(hs, 1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < 1) | (ht - hl < 1)] = 0
                    at = gain.argmax(1)
                    better = gain[np.arange(nodes), at] > best
                    best = np.where(better, gain[np.arange(nodes), at], best)
                    choice[better] = np.stack([np.full(nodes, f), at], 1)[better]
                cut = np.array([edges[f][b] if b < len(edges[f]) else np.inf for f, b in choice])
                node = node * 2 + (x[np.arange(len(y)), choice[node, 0]] > cut[node])
                tree.append((choice[:, 0].copy(), cut))
            size = 1 << depth
            leaf = -np.bincount(node, g, size) / (np.bincount(node, h, size) + 1)
            model.trees.append((tree, leaf))
            raw += rate * leaf[node]
        return model

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for tree, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for f, cut in tree:
                node = node * 2 + (x[rows, f[node]] > cut[node])
            out += self.rate * leaf[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (raw score, probability) of each pool, rising."""
    pools: list[list[float]] = []
    for r, t, w in sorted(zip(raw.tolist(), y.tolist(), weight.tolist(), strict=True)):
        pools.append([r * w, t * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([a / w for a, _, w in pools]), np.array([b / w for _, b, w in pools])


class Model:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon: tuple, trees: Trees, curve: tuple[np.ndarray, np.ndarray]):
        self.lexicon, self.trees, self.curve = lexicon, trees, curve

    def score(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(features(data, ends, self.lexicon))
        # the pools' probabilities, and a hundredth of the plain logistic value to order what shares a pool
        return 0.99 * np.interp(raw, *self.curve) + 0.01 / (1 + np.exp(-raw))


def fit(texts: list[str], labels: list[int], shares: tuple[float, float] | None = None, folds: int = 3) -> Model:
    """Lexicons and trees by cross-fitting: what scores a text in training has not seen its label.

    ``shares`` are the weights of a text of label 0 and 1, where the sample is
    richer in one of them than the corpus.
    """
    y = np.array(labels)
    none = (np.zeros(0, np.uint64), np.zeros(0))
    if len(set(labels)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model(none, Trees(0.0, 0.0, []), (np.array([0.0]), np.array([share])))
    raw = [t.encode() for t in texts]

    def joined(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(raw[i] for i in rows), np.uint8), np.concatenate([[0], np.cumsum([len(raw[i]) for i in rows])])

    fold = np.zeros(len(y), np.int64)
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        fold[own] = np.arange(len(own)) % folds
    x = np.zeros((len(y), len(FEATURES)))
    for k in range(folds):
        inside, outside = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        x[inside] = features(*joined(inside), learn_lexicon(*joined(outside), y[outside]))
    out_of_fold = np.zeros(len(y))
    for k in range(folds):
        inside = fold == k
        out_of_fold[inside] = Trees.fit(x[~inside], y[~inside]).raw(x[inside])
    weight = np.where(y == 1, *((shares or (1.0, 1.0))[::-1]))
    everything = np.arange(len(y))
    return Model(learn_lexicon(*joined(everything), y), Trees.fit(x, y), isotonic(out_of_fold, y, weight))


def train(docs: DataFrame, labels: DataFrame, usable: Column, each: int = TEXTS_EACH, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Model:
    """A model fitted on a bounded sample of the labelled rows that ``usable`` allows.

    The labels' true shares, counted over all usable labels, weigh the calibration.
    """
    rows = labelled(docs, labels, usable, label, each, id_col, text_col)
    counts = Counter({r[0]: r[1] for r in labels.where(usable & F.col(label).isin(0, 1)).groupBy(label).count().collect()})
    mine = Counter(r[2] for r in rows)
    return fit([r[1] for r in rows], [r[2] for r in rows], tuple(counts[c] / max(1, mine[c]) for c in (0, 1)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, score (0 to 1) and predicted (1 from ``threshold`` on) of each whole text.

    A null text counts as empty, and an empty one is scored like any other; a
    text is read whole, however long: a task holds its words' hashes.  Null ids
    and repeated rows stay; an empty table gives no rows; other columns are
    ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.trees.base, model.trees.rate, model.trees.trees, model.curve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, base, rate, trees, curve = sent.value
        model = Model(lexicon, Trees(base, rate, trees), curve)
        for batch in batches:
            texts = tx.texts_of(batch.column(1))
            for i, j in tx.steps(texts):
                s = np.clip(model.score(*tx.bytes_of(texts.slice(i, j - i))), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    return own.mapInArrow(run, f"id {dict(own.dtypes)['id']}, score double, predicted int").withColumnRenamed("id", id_col)
