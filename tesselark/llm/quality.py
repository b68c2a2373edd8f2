"""Quality scores by a byte-level convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.
Learned filters run over every position of a chunk and are max-pooled, so a
chunk becomes one activation per filter: what occurs in it, and what doesn't.
The mean, least and greatest activation over a text's chunks, and the text's
length, give one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselark.llm import nets
from tesselark.llm import text as tx
from tesselark.llm.shared import bounded_text

#: Bytes in a chunk and between chunk starts; filter width, filters, byte vector size.
CHUNK, STRIDE, WIDTH, FILTERS, BYTE_DIM = 512, 448, 5, 24, 8
#: Bounds of the sample: texts of each label, and chunks of each text.
TEXTS_EACH, CHUNKS_EACH = 700, 4
THRESHOLD = 0.3


def chunks_of(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text index) of the chunks; an empty text has one empty chunk."""
    length = np.diff(ends)
    count = np.maximum(1, -(-(length - (CHUNK - STRIDE)) // STRIDE))
    owner = np.repeat(np.arange(len(length)), count)
    start = (np.arange(len(owner)) - (np.cumsum(count) - count)[owner]) * STRIDE
    return ends[owner] + start, np.minimum(CHUNK, length[owner] - start), owner


class ByteConv:
    """Filters over bytes and a small output layer."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, seed: int = 3) -> ByteConv:
        rng = np.random.default_rng(seed)
        return cls({
            "e": rng.normal(0, 0.5, (256, BYTE_DIM)).astype(nets.F32),
            "w": rng.normal(0, (WIDTH * BYTE_DIM) ** -0.5, (WIDTH, BYTE_DIM, FILTERS)).astype(nets.F32),
            "b": np.zeros(FILTERS, nets.F32),
            "h": rng.normal(0, (3 * FILTERS) ** -0.5, (3 * FILTERS + 1, 16)).astype(nets.F32),
            "hb": np.zeros(16, nets.F32),
            "o": rng.normal(0, 0.25, 16).astype(nets.F32),
            "ob": np.zeros(1, nets.F32),
        })

    def pooled(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(greatest activation, its position) of each filter in each chunk.

        Chunks shorter than the filter are padded with bytes 0.
        """
        out, where = np.empty((len(start), FILTERS), nets.F32), np.empty((len(start), FILTERS), np.int64)
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            size = max(int(n), WIDTH)
            for i in range(0, len(rows), 32):
                part = rows[i : i + 32]
                x = np.zeros((len(part), size), np.uint8)
                if n:
                    x[:, :n] = data[start[part][:, None] + np.arange(n)]
                a = self._filtered(x)
                at = a.argmax(1)
                where[part] = at
                out[part] = np.take_along_axis(a, at[:, None], 1)[:, 0]
        return out, where

    def _filtered(self, x: np.ndarray) -> np.ndarray:
        v = self.p["e"][x]
        n = x.shape[1] - WIDTH + 1
        a = v[:, :n] @ self.p["w"][0]
        for k in range(1, WIDTH):
            a += v[:, k : k + n] @ self.p["w"][k]
        return a

    def activations(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Greatest activation of each filter in each chunk, filter by filter in cache-sized pieces."""
        out = np.empty((len(start), FILTERS), nets.F32)
        full = np.flatnonzero(length == CHUNK)
        n = CHUNK - WIDTH + 1
        tables = [np.ascontiguousarray(self.p["e"] @ w) for w in self.p["w"]]
        pairs = np.concatenate(self.p["w"])  # one product over a window's byte vectors
        for i in range(0, len(full), 8):
            part = full[i : i + 8]
            v = self.p["e"][data[start[part][:, None] + np.arange(CHUNK)]]
            wide = np.lib.stride_tricks.as_strided(v, (len(part), n, WIDTH * BYTE_DIM), (v.strides[0], v.strides[1], 4))
            for k, row in enumerate(part):
                np.matmul(wide[k], pairs).max(0, out=out[row])
        for row in np.flatnonzero(length != CHUNK):
            x = np.zeros(max(int(length[row]), WIDTH), np.uint8)
            x[: length[row]] = data[start[row] : start[row] + length[row]]
            m = len(x) - WIDTH + 1
            a = tables[0][x[:m]]
            for k in range(1, WIDTH):
                a += tables[k][x[k : k + m]]
            out[row] = a.max(0)
        return out

    def head(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(features @ self.p["h"] + self.p["hb"])
        return nets.sigmoid(h @ self.p["o"] + self.p["ob"]), h

    def score(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        start, length, owner = chunks_of(ends)
        a = np.maximum(self.activations(data, start, length) + self.p["b"], 0)
        return self.head(summary(a, owner, np.diff(ends))[0])[0].astype(np.float64)


def summary(a: np.ndarray, owner: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean, least and greatest chunk activation of each text, and the log of its length."""
    first = np.searchsorted(owner, np.arange(len(size)))
    count = np.diff(np.append(first, len(owner)))
    mean = np.add.reduceat(a, first, 0) / count[:, None]
    out = np.concatenate([mean, np.minimum.reduceat(a, first, 0), np.maximum.reduceat(a, first, 0), np.log1p(size)[:, None] / 8], 1)
    return out.astype(nets.F32), count


def fit(texts: list[str], labels: list[int], seed: int = 3, steps: int = 220, batch: int = 48) -> ByteConv:
    """Trains filters and output together; a step sees at most CHUNKS_EACH chunks of a text, drawn from all of it."""
    net, rng = ByteConv.fresh(seed), np.random.default_rng(seed)
    y = np.array(labels, nets.F32)
    by = [np.flatnonzero(y == c) for c in (0, 1)]
    if not all(map(len, by)):  # only one label is known: its share is the score
        net.p["o"][:] = 0
        net.p["ob"][:] = 4 if len(by[1]) else (-4 if len(by[0]) else 0)
        return net
    raw = [t.encode() for t in texts]
    optimiser = nets.Adam(net.p, 0.01)
    for step in range(steps):
        pick = np.concatenate([rng.choice(b, batch // 2) for b in by])
        data = np.frombuffer(b"".join(raw[i] for i in pick) + b"\0", np.uint8)
        ends = np.concatenate([[0], np.cumsum([len(raw[i]) for i in pick])])
        start, length, owner = chunks_of(ends)
        keep = np.sort(np.concatenate([rng.choice(own, CHUNKS_EACH, False) if len(own) > CHUNKS_EACH else own for own in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1)]))
        start, length, owner = start[keep], length[keep], owner[keep]
        raw_a, where = net.pooled(data, start, length)
        a = np.maximum(raw_a + net.p["b"], 0)
        f, count = summary(a, owner, np.diff(ends))
        prob, h = net.head(f)
        d = (prob - y[pick]) / len(pick)
        g = {"o": h.T @ d, "ob": d.sum(keepdims=True)}
        dh = d[:, None] * net.p["o"] * (1 - h * h)
        g["h"], g["hb"] = f.T @ dh, dh.sum(0)
        df = dh @ net.p["h"].T
        n = FILTERS
        da = (df[:, :n] / count[:, None])[owner]
        da += df[:, n : 2 * n][owner] * (a == f[owner, n : 2 * n]) + df[:, 2 * n : 3 * n][owner] * (a == f[owner, 2 * n : 3 * n])
        da *= a > 0
        g["b"] = da.sum(0)
        g["w"], g["e"] = np.zeros_like(net.p["w"]), np.zeros_like(net.p["e"])
        for k in range(WIDTH):
            at = start[:, None] + where + k
            x = np.where(where + k < length[:, None], data[np.minimum(at, len(data) - 1)], 0)
            v = net.p["e"][x]  # chunk, filter, dim
            g["w"][k] = np.einsum("cfd,cf->df", v, da)
            np.add.at(g["e"], x, da[:, :, None] * net.p["w"][k].T[None])
        optimiser.step(g, max(0.05, 1 - step / steps))
    return net


def labelled(docs: DataFrame, labels: DataFrame, usable: Column, label: str, each: int, id_col: str = "doc_id", text_col: str = "text") -> list:
    """At most ``each`` texts of each label 0 and 1, by a hash of their ids (a bounded sample): (id, text, label).

    Of rows that share an id the one with the least hash of text and label
    counts, so the sample does not depend on the order of rows.  A long text is
    told by pieces (:func:`bounded_text`).
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label).cast("int").alias("y"))
    ids = docs.where(usable & F.col(id_col).isNotNull()).select(id_col).join(known, id_col).distinct()
    chosen: list = []
    for y in (0, 1):
        chosen += [r[0] for r in ids.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(each).collect()]
    if not chosen:
        return []
    texts = docs.where(F.col(id_col).isin(chosen) & usable & F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text"))
    named = known.where(F.col(id_col).isin(chosen)).distinct()  # at most two rows of an id: its labels are 0 and 1
    least = F.min_by(F.struct("text", "y"), F.struct(F.xxhash64("text", "y"), "text", "y")).alias("r")
    return texts.join(F.broadcast(named), id_col).groupBy(id_col).agg(least).select(id_col, bounded_text(F.col("r.text")).alias("text"), "r.y").orderBy(id_col).collect()


def train(docs: DataFrame, labels: DataFrame, usable: Column, each: int = TEXTS_EACH, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> ByteConv:
    """A network fitted on a bounded sample of the labelled rows that ``usable`` allows."""
    rows = labelled(docs, labels, usable, label, each, id_col, text_col)
    return fit([r[1] for r in rows], [r[2] for r in rows])


def score(docs: DataFrame, net: ByteConv, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, score (0 to 1) and predicted (1 from ``threshold`` on) of each whole text.

    A null text counts as empty, and an empty one is scored like any other; a
    text is read whole, however long.  Null ids and repeated rows stay; an empty
    table gives no rows; other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(net.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = ByteConv(sent.value)
        for batch in batches:
            texts = tx.texts_of(batch.column(1))
            for i, j in tx.steps(texts):
                s = net.score(*tx.bytes_of(texts.slice(i, j - i)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    return own.mapInArrow(run, f"id {dict(own.dtypes)['id']}, score double, predicted int").withColumnRenamed("id", id_col)
