"""Language labels by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows that cover all of it.  Two recurrent
layers read a window in both directions; together they give every byte a
probability for each language, and a text's probabilities are the mean over its
bytes.  The network is trained in numpy by backpropagation through time on a
bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselark.llm import nets
from tesselark.llm import text as tx
from tesselark.llm.shared import bounded_text

UNDETERMINED = "und"
#: Bytes in a window, windows that are read in step, and states a direction has.
WINDOW, TOGETHER, HIDDEN = 96, 1024, 8
#: Bounds of the sample: texts of each language, windows of each text.
TEXTS_EACH, WINDOWS_EACH = 400, 12
#: Chosen ids that are sent to every task, at most; more are looked up by a shuffle.
BROADCAST_IDS = 100_000


def windows_of(data: np.ndarray, ends: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text index) of windows that cover each text without overlap."""
    length = np.diff(ends)
    count = -(-length // size)
    owner = np.repeat(np.arange(len(length)), count)
    first = np.cumsum(count) - count
    start = (np.arange(len(owner)) - first[owner]) * size
    return ends[owner] + start, np.minimum(size, length[owner] - start), owner


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (step, window) with 0 beyond a window's end, and their mask."""
    step = np.arange(size)[:, None]
    mask = step < length
    return np.where(mask, data[np.minimum(start + step, len(data) - 1)], 0), mask


class ByteGru:
    """Parameters: byte tables of both directions, recurrent weights and the output layer."""

    def __init__(self, languages: list[str], params: dict[str, np.ndarray]):
        self.languages, self.p = languages, params

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 5) -> ByteGru:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p[d + "x"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(nets.F32)
            p[d + "u"] = rng.normal(0, 0.3, (hidden, 3 * hidden)).astype(nets.F32)
            p[d + "o"] = rng.normal(0, 0.3, (hidden, len(languages))).astype(nets.F32)
        p["o"] = np.zeros(len(languages), nets.F32)
        return cls(languages, p)

    def _states(self, x: np.ndarray, keep: bool = False) -> dict:
        return {d: nets.gru_forward(self.p[d + "x"][y], self.p[d + "u"], keep) for d, y in (("f", x), ("b", x[::-1]))}

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (step, window, language) at every byte.

        The same sums as in training, with the halves of the sigmoids' arguments
        folded into the weights and a step's arrays small enough for the cache.
        """
        steps, rows = x.shape
        out = np.empty((steps, rows, len(self.languages)), nets.F32)
        for d in "fb":
            h = self.p[d + "u"].shape[0]
            cut = [np.ascontiguousarray(self.p[d + w][:, k * h : (k + 1) * h] * f) for w in "xu" for k, f in ((0, nets.F32(0.5)), (1, nets.F32(0.5)), (2, nets.F32(1)))]
            (xz, xr, xc, uz, ur, uc), o = cut, self.p[d + "o"]
            s, z, r, c, w = np.zeros((rows, h), nets.F32), *(np.empty((rows, h), nets.F32) for _ in range(4))
            for t in range(steps) if d == "f" else reversed(range(steps)):
                for gate, table, u in ((z, xz, uz), (r, xr, ur)):
                    np.take(table, x[t], 0, out=gate, mode="clip")
                    gate += np.matmul(s, u, out=w)
                    np.tanh(gate, out=gate)
                    gate += 1
                    gate *= 0.5
                np.take(xc, x[t], 0, out=c, mode="clip")
                r *= np.matmul(s, uc, out=w)
                c += r
                np.tanh(c, out=c)
                s -= c
                s *= z
                s += c
                if d == "f":
                    np.matmul(s, o, out=out[t])
                else:
                    out[t] += s @ o
        out += self.p["o"]
        # logits are bounded by the tanh states, so exp() needs no shift
        np.exp(out, out=out)
        out /= out.sum(-1, keepdims=True)
        return out

    def learn(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, optimiser: nets.Adam, scale: float) -> float:
        s = self._states(x, True)
        f, b = s["f"][0][1:], s["b"][0][1:]
        prob = nets.softmax(f @ self.p["fo"] + (b @ self.p["bo"])[::-1] + self.p["o"])
        weight = (mask / max(1, mask.sum()))[:, :, None].astype(nets.F32)
        rows = np.arange(len(y))
        loss = -float((np.log(prob[:, rows, y] + 1e-9) * weight[:, :, 0]).sum())
        d = prob.copy()
        d[:, rows, y] -= 1
        d *= weight
        g = {"o": d.sum((0, 1)), "fo": np.einsum("tbh,tbc->hc", f, d), "bo": np.einsum("tbh,tbc->hc", b, d[::-1])}
        for k, state, dd, xs in (("f", s["f"], d, x), ("b", s["b"], d[::-1], x[::-1])):
            d_in, g[k + "u"] = nets.gru_backward(dd @ self.p[k + "o"].T, state[0], state[1], self.p[k + "u"])
            flat, at = d_in.reshape(-1, d_in.shape[2]), xs.ravel()
            order = np.argsort(at, kind="stable")
            bounds = np.searchsorted(at[order], np.arange(257))
            sums = np.concatenate([np.zeros((1, flat.shape[1])), np.cumsum(flat[order], 0, dtype=np.float64)])
            g[k + "x"] = (sums[bounds[1:]] - sums[bounds[:-1]]).astype(nets.F32)
        optimiser.step(g, scale)
        return loss

    def texts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pooled probabilities (text, language); zeros for a text without bytes.

        A short window is filled up to WINDOW as in training, whatever other
        windows are read with it, so a text's result hangs on the text alone.
        """
        start, length, owner = windows_of(data, ends)
        total = np.zeros((len(ends) - 1, len(self.languages)))
        order = np.argsort(-length, kind="stable")  # short windows share batches, so few need a mask
        for i in range(0, len(order), TOGETHER):
            part = order[i : i + TOGETHER]
            x, mask = gather(data, start[part], length[part])
            prob = self.positions(x)
            if not mask[-1].all():
                prob *= mask[:, :, None]
            np.add.at(total, owner[part], prob.sum(0, dtype=np.float64))
        size = np.diff(ends)[:, None]
        return np.divide(total, size, out=total, where=size > 0)


def fit(texts: list[str], languages: list[str], seed: int = 5, steps: int = 160, batch: int = 160) -> ByteGru:
    """Trains on windows of whole texts (at most WINDOWS_EACH of one text, spread over it)."""
    names = sorted(set(languages))
    place = {n: i for i, n in enumerate(names)}
    net, rng = ByteGru.fresh(names), np.random.default_rng(seed)
    rows: list[tuple[bytes, int]] = []
    for t, lang in zip(texts, languages, strict=True):
        raw = t.encode()
        starts = range(0, len(raw), WINDOW)
        for at in (starts if len(starts) <= WINDOWS_EACH else sorted(rng.choice(len(starts), WINDOWS_EACH, False) * WINDOW)):
            rows.append((raw[at : at + WINDOW], place[lang]))
    if not rows:
        return net
    data = np.frombuffer(b"".join(r for r, _ in rows), np.uint8)
    length = np.array([len(r) for r, _ in rows])
    start, y = np.cumsum(length) - length, np.array([c for _, c in rows])
    by = [np.flatnonzero(y == c) for c in range(len(names))]
    optimiser = nets.Adam(net.p, 0.02)
    for step in range(steps):
        pick = np.concatenate([rng.choice(b, max(1, batch // len(names))) for b in by if len(b)])
        x, mask = gather(data, start[pick], length[pick])
        net.learn(x, mask, y[pick], optimiser, max(0.05, 1 - step / steps))
    return net


def sample(docs: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str, each: int = TEXTS_EACH) -> list:
    """At most ``each`` texts of each language, by a hash of their ids (a bounded sample).

    Every language takes part.  The ids are chosen without reading a text; the
    texts are then looked up.  Of rows that share an id the one with the least
    hash of text and language counts, so the sample does not depend on the
    order of rows.  A long text is told by pieces (:func:`bounded_text`).
    """
    ids = docs.where(usable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = ids.withColumn("rank", rank).where(F.col("rank") <= each).select("id").distinct().collect()
    if not chosen:
        return []
    named = docs.sparkSession.createDataFrame(chosen, f"id {dict(ids.dtypes)['id']}")
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.join(F.broadcast(named) if len(chosen) <= BROADCAST_IDS else named, "id")
    least = F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text", "lang"), "text", "lang")).alias("r")
    return rows.groupBy("id").agg(least).select(F.col("id").alias(id_col), bounded_text(F.col("r.text")).alias(text_col), F.col("r.lang").alias(lang_col)).orderBy(id_col).collect()


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", each: int = TEXTS_EACH) -> ByteGru:
    """A network fitted on a bounded sample of the rows that ``usable`` allows.  Without any, it knows no language."""
    rows = sample(docs, usable, id_col, text_col, lang_col, each)
    return fit([r[1] for r in rows], [r[2] for r in rows])


def label(docs: DataFrame, net: ByteGru, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of each whole text: id_col, lang_pred, score and positions (bytes labelled).

    lang_pred is ``und`` (score 0) when the text is null, empty or has no
    letter, or when the network knows no language.  Ties go to the language
    that sorts first.  A text is read whole, a few megabytes of windows at a
    time.  Null ids and repeated rows stay; an empty table gives no rows; other
    columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    sent = docs.sparkSession.sparkContext.broadcast((net.languages, net.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = ByteGru(*sent.value)
        for batch in batches:
            texts = tx.texts_of(batch.column(1))
            letters = np.asarray(batch.column(2).to_pylist(), bool)
            for i, j in tx.steps(texts):
                data, ends = tx.bytes_of(texts.slice(i, j - i))
                known = letters[i:j] & bool(net.languages)
                prob = net.texts(data, ends) if net.languages else np.zeros((j - i, 1))
                top = prob.argmax(1)
                names = [net.languages[k] if ok else UNDETERMINED for k, ok in zip(top, known, strict=True)]
                score = np.where(known, np.clip(prob[np.arange(j - i), top], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(score), pa.array(np.diff(ends))], ["id", "lang_pred", "score", "positions"])

    return own.mapInArrow(run, f"id {dict(own.dtypes)['id']}, lang_pred string, score double, positions long").withColumnRenamed("id", id_col)
