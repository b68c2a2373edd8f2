"""Byte-level BPE by a sentencepiece model serialised straight from a rank file.

The model's pieces are the vocabulary's byte strings with each byte mapped to a
printable character, scored by negative rank, under identity normalisation.
Sentencepiece merges the adjacent pair with the best score, leftmost first: the
lowest rank first, as the rank file asks.  Pre-tokens are encoded one by one;
decoding is the inverse mapping.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.llm import text as tx

#: Distinct pre-tokens whose ids a worker remembers before it starts afresh, and bytes of them and their ids.
REMEMBERED, REMEMBERED_BYTES = 300_000, 64 << 20


def read_ranks(lines: bytes) -> list[bytes]:
    """The byte strings of a rank file ("base64 rank" lines), by rank from 0."""
    pairs = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, filter(None, lines.splitlines())))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return [t for _, t in pairs]


def byte_characters() -> list[str]:
    """A visible character for each byte: itself where Latin-1 prints it, else from U+0100 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
        return bytes(out)

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value & (1 << 64) - 1)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model_bytes(vocabulary: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model; piece i + 1 is the vocabulary's entry i, piece 0 the unknown."""
    to = byte_characters()
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, "".join(to[b] for b in t).encode()) + _field(2, float(-r)) + _field(3, 1) for r, t in enumerate(vocabulary)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encodes and decodes with one model; remembers the ids of recent pre-tokens."""

    def __init__(self, vocabulary: list[bytes], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.whole = {t: i for i, t in enumerate(vocabulary)}
        self.find = regex.compile(pattern).findall
        self.to = {b: c for b, c in enumerate(byte_characters())}
        self.known: dict[str, bytes] = {}
        self.held = 0
        sizes = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(vocabulary), np.uint8)

    def _learn(self, pieces: list[str]) -> None:
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.known.clear()
            self.held = 0
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        raw = [p.encode() for p in new]
        split = [i for i, r in enumerate(raw) if r not in self.whole]
        ids: list = [self.whole.get(r) for r in raw]
        mapped = [raw[i].decode("latin-1").translate(self.to) for i in split]
        for i, got in zip(split, self.model.encode(mapped, num_threads=1), strict=True):
            ids[i] = [x - 1 for x in got]
        for p, i in zip(new, ids, strict=True):
            self.known[p] = np.array(i, "<i4").tobytes()
            self.held += len(p) + len(self.known[p])

    def encode(self, text: str) -> np.ndarray:
        pieces = self.find(text)
        try:
            return np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), "<i4")
        except KeyError:
            self._learn(pieces)
            return np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), "<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ids) else 0)
        at += np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.bytes[at].tobytes()


def byte_bpe(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each whole text, and the bytes they decode to.

    ``vocabulary`` is the path of a rank file, read once here and sent to the
    tasks (its size does not depend on the data).  Each match of ``pattern`` is
    encoded by itself; characters outside every match are left out.  Returns
    id_col, ids array<int> and decoded binary.  A null text counts as empty: no
    ids, no bytes.  A text is encoded whole, however long.  Null ids and repeated
    rows stay; an empty table gives no rows; other columns are ignored.
    """
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast((ranks, model_bytes(read_ranks(ranks))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, model = sent.value
        bpe = ByteBpe(read_ranks(ranks), model, pattern)
        for batch in batches:
            texts = tx.texts_of(batch.column(1))
            for i, j in tx.steps(texts):
                ids = [bpe.encode(t.decode()) for t in texts.slice(i, j - i).to_pylist()]
                back = [bpe.decode(x) for x in ids]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array(back, pa.binary())], ["id", "ids", "decoded"])

    return own.mapInArrow(run, f"id {dict(own.dtypes)['id']}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def digests(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and SHA-256 digests of what :func:`byte_bpe` returns."""
    return tokens.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
