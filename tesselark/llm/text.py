"""Vectorised access to Arrow text columns: byte views, word spans and hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy step works on (a longer text is one step).
STEP_BYTES = 2 << 20

_PRIME = 0x9E3779B97F4A7C55  # odd, so its powers can be inverted modulo 2**64
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int = 1) -> np.ndarray:
    """A random 64-bit value for each byte."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = byte_table()


def texts_of(column: pa.Array) -> pa.Array:
    """The column as large binary, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    return pc.fill_null(column, "").cast(pa.large_binary())


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets from 0), without copying."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8, int(ends[-1] - ends[0]), int(ends[0])), ends - ends[0]


def steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or one row."""
    _, ends = bytes_of(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lowered(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z in lower case; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def runs(member: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, text index) of the runs of member bytes, none across two texts."""
    n = len(member)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, bool)  # a text starts here
    edge[ends] = True
    starts = member.copy()
    starts[1:] &= ~member[:-1] | edge[1:n]
    stops = member.copy()
    stops[:-1] &= ~member[1:] | edge[1:n]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(ends, starts, "right") - 1


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, text index) of the runs of bytes other than space and 9-13.

    UTF-8 never uses those bytes inside a longer character, so byte runs are
    the runs of code points too.
    """
    return runs(~((data == 32) | ((data >= 9) & (data <= 13))), ends)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, STEP_BYTES + 1)
        with np.errstate(over="ignore"):
            up = np.full(size, _PRIME, np.uint64)
            up[0] = 1
            down = np.full(size, pow(_PRIME, -1, 1 << 64), np.uint64)
            down[0] = 1
            _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    return _powers["up"][:n], _powers["down"][:n]


def _sums_of_spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The polynomial of each span's bytes, from one prefix sum."""
    up, down = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return (sums[stops] - sums[starts]) * down[starts]


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans.

    Bytes are taken up to STEP_BYTES at a time, so the memory beside the result
    is bounded however long a text or a span is.
    """
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    half = STEP_BYTES // 2
    with np.errstate(over="ignore"):
        if len(data) <= STEP_BYTES:
            out = _sums_of_spans(data, starts, stops)
        else:
            long = stops - starts > half
            for k in np.flatnonzero(long).tolist():
                power = 1
                for at in range(int(starts[k]), int(stops[k]), half):
                    piece = data[at : min(at + half, int(stops[k]))]
                    out[k] += _sums_of_spans(piece, np.array([0]), np.array([len(piece)]))[0] * np.uint64(power)
                    power = power * pow(_PRIME, half, 1 << 64) % (1 << 64)
            order = np.flatnonzero(~long)
            order = order[np.argsort(starts[order], kind="stable")]
            i = 0
            while i < len(order):
                first = int(starts[order[i]])
                j = int(np.searchsorted(starts[order], first + half, "right"))
                part = order[i:j]
                out[part] = _sums_of_spans(data[first : int(stops[part].max())], starts[part] - first, stops[part] - first)
                i = j
        return mix64(out + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hash(word: str) -> int:
    """The hash that :func:`span_hashes` gives this word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])
