"""Baseline JPEG media columns: bytes kept as DCT coefficients of an 8-bit grey image.

A payload of 64-byte units becomes a grid of 8x8 blocks: byte k of a unit, less
128, is the block's quantised coefficient k in zigzag order (all quantisers are
1, so nothing is lost).  The file is ordinary baseline JPEG with a restart
marker after every block; so every block starts on a byte, and numpy writes and
reads all blocks of a batch in step, one coefficient of each at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.llm import text as tx

UNIT = 64
#: Blocks that are written or read in step.
TOGETHER = 16384


def _tables() -> tuple[list[int], bytes, list[int], bytes]:
    """(counts, symbols) of the DC and AC Huffman tables, by one rule.

    DC: the eleven categories with 4-bit codes.  AC: a coefficient without zeros
    before it, which text nearly always has, gets 4 bits, the end of block and
    a run of sixteen 7 bits, any other (run, size) 11 bits.
    """
    dc = [0] * 16
    dc[3] = 12
    plain = bytes(range(1, 11))
    special = bytes([0x00, 0xF0])
    other = bytes(run << 4 | size for size in range(1, 11) for run in range(1, 16))
    ac = [0] * 16
    ac[3], ac[6], ac[10] = len(plain), len(special), len(other)
    return dc, bytes(range(12)), ac, plain + special + other


DC_COUNTS, DC_SYMBOLS, AC_COUNTS, AC_SYMBOLS = _tables()


def canonical(counts: list[int], symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) of each symbol, by the counts of each length."""
    codes, lengths = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    code = at = 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            codes[s], lengths[s] = code, length
            code += 1
        at += n
        code <<= 1
    return codes, lengths


def lookup(counts: list[int], symbols: bytes) -> np.ndarray:
    """For each next 16 bits, symbol * 32 + length of its code; 0 where there's none."""
    codes, lengths = canonical(counts, symbols)
    out = np.zeros(1 << 16, np.int32)
    for s in symbols:
        first = int(codes[s]) << (16 - int(lengths[s]))
        out[first : first + (1 << (16 - int(lengths[s])))] = s * 32 + int(lengths[s])
    return out


_SIZE = np.array([abs(v).bit_length() for v in range(-1024, 1025)], np.int64)


def _symbols(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each coefficient of the blocks, the bits it adds and how many.

    A zero adds none; its run goes with the next other coefficient, or with the
    end of block at the last place.  At most 3 * 7 + 11 + 10 bits each.
    """
    dc, dc_len = canonical(DC_COUNTS, DC_SYMBOLS)
    ac, ac_len = canonical(AC_COUNTS, AC_SYMBOLS)
    v = v.astype(np.int64)
    size = _SIZE[v + 1024]
    extra = (v - (v < 0) + ((v < 0).astype(np.int64) << size)).astype(np.uint64)
    wide = size.astype(np.uint64)
    bits = (ac[size] << wide) | extra
    length = ac_len[size] + size
    bits[:, 0] = (dc[size[:, 0]] << wide[:, 0]) | extra[:, 0]
    length[:, 0] = dc_len[size[:, 0]] + size[:, 0]
    rows = np.flatnonzero((v[:, 1:] == 0).any(1))
    if rows.size:
        u = v[rows]
        other = u != 0
        other[:, 0] = True
        last = np.maximum.accumulate(np.where(other, np.arange(UNIT), 0), 1)
        run = np.zeros(u.shape, np.int64)
        run[:, 1:] = np.arange(UNIT)[1:] - last[:, :-1] - 1
        symbol = (run & 15) << 4 | size[rows]
        b = (ac[symbol] << wide[rows]) | extra[rows]
        n = ac_len[symbol] + size[rows]
        for k in range(1, 4):
            more = run >= 16 * k
            b = np.where(more, b | (ac[0xF0] << n.astype(np.uint64)), b)
            n = n + more * ac_len[0xF0]
        b, n = np.where(other, b, 0), np.where(other, n, 0)
        end = ~other[:, -1]
        b[end, -1], n[end, -1] = ac[0], ac_len[0]
        bits[rows, 1:], length[rows, 1:] = b[:, 1:], n[:, 1:]
    return bits, length


def encode_blocks(coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of each block (rows of 64), stuffed, and their lengths."""
    bits, length = _symbols(coefficients)
    total = length.sum(1)
    size = (total + 7) >> 3
    ends = np.cumsum(size)
    flat = np.zeros(int(ends[-1]) + 8, np.uint8)
    usual = length.max(1) <= 14
    for rows in (np.flatnonzero(usual), np.flatnonzero(~usual)):
        if not rows.size:
            continue
        b, n = bits[rows], length[rows]
        while b.shape[1] > 1 and 2 * n.max() <= 56:  # join neighbours while they fit beside 7 bits
            b, n = (b[:, ::2] << n[:, 1::2].astype(np.uint64)) | b[:, 1::2], n[:, ::2] + n[:, 1::2]
        at = ((ends - size)[rows] << 3)[:, None] + np.cumsum(n, 1) - n
        b = b << (64 - n - (at & 7)).astype(np.uint64) * (n > 0)
        at >>= 3
        many = (int(n.max()) + 14) >> 3
        for column in range(b.shape[1]):  # blocks never share a byte
            value, place = b[:, column].astype(">u8").view(np.uint8).reshape(-1, 8), at[:, column]
            for k in range(many):
                flat[place + k] |= value[:, k]
    gap = (size << 3) - total
    flat[ends - 1] |= ((1 << gap) - 1).astype(np.uint8)
    flat = flat[: int(ends[-1])]
    stuff = flat == 255
    if not stuff.any():
        return flat, size
    stuffed = np.cumsum(stuff)
    out = np.zeros(len(flat) + int(stuffed[-1]), np.uint8)
    out[np.arange(len(flat)) + stuffed - stuff] = flat
    return out, np.diff(np.concatenate([[0], ends + stuffed[ends - 1]]))


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def grid_of(units: int) -> tuple[int, int]:
    """(columns, rows) of a nearly square grid with room for so many blocks."""
    columns = int(np.ceil(np.sqrt(units)))
    return columns, -(-units // columns)


def wrap(units: int, scan: bytes) -> bytes:
    """A whole JPEG file around a scan of ``units`` payload blocks (and grey ones to fill the grid)."""
    columns, rows = grid_of(units)
    frame = bytes([8]) + (rows * 8).to_bytes(2, "big") + (columns * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    return b"".join((
        b"\xff\xd8", _segment(0xFE, b"payload-bytes=%d" % (units * UNIT)), _segment(0xDB, bytes([0]) + bytes([1]) * 64), _segment(0xC0, frame),
        _segment(0xC4, bytes([0, *DC_COUNTS]) + DC_SYMBOLS), _segment(0xC4, bytes([0x10, *AC_COUNTS]) + AC_SYMBOLS),
        _segment(0xDD, (1).to_bytes(2, "big")), _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])), scan, b"\xff\xd9",
    ))


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload, whose length is a positive multiple of 64."""
    units = [len(p) // UNIT for p in payloads]
    if any(len(p) % UNIT or not p for p in payloads):
        raise ValueError("a payload is a positive multiple of 64 bytes")
    coefficients = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT).astype(np.int16) - 128
    parts, sizes = [], []
    for i in range(0, len(coefficients), TOGETHER):
        data, length = encode_blocks(coefficients[i : i + TOGETHER])
        parts.append(data)
        sizes.append(length)
    data, size = np.concatenate(parts), np.concatenate(sizes)
    grey = encode_blocks(np.zeros((1, UNIT), np.int16))[0].tobytes()
    ends = np.cumsum(size)
    # room for a restart marker after every block
    out = np.empty(len(data) + 2 * len(size), np.uint8)
    at = np.arange(len(data)) + 2 * np.repeat(np.arange(len(size)), size)
    out[at] = data
    marks = ends + 2 * np.arange(len(size))
    index = np.concatenate([np.arange(u) for u in units])
    out[marks] = 0xFF
    out[marks + 1] = 0xD0 + index % 8
    files, first = [], 0
    for u in units:
        a = int(marks[first - 1] + 2) if first else 0
        first += u
        scan = out[a : int(marks[first - 1])].tobytes()
        columns, rows = grid_of(u)
        for k in range(u, columns * rows):
            scan += bytes([0xFF, 0xD0 + (k - 1) % 8]) + grey
        files.append(wrap(u, scan))
    return files


class Parsed:
    """The markers of one baseline JPEG file, and its scan's bytes."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.quantisers, self.huffman = {}, {}
        self.comment, self.interval, at = b"", 0, 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    if body[0] >> 4:
                        raise ValueError("baseline quantisers have 8 bits")
                    self.quantisers[body[0] & 15] = np.frombuffer(body[1:65], np.uint8)
                    body = body[65:]
            elif marker == 0xC0:
                self.height, self.width, self.components = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]
                self.quantiser = body[8]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = (tuple(body[1:17]), body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.interval = int.from_bytes(body, "big")
            elif marker == 0xDA:
                self.tables = body[2]
                break
            elif 0xC1 <= marker <= 0xCF:
                raise ValueError("not a baseline frame")
        self.scan = data[at : data.rindex(b"\xff\xd9")]
        if self.components != 1:
            raise ValueError("one grey component is expected")
        self.columns, self.rows = -(-self.width // 8), -(-self.height // 8)


def _at_once(ac: np.ndarray) -> np.ndarray:
    """For each next 16 bits: (value + 1024) * 32 + bits used, of a coefficient that
    follows no zero and fits in them; else 0."""
    w = np.arange(1 << 16)
    length, symbol = ac & 31, ac >> 5
    size = symbol & 15
    fits = (length > 0) & (symbol >> 4 == 0) & (size > 0) & (length + size <= 16)
    size = np.where(fits, size, 1)
    value = (w >> np.where(fits, 16 - length - size, 0)) & ((1 << size) - 1)
    value = value - (value < (1 << size >> 1)) * ((1 << size) - 1)
    return np.where(fits, (value + 1024) * 32 + length + size, 0).astype(np.int32)


def decode_blocks(data: np.ndarray, starts: np.ndarray, blocks: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """Coefficients of all blocks of many restart intervals, decoded in step.

    ``data`` has no stuffed bytes and at least 4 spare ones at its end;
    interval i starts at byte starts[i] and holds blocks[i] blocks.
    """
    first = np.cumsum(blocks) - blocks
    out = np.zeros((int(blocks.sum()), UNIT), np.int16)
    wide = data.astype(np.uint32)
    windows = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    once = _at_once(ac)
    bit = starts.astype(np.int64) * 8

    def look(p: np.ndarray) -> np.ndarray:
        return windows[p >> 3] << (p & 7).astype(np.uint32)  # 25 bits at least; a symbol takes 21 at most

    def value_of(window: np.ndarray, length: np.ndarray, size: np.ndarray) -> np.ndarray:
        value = ((window << length.astype(np.uint32)).astype(np.int64) >> (32 - size)) * (size > 0)
        return value - (value < (1 << size >> 1)) * ((1 << size) - 1)

    for b in range(int(blocks.max(initial=0))):
        rows = np.flatnonzero(blocks > b)
        target, p = first[rows] + b, bit[rows]
        window = look(p)
        code = dc[window >> 16]
        if (code == 0).any():
            raise ValueError("a code that no table has")
        length, size = code & 31, code >> 5
        out[target, 0] = value_of(window, length, size) + (out[target - 1, 0] if b else 0)
        p = p + length + size
        k = np.ones(len(rows), np.int64)
        even = np.arange(len(rows))  # those that have met no zero
        pe, te = p, target
        for at in range(1, UNIT):
            got = once[look(pe) >> 16]
            if (got == 0).any():
                odd = got == 0
                k[even[odd]], p[even[odd]] = at, pe[odd]
                keep = ~odd
                even, pe, te, got = even[keep], pe[keep], te[keep], got[keep]
            out[te, at] = (got >> 5) - 1024
            pe = pe + (got & 31)
        k[even], p[even] = UNIT, pe
        live = np.flatnonzero(k < UNIT)
        while live.size:
            window = look(p[live])
            code = ac[window >> 16]
            if (code == 0).any():
                raise ValueError("a code that no table has")
            length, symbol = code & 31, code >> 5
            size, at = symbol & 15, k[live] + (symbol >> 4)
            real = (size > 0) & (at < UNIT)
            out[target[live[real]], at[real]] = value_of(window, length, size)[real]
            p[live] += length + size
            k[live] = np.where(symbol == 0, UNIT, at + 1)
            live = live[k[live] < UNIT]
        bit[rows] = p
    return out


def decode(files: list[bytes]) -> list[tuple[Parsed, np.ndarray]]:
    """(markers, coefficients of every block) of each file.

    Files of equal tables are decoded together, a batch at a time.
    """
    parsed = [Parsed(f) for f in files]
    groups: dict = {}
    for i, p in enumerate(parsed):
        groups.setdefault((p.huffman[p.tables >> 4], p.huffman[16 | p.tables & 15]), []).append(i)
    found: list = [None] * len(files)
    for (dc, ac), members in groups.items():
        dc, ac = lookup(*dc), lookup(*ac)
        i = 0
        while i < len(members):
            j, n = i, 0
            while j < len(members) and (j == i or n + parsed[members[j]].columns * parsed[members[j]].rows <= TOGETHER):
                n += parsed[members[j]].columns * parsed[members[j]].rows
                j += 1
            starts, blocks, scans, base = [], [], [], 0
            for p in (parsed[m] for m in members[i:j]):
                raw = np.frombuffer(p.scan, np.uint8)
                after = np.flatnonzero((raw[:-1] == 255)) + 1
                stuffed, marks = after[raw[after] == 0], after[(raw[after] >= 0xD0) & (raw[after] <= 0xD7)]
                keep = np.ones(len(raw), bool)
                keep[stuffed] = False
                keep[marks] = False
                keep[marks - 1] = False
                scans.append(raw[keep])
                index = np.concatenate([[0], np.cumsum(keep)])
                total = p.columns * p.rows
                starts.append(base + index[np.concatenate([[0], marks + 1]).astype(np.int64)])
                each = p.interval or total
                count = np.full(len(marks) + 1, each)
                count[-1] = total - each * len(marks)
                blocks.append(count)
                base += len(scans[-1])
            spare = np.zeros(8, np.uint8)
            got = decode_blocks(np.concatenate([*scans, spare]), np.concatenate(starts), np.concatenate(blocks), dc, ac)
            at = 0
            for m in members[i:j]:
                p = parsed[m]
                found[m] = (p, got[at : at + p.columns * p.rows])
                at += p.columns * p.rows
            i = j
    return found


def payload_of(parsed: Parsed, coefficients: np.ndarray) -> bytes:
    """The stored payload, from the coefficients that were read."""
    n = int(parsed.comment.rpartition(b"=")[2])
    return (coefficients.ravel()[:n] + 128).astype(np.uint8).tobytes()


def thumbnail(parsed: Parsed, coefficients: np.ndarray) -> np.ndarray:
    """Luminance of each 8x8 block, from its DC coefficient only."""
    level = coefficients[:, 0].astype(np.float64) * int(parsed.quantisers[parsed.quantiser][0]) / 8 + 128
    return np.clip(np.rint(level), 0, 255).reshape(parsed.rows, parsed.columns)


def thumbnail_hash(image: np.ndarray) -> str:
    """64 bits: whether each cell of an 8x8 sampling is above the next to its right."""
    y = np.arange(8) * image.shape[0] // 8
    x = np.arange(9) * image.shape[1] // 9
    cell = image[np.ix_(y, x)]
    return np.packbits(cell[:, :-1] > cell[:, 1:]).tobytes().hex()


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text's bytes as a JPEG file, reads it back and describes it.

    The payload is the text's UTF-8 bytes (null: none) and bytes 0 up to a
    positive multiple of 64.  Returns id_col, n_bytes (of the text), media (the
    file), payload (read back from it), width, height, thumb_width,
    thumb_height and thumb_hash.  Equal texts give equal values; null ids and
    repeated rows stay; an empty table gives no rows; other columns are ignored.
    A text is stored whole, however long; a task holds its file and coefficients.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tx.texts_of(batch.column(1))
            for i, j in tx.steps(texts, 1 << 20):
                raw = texts.slice(i, j - i).to_pylist()
                files = encode([r + bytes(-len(r) % UNIT if r else UNIT) for r in raw])
                back = decode(files)
                thumbs = [thumbnail(p, c) for p, c in back]
                out = [
                    batch.column(0).slice(i, j - i), pa.array(map(len, raw), pa.int64()), pa.array(files, pa.binary()), pa.array([payload_of(p, c) for p, c in back], pa.binary()),
                    pa.array([p.width for p, _ in back], pa.int32()), pa.array([p.height for p, _ in back], pa.int32()),
                    pa.array([t.shape[1] for t in thumbs], pa.int32()), pa.array([t.shape[0] for t in thumbs], pa.int32()), pa.array(map(thumbnail_hash, thumbs), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(out, ["id", "n_bytes", "media", "payload", "width", "height", "thumb_width", "thumb_height", "thumb_hash"])

    schema = f"id {dict(own.dtypes)['id']}, n_bytes long, media binary, payload binary, width int, height int, thumb_width int, thumb_height int, thumb_hash string"
    return own.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lengths and digests of what :func:`media_columns` returns."""
    return media.select(
        id_col,
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 63, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "width", "height"), F.concat_ws("x", "thumb_width", "thumb_height"), "thumb_hash").alias("feature"),
    )
