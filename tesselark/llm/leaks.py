"""Passages that documents share with a benchmark, by winnowed fingerprints.

A window is ``window`` consecutive words of an item; an item with fewer words,
but not none, is one window.  Fingerprints are the hashes of k words
(k = GRAM, or the window's length where that is smaller).  Of each run of
``window - k + 1`` of them, the words of one window, the first least one is
kept.  Two equal windows hold equal runs, so they keep the same fingerprint at
the same place: every span of at least ``window`` shared words has a common
fingerprint.  Items shorter than the window make a run length of their own, for
which documents are winnowed as well; there are at most ``window`` lengths.

Document fingerprints are joined with the benchmark's, and a hit is extended to
the windows of the document that hold it, at most ``window - k + 1``; those
that are windows of the benchmark are looked up by their hash.  Both joins have
one row on the benchmark's side for each key, so a passage that many documents
and many items share makes no pairs.  The items behind a window are told by a
hash of their set, and sets are written out once for each different set that
documents have.

A Bloom filter of a fixed number of bits goes to the tasks and thins what leaves
them.  With a larger benchmark it lets more pass; the joins alone decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tesselark.llm import text as tx
from tesselark.llm.shared import Tables

#: Words in a fingerprint.
GRAM = 5
#: log2 of the bits of the filter (4 MB), of which a fingerprint sets two.
FILTER_BITS = 25
#: Texts whose hits a task remembers, so that copies don't send them again.
REMEMBERED = 100_000


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, place of each text's first word, with the end).

    A-Z count as small; words are runs of digits, letters a-z and characters beyond ASCII.
    """
    data = tx.lowered(data)
    inside = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128)
    starts, stops, owner = tx.runs(inside, ends)
    return tx.span_hashes(data, starts, stops), np.searchsorted(owner, np.arange(len(ends)))


def runs_of_words(words: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A hash of each ``n`` consecutive words, over the ends of texts too."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        salts = tx.mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 8)) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
        for k in range(n):
            out += words[k : k + count] * salts[k]
        return tx.mix64(out)


def winnowed(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, fingerprints, hashes of all windows) for windows of ``size`` words inside one text.

    A place is that of a fingerprint's first word.
    """
    gram = min(GRAM, size)
    windows = runs_of_words(words, size, size)
    if not len(windows):
        return np.zeros(0, np.int64), windows, windows
    grams = runs_of_words(words, gram, 64 + size)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[: len(windows)] == text[size - 1 :])  # windows that end in the text they begin in
    least = sliding_window_view(grams, size - gram + 1)[: len(windows)].argmin(1)
    places = np.unique(at + least[at])
    return places, grams[places], windows


def _slots(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return fingerprints & mask, (fingerprints >> np.uint64(FILTER_BITS)) & mask


def _passes(fingerprints: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which fingerprints the filter (64-bit words) lets pass."""
    out = np.ones(len(fingerprints), bool)
    for s in _slots(fingerprints):
        out &= (bits[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1) == 1
    return out


def _filter(fingerprints: DataFrame) -> np.ndarray:
    """The filter's bits, put together by Spark; as many rows at most as it has 64-bit words."""
    mask = (1 << FILTER_BITS) - 1
    slots = fingerprints.select(F.explode(F.array(*[F.shiftrightunsigned("fingerprint", n).bitwiseAND(F.lit(mask).cast("long")) for n in (0, FILTER_BITS)])).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in words.toLocalIterator():
        bits[r.word] = r.bits
    return bits.view(np.uint64)


def _item_rows(window: int):
    """(item, size, window, fingerprint): a row for each window, with a null fingerprint, and for each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), tx.texts_of(batch.column(1))
            for i, j in tx.steps(texts):
                words, first = word_hashes(*tx.bytes_of(texts.slice(i, j - i)))
                for k in range(j - i):
                    own = words[first[k] : first[k + 1]]
                    size = min(window, len(own))
                    if not size:
                        continue
                    _, prints, windows = winnowed(own, np.array([0, len(own)]), size)
                    prints, windows = np.unique(prints).view(np.int64), np.unique(windows).view(np.int64)
                    n = len(windows) + len(prints)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(np.full(n, i + k))),
                            pa.array(np.full(n, size, np.int32)),
                            pa.concat_arrays([pa.array(windows), pa.nulls(len(prints), pa.int64())]),
                            pa.concat_arrays([pa.nulls(len(windows), pa.int64()), pa.array(prints)]),
                        ],
                        ["item", "size", "window", "fingerprint"],
                    )

    return run


def _document_rows(sizes: list[int], sent, id_type: pa.DataType):
    """A row (id, n_words, key) for each text, and one (key, size, fingerprint, start, windows) for each fingerprint that the filter lets pass.

    ``windows`` are the hashes of the windows that hold the fingerprint, the
    first of which starts at the word ``start``.  The key, of equal texts equal,
    is null where nothing passes.
    """
    schema = pa.schema([("id", id_type), ("n_words", pa.int64()), ("key", pa.binary()), ("size", pa.int32()), ("fingerprint", pa.int64()), ("start", pa.int64()), ("windows", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = sent.value, set()
        for batch in batches:
            ids, texts = batch.column(0), tx.texts_of(batch.column(1))
            for i, j in tx.steps(texts):
                part = texts.slice(i, j - i)
                data, ends = tx.bytes_of(part)
                words, first = word_hashes(data, ends)
                keys: list = [None] * (j - i)
                for size in sizes:
                    places, prints, windows = winnowed(words, first, size)
                    good = _passes(prints, bits)
                    places, prints = places[good], prints[good]
                    if not len(places):
                        continue
                    text = np.searchsorted(first, places, "right") - 1
                    for k in np.unique(text).tolist():
                        keys[k] = keys[k] or hashlib.blake2b(data[ends[k] : ends[k + 1]].tobytes(), digest_size=16).digest()
                    fresh = np.array([(keys[k], size) not in seen for k in range(j - i)])
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    seen.update((keys[k], size) for k in np.unique(text).tolist())
                    # of equal texts in this step the first speaks
                    of_key: dict = {}
                    for k in np.unique(text).tolist():
                        fresh[k] &= of_key.setdefault(keys[k], k) == k
                    good = fresh[text]
                    places, prints, text = places[good], prints[good], text[good]
                    low = np.maximum(first[text], places - (size - min(GRAM, size)))
                    count = np.minimum(first[text + 1] - size, places) - low + 1
                    to = np.cumsum(count)
                    at = np.arange(to[-1] if len(to) else 0) + np.repeat(low - (to - count), count)
                    n = len(places)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.nulls(n, id_type),
                            pa.nulls(n, pa.int64()),
                            pa.array([keys[k] for k in text.tolist()], pa.binary()),
                            pa.array(np.full(n, size, np.int32)),
                            pa.array(prints.view(np.int64)),
                            pa.array(low - first[text]),
                            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], to]).astype(np.int32)), pa.array(windows[at].view(np.int64))),
                        ],
                        schema=schema,
                    )
                n = j - i
                none = [pa.nulls(n, f.type) for f in list(schema)[3:]]
                yield pa.RecordBatch.from_arrays([ids.slice(i, n), pa.array(np.diff(first)), pa.array(keys, pa.binary()), *none], schema=schema)

    return run


def _set_of(member: str) -> F.Column:
    """A name for the set of a group's different values of ``member``, without gathering them."""
    return F.concat_ws(":", F.count(member), *[F.bit_xor(F.xxhash64(F.col(member), F.lit(salt))) for salt in (1, 2)])


def shared_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, spans, owned): what documents share with the items, with all of their text kept out.

    texts: id_col, n_words and key, one row a document; key is null where
    nothing can be shared.  spans: key, start, stop (in words, end exclusive)
    and owner, one row for each window of the benchmark that occurs.  owned:
    owner and item, the items (as strings) that an owner stands for.
    """
    tables = Tables(docs.sparkSession)
    own = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null")
    known, _ = tables.write(own.mapInArrow(_item_rows(window), "item string, size int, window long, fingerprint long").distinct())
    prints = known.where("fingerprint is not null").select("size", "fingerprint").distinct()
    owners, _ = tables.write(known.where("window is not null").groupBy("size", "window").agg(_set_of("item").alias("owner")))
    sizes = sorted(r.size for r in owners.select("size").distinct().collect())  # at most ``window``
    sent = docs.sparkSession.sparkContext.broadcast(_filter(prints))
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(read.dtypes)["id"]
    id_type = to_arrow_type(read.schema["id"].dataType)
    rows, _ = tables.write(read.mapInArrow(_document_rows(sizes, sent, id_type), f"id {kind}, n_words long, key binary, size int, fingerprint long, start long, windows array<long>"))
    hits = rows.where("fingerprint is not null").select("key", "size", "fingerprint", "start", "windows").dropDuplicates(["key", "size", "fingerprint", "start"])
    hits = hits.join(prints, ["size", "fingerprint"], "left_semi").select("key", "size", "start", F.posexplode("windows").alias("nth", "window"))
    found = hits.join(owners, ["size", "window"])
    spans, _ = tables.write(found.select("key", (F.col("start") + F.col("nth")).alias("start"), (F.col("start") + F.col("nth") + F.col("size")).alias("stop"), "owner").distinct())
    one = owners.groupBy("owner").agg(F.min(F.struct("size", "window")).alias("at")).select("owner", "at.size", "at.window")
    owned = known.where("window is not null").join(one, ["size", "window"]).select("owner", "item")
    texts = rows.where("fingerprint is null").select(F.col("id").alias(id_col), "n_words", "key")
    return texts, spans, owned


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 10) -> DataFrame:
    """How much of each document occurs in the items' windows.

    Returns id_col, n_words, n_hit (words inside any occurrence of a window),
    n_items (items that have such a window), items_sha256 (of their ids, sorted
    as strings and joined by commas; of the empty string where there are none)
    and contaminated (n_hit > 0), one row for each row of ``docs``.

    A null text has no words.  An item with a null id takes no part; items that
    share an id are one, those with equal texts each count.  Null and repeated
    document ids stay as they are, one row each.  A document is read whole,
    whatever its length: a task holds its words' hashes.  Without documents
    there are no rows, without items nothing is hit.  Other columns are ignored.
    """
    tables = Tables(docs.sparkSession)
    texts, spans, owned = shared_passages(docs, items, id_col, text_col, item_col, window)
    # words of the union of spans, in one walk over a text's spans in order
    step = "(s, p) -> named_struct('n', s.n + greatest(0L, p.stop - greatest(s.at, p.start)), 'at', greatest(s.at, p.stop))"
    union = F.expr(f"aggregate(array_sort(collect_set(struct(start, stop))), named_struct('n', 0L, 'at', 0L), {step}, s -> s.n)")
    hit = spans.groupBy("key").agg(union.alias("n_hit"))
    pairs = spans.select("key", "owner").distinct()
    profiles, _ = tables.write(pairs.groupBy("key").agg(_set_of("owner").alias("profile")))
    one = profiles.groupBy("profile").agg(F.min("key").alias("key"))
    listed = one.join(pairs, "key").join(owned, "owner").select("profile", "item").distinct()
    listed = listed.groupBy("profile").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item"))).cast("binary"), 256).alias("items_sha256"))
    told = hit.join(profiles, "key").join(listed, "profile").select("key", "n_hit", "n_items", "items_sha256")
    zero, none = F.lit(0).cast("long"), F.lit(hashlib.sha256(b"").hexdigest())
    out = texts.join(told, "key", "left")
    return out.select(id_col, "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"))
