"""Packing token sequences by bounded-space online best-fit."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.llm import text as tx
from tesselark.llm.shared import cut

#: Tokens that one task packs, about.
TASK_TOKENS = 16 << 20
#: Distinct words whose ids a worker remembers before it starts afresh, and bytes of words and ids.
REMEMBERED, REMEMBERED_BYTES = 800_000, 64 << 20
#: Words of letters that are encoded as one line, bytes of texts whose words are told apart together, and texts that get their ids at once.
LINE_WORDS, STEP_BYTES, TEXTS_DEALT = 4096, 8 << 20, 256
#: Marks that may follow a word of letters; the tokenizer parts them from it.
MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_{|}~"


def most_open(size: int, task_tokens: int = TASK_TOKENS) -> int:
    """As many sequences of ``size`` as a task can need to hold open.

    Two sequences together hold more than ``size`` tokens, or the second would
    not have been opened; an eighth more allows for what a hash deals unevenly.
    """
    return 2 * (task_tokens + task_tokens // 8) // size + 1


class OpenBins:
    """At most ``most`` open bins of ``size``, keyed by their free space.

    A bitset has bit f set while a bin with f free places is open, so the best
    fit is the lowest set bit from the item's length on.  When a new bin would
    be one too many, the fullest open bin closes.
    """

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = self.open = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for an item of this length."""
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            at = self.free[space].pop()
            if not self.free[space]:
                self.bits ^= 1 << space
            self.open -= 1
        else:
            space, at = self.size, self.made
            self.made += 1
            if self.open >= self.most:
                full = (self.bits & -self.bits).bit_length() - 1
                self.free[full].pop()
                if not self.free[full]:
                    self.bits ^= 1 << full
                self.open -= 1
        left = space - length
        if left:
            self.free[left].append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.size - space


def _lookup(words: pa.Array, among: pa.Array) -> np.ndarray:
    """The place of each word among others, -1 for none."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy().astype(np.int64)


class WordIds:
    """Ids of texts by a tokenizers file that never joins words across white space.

    Words that were met are kept as one Arrow array, their ids as one numpy
    array with the places where each word's end.  A text that holds one of the
    file's added tokens goes to the tokenizer whole.
    """

    def __init__(self, definition: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # where a model marks the last token of a word, the ids alone tell words apart
        self.last, suffix = None, json.loads(definition)["model"].get("end_of_word_suffix")
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids, self.ends = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    @property
    def known(self) -> dict[str, bytes]:
        """The words that are remembered, with their ids."""
        return {w: self.ids[i:j].tobytes() for w, i, j in zip(self.words.to_pylist(), self.ends[:-1], self.ends[1:], strict=True)}

    def _keep(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.ids = np.concatenate([self.ids, ids.astype("<u4")])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int64)])

    def _gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of the remembered words at these places, one after another."""
        sizes = self.ends[at + 1] - self.ends[at]
        stops = np.cumsum(sizes)
        place = np.repeat(self.ends[at] - stops + sizes, sizes)
        place += np.arange(len(place))
        return self.ids[place], sizes

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where different words are remembered; new ones are learned."""
        if len(self.words) > REMEMBERED or self.words.nbytes + self.ids.nbytes > REMEMBERED_BYTES:
            self._forget()
        at = _lookup(words, self.words)
        if (at < 0).any():
            self._learn(words.filter(pa.array(at < 0)))
            at = _lookup(words, self.words)
        return at

    def _learn(self, words: pa.Array) -> None:
        """Remembers the ids of new words.

        A word of letters with marks behind it is the letters' ids and the
        marks', if the letters' lower case is letters alone (that of a dotted
        capital I ends in a mark, which the next marks join); new words of
        letters are encoded together, in lines.
        """
        cores = pc.utf8_rtrim(words, characters=MARKS)
        told = cores.dictionary_encode()
        plain = [c.isalpha() and (c.isascii() or unicodedata.normalize("NFC", c.lower()).isalpha()) for c in told.dictionary.to_numpy(zero_copy_only=False).tolist()]
        letters = pc.take(pa.array(plain, pa.bool_()), told.indices)
        marked = pc.and_(letters, pc.not_equal(cores, words))
        both, heads = words.filter(marked), cores.filter(marked)
        tails = pc.replace_substring_regex(both, pattern="^[^" + re.escape(MARKS) + "]+", replacement="")
        lines = cores.filter(letters).unique()
        others = pa.concat_arrays([words.filter(pc.invert(letters)), tails]).unique()
        unknown = _lookup(pa.concat_arrays([lines, others]), self.words) < 0
        self._lines(lines.filter(pa.array(unknown[: len(lines)])))
        self._each(others.filter(pa.array(unknown[len(lines) :])))
        if len(both):
            at = _lookup(pa.concat_arrays([heads, tails]), self.words).reshape(2, -1)
            ids, sizes = self._gathered(at.T.ravel())
            self._keep(both, ids, sizes.reshape(-1, 2).sum(1))

    def _lines(self, words: pa.Array) -> None:
        """Remembers the ids of words of letters, each of them one word to the tokenizer too."""
        kept, odd = [], []
        for i in range(0, len(words), LINE_WORDS):
            part = words.slice(i, LINE_WORDS)
            line = " ".join(part.to_numpy(zero_copy_only=False).tolist())
            if self.last is not None:
                ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
                stops = np.flatnonzero(self.last[ids]) + 1
            else:
                encoded = self.tokenizer.encode(line, add_special_tokens=False)
                ids, at = np.array(encoded.ids, "<u4"), np.array(encoded.word_ids, np.int64)
                stops = np.append(np.flatnonzero(np.diff(at)) + 1, len(at)) if len(at) and at[-1] + 1 == len(part) else at[:0]
            if len(stops) == len(part):
                kept.append((part, ids, np.diff(stops, prepend=0)))
            else:  # a letter's lower case is no single letter
                odd.append(part)
        if kept:
            parts, ids, sizes = zip(*kept, strict=True)
            self._keep(pa.concat_arrays(parts), np.concatenate(ids), np.concatenate(sizes))
        for part in odd:
            self._each(part)

    def _each(self, words: pa.Array) -> None:
        """Remembers the ids of words, encoded one by one."""
        for i in range(0, len(words), LINE_WORDS):
            part = words.slice(i, LINE_WORDS)
            got = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(part.to_pylist(), add_special_tokens=False)]
            self._keep(part, np.concatenate(got), np.array([len(x) for x in got], np.int64))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (large binary) as little-endian unsigned 32-bit values.

        A step's distinct words are looked up once.  Parting at fewer kinds of
        white space than the tokenizer knows is no loss: a word may hold others.
        """
        texts = texts.cast(pa.large_string())
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        at, known = words.indices.to_numpy(), self._places(words.dictionary)
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        out = []
        for i in range(0, len(texts), TEXTS_DEALT):
            cuts = offsets[i : i + TEXTS_DEALT + 1]
            ids, sizes = self._gathered(known[at[cuts[0] : cuts[-1]]])
            cuts = np.append(0, np.cumsum(sizes))[cuts - cuts[0]].tolist()
            out += [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for token in self.added:
            for k in np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False)).tolist():
                out[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit values."""
        return self.encode_all(pa.array([text.encode()], pa.large_binary()))[0]


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Each text's ids and ``end_id``, cut into pieces of at most ``size``.

    ``tokenizer`` is the path of a tokenizers definition whose pre-tokeniser
    parts at white space.  Only texts longer than ``size`` are cut.  Returns
    id_col, piece, start, length, ids_crc32 and, if asked, the ids themselves.
    A null or empty text is one piece that holds ``end_id`` alone.  A text is
    encoded whole, however long; null ids and repeated rows stay, an empty
    table gives no rows, other columns are ignored.
    """
    with open(tokenizer, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(sent.value)
        for batch in batches:
            texts = tx.texts_of(batch.column(1))
            for i, j in tx.steps(texts, STEP_BYTES):
                rows, pieces, raws = [], [], []
                for k, encoded in enumerate(words.encode_all(texts.slice(i, j - i)), i):
                    ids = encoded + end
                    for p, at in enumerate(range(0, len(ids), 4 * size)):
                        raw = ids[at : at + 4 * size]
                        rows.append(k)
                        pieces.append((p, at // 4, len(raw) // 4, zlib.crc32(raw)))
                        if with_ids:
                            raws.append(np.frombuffer(raw, "<i4"))
                p, start, length, crc = zip(*pieces, strict=True)
                out = [batch.column(0).take(pa.array(rows)), pa.array(p, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(raws, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    schema = f"id {dict(own.dtypes)['id']}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return own.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def pack(pieces: DataFrame, by: list[str], size: int = 2048, open_bins: int | None = None, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """Places pieces (column length, 1 to ``size``) into sequences of ``size``.

    Adds sequence_id and offset (from 0, without gaps).  Pieces are dealt to
    tasks by a hash of their place in the written table, so no key or group of
    equal rows can gather.  A task takes its pieces longest first, those of one
    length by the columns ``by``, and puts each into the fullest open sequence
    that has room.  It holds ``open_bins`` sequences open, or as many as it can
    need.  An empty input gives no rows; repeated rows are placed one by one.
    Pieces that have a column of one of the new names, or __place, are refused.
    """
    taken = {"sequence_id", "offset", "__place"} & set(pieces.columns)
    if taken:
        raise ValueError(f"pieces already have {', '.join(sorted(taken))}")
    most = most_open(size, task_tokens) if open_bins is None else open_bins
    pieces = cut(pieces)
    total = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // task_tokens))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        bins = OpenBins(size, most)
        for batch in batches:
            put = np.array([bins.put(n) for n in batch.column("length").to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 2], pa.array(base + put[:, 0]), pa.array(put[:, 1])], names)

    dealt = pieces.withColumn("__place", F.monotonically_increasing_id()).repartition(tasks, "__place").sortWithinPartitions(F.desc("length"), *by, "__place")
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0, open_bins: int | None = None) -> DataFrame:
    """Tokenizes, cuts and packs whole texts; see :func:`token_pieces` and :func:`pack`.

    Returns id_col, piece, start, length, ids_crc32, sequence_id and offset.
    """
    return pack(token_pieces(docs, tokenizer, id_col, text_col, size, end_id), [id_col, "piece", "ids_crc32"], size, open_bins)
