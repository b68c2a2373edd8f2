"""The prefix trie of conversations, as succinct level-order tries of sorted shards.

Equal conversations collapse first.  The rest, as sequences of 16-byte turn
labels, are range-partitioned and sorted, so those with a common beginning lie
side by side and no beginning, however common, is a key that gathers.  A task
cuts its range into shards of bounded size and builds the trie of each: nodes in
level order, a LOUDS bit vector (for each node a one a child, then a zero) and
an array of labels.  A node's parent is read off the bits, and one walk over the
levels from the last to the first rolls sums and minima up with add.at.

A node that can go on in another shard lies on the path of the shard's first or
last conversation.  What such a node holds of its own (members that end there
and whole subtrees below) goes along its path into another trie; these upper
levels are sharded in the same way, until one small trie is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.llm import text as tx
from tesselark.llm.shared import Tables

#: Nodes in a shard (a conversation with more is one with others beside it), and the most tasks of a pass.
NODES, MOST_TASKS = 16384, 10_000
#: Conversations in a shard at least, so that every pass leaves fewer.
LEAST = 8
#: Ids are hashed in pieces of this many consecutive numbers.
ID_BITS = 16

_NODE = "key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PATH = "seq binary, words array<int>, first long, n array<long>, low array<long>, kids array<long>, leaves array<long>, saved array<long>, ends array<string>"
_LONGS = pa.list_(pa.int64())
_NODE_SCHEMA = pa.schema(
    [("key", pa.binary()), ("parent_key", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64())]
    + [("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
)
_PATH_SCHEMA = pa.schema(
    [("seq", pa.binary()), ("words", pa.list_(pa.int32())), ("first", pa.int64())] + [(c, _LONGS) for c in ("n", "low", "kids", "leaves", "saved")] + [("ends", pa.list_(pa.string()))]
)
_SCHEMA = pa.schema([*_NODE_SCHEMA, *_PATH_SCHEMA])
PATH_COLUMNS = _PATH_SCHEMA.names
NO_IDS = hashlib.sha256(b"").hexdigest()


class Louds:
    """A trie in level order: ``bits`` as LOUDS, ``label`` the place of each node's turn (-1 for the root), ``level`` where each depth begins."""

    def __init__(self, labels: np.ndarray, ends: np.ndarray):
        """From sorted sequences: their turns' labels (n, 2) one after another, and where each sequence ends."""
        size = np.diff(ends)
        self.rows, self.common = len(size), np.zeros(len(size), np.int64)
        least = np.minimum(size[1:], size[:-1])
        at = np.arange(least.sum()) - np.repeat(np.cumsum(least) - least, least)  # place within each pair of neighbours
        here, there = at + np.repeat(ends[1:-1], least), at + np.repeat(ends[:-2], least)
        same = (labels[here] == labels[there]).all(1)
        some = np.flatnonzero(least > 0)
        if len(some):
            upto = np.where(same, np.repeat(least, least), at)
            self.common[1 + some] = np.minimum.reduceat(upto, (np.cumsum(least) - least)[some])
        made = size - self.common
        row = np.repeat(np.arange(self.rows), made)
        depth = np.arange(len(row)) - np.repeat(np.cumsum(made) - made, made) + np.repeat(self.common, made) + 1
        order = np.argsort(depth, kind="stable")
        self.depth, row = np.concatenate([[0], depth[order]]), np.concatenate([[0], row[order]])
        self.label = np.where(self.depth > 0, ends[row] + self.depth - 1, -1)
        self._places = self.depth * self.rows + row
        children = np.bincount(self.node(row[1:], self.depth[1:] - 1), minlength=len(row))
        self.bits = np.ones(2 * len(row) + 1, bool)
        self.bits[1] = False
        self.bits[2 + np.cumsum(children) + np.arange(len(row))] = False
        self.level = np.searchsorted(self.depth, np.arange(self.depth[-1] + 2))

    def node(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The node of each row's path at a depth."""
        return np.searchsorted(self._places, depth * self.rows + row, "right") - 1

    def parents(self) -> np.ndarray:
        """Of each node, from the bits: zeros before the node's own one, less the first; -1 for the root."""
        return np.cumsum(~self.bits)[self.bits] - 1


def _flat(column: pa.Array, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind)


def _chained(trie: Louds, parent: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """A 128-bit name of each node's path, (nodes, 2)."""
    out = np.zeros((len(parent), 2), np.uint64)
    odd = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
    with np.errstate(over="ignore"):
        for a, b in zip(trie.level[1:-1].tolist(), trie.level[2:].tolist(), strict=True):
            out[a:b] = tx.mix64(out[parent[a:b]] * odd + odd + labels[trie.label[a:b]])
    return out


def _binaries(pairs: np.ndarray, known: np.ndarray) -> pa.Array:
    """Rows of two 64-bit values as binary, null where not known."""
    raw = np.ascontiguousarray(pairs)
    return pa.array([raw[k].tobytes() if yes else None for k, yes in enumerate(known.tolist())], pa.binary())


def shard(paths: pa.Table, whole: bool, keyed: bool) -> Iterator[pa.RecordBatch]:
    """The nodes of sorted paths, and the paths of those that may go on elsewhere (none if ``whole``).

    ``keyed`` tells whether nodes carry their own key.
    """
    columns = {c: paths.column(c).combine_chunks() for c in PATH_COLUMNS}
    size = columns["words"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    labels = np.frombuffer(b"".join(columns["seq"].to_pylist()), "<u8").reshape(-1, 2)
    word = np.append(_flat(columns["words"]), 0)  # the last for the root, whose label is -1
    trie = Louds(labels, ends)
    parent = trie.parents()
    nodes = len(parent)
    # what the paths bring along
    held = columns["n"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), held)
    depth = np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held) + columns["first"].to_numpy()[row]
    at = trie.node(row, depth)
    total = {c: np.zeros(nodes, np.int64) for c in ("n", "kids", "leaves", "saved")}
    for c, t in total.items():
        np.add.at(t, at, _flat(columns[c]))
    n, kids, leaves, saved = total.values()
    low = np.full(nodes, np.iinfo(np.int64).max)
    np.minimum.at(low, at, _flat(columns["low"]))
    named = columns["ends"].flatten()
    ending = np.full(nodes, -1)
    has = np.flatnonzero(pc.is_valid(named).to_numpy(zero_copy_only=False))
    ending[at[has]] = has
    # nodes on the first and the last path stay open
    open_ = np.zeros(nodes, bool)
    sides = []
    if not whole:
        last = len(size) - 1
        sides = [(0, 0)]
        if last:
            shared = int(trie.common[1:].min())
            sides.append((last, min(shared, int(size[0])) + 1))
        sides = [(r, trie.node(np.full(int(size[r]) + 1 - f, r), np.arange(f, int(size[r]) + 1)), f) for r, f in sides]
        for _, on, _ in sides:
            open_[on] = True
    for a, b in zip(trie.level[-2::-1].tolist(), trie.level[:0:-1].tolist(), strict=True):
        v = np.arange(a, b)[~open_[a:b]]
        leaves[v[kids[v] == 0]] = 1
        saved[v] += (n[v] - 1) * word[trie.label[v]]
        if a:
            up = parent[v]
            for t, x in ((n, n[v]), (kids, 1), (leaves, leaves[v]), (saved, saved[v])):
                np.add.at(t, up, x)
            np.minimum.at(low, up, low[v])
    closed = np.flatnonzero(~open_)
    up = parent[closed]
    cut = (up >= 0) & open_[up]
    names = _chained(trie, parent, labels) if keyed or cut.any() else np.zeros((nodes, 2), np.uint64)
    hashes = pc.fill_null(named.take(pa.array(ending[closed], mask=ending[closed] < 0)), NO_IDS)
    node_columns = [
        _binaries(names[closed], np.full(len(closed), keyed)),
        _binaries(names[up], cut),
        pa.array(trie.depth[closed]),
        pa.array(low[closed]),
        pa.array(low[up], mask=cut | (up < 0)),
        *[pa.array(x[closed]) for x in (n, kids, leaves, saved)],
        hashes,
    ]
    yield pa.RecordBatch.from_arrays([*node_columns, *[pa.nulls(len(closed), f.type) for f in _PATH_SCHEMA]], schema=_SCHEMA)
    for r, on, first in sides:
        if not len(on):
            continue
        lists = [pa.array([x[on].tolist()], _LONGS) for x in (n, low, kids, leaves, saved)]
        brought = named.take(pa.array(ending[on], mask=ending[on] < 0)).to_pylist()
        path = [columns["seq"].slice(r, 1), columns["words"].slice(r, 1), pa.array([first]), *lists, pa.array([brought], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in _NODE_SCHEMA], *path], schema=_SCHEMA)


def _shards(whole: bool, keyed: bool, most: int):
    """Sorted paths cut into shards of about ``most`` nodes, one task's paths into one if ``whole``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        nodes = rows = 0
        for batch in batches:
            upto = np.cumsum(batch.column("words").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            i, count = 0, batch.num_rows
            while i < count:
                before = int(upto[i - 1]) if i else 0
                j = max(int(np.searchsorted(upto, before + most - nodes)) + 1, i + LEAST - rows)
                if whole or j > count:
                    held.append(batch.slice(i))
                    nodes, rows = nodes + int(upto[-1]) - before, rows + count - i
                    break
                held.append(batch.slice(i, j - i))
                yield from shard(pa.Table.from_batches(held), whole, keyed)
                held, nodes, rows, i = [], 0, 0, j
        if held:
            yield from shard(pa.Table.from_batches(held), whole, keyed)

    return run


def _named_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, words, n, low, ends) from (class, ids, n, low, seq, words) sorted by class and ids; ids stream through the hash."""
    key, hashed, n, low, row = None, None, 0, 0, None
    schema = pa.schema([("seq", pa.binary()), ("words", pa.list_(pa.int32())), ("n", pa.int64()), ("low", pa.int64()), ("ends", pa.string())])

    def told() -> tuple:
        return row[0], row[1], n, low, hashed.hexdigest()

    for batch in batches:
        done = []
        for c, ids, count, least, seq, words in zip(*(batch.column(x).to_pylist() for x in ("class", "ids", "n", "low", "seq", "words")), strict=True):
            if c != key:
                if key is not None:
                    done.append(told())
                key, hashed, n, low, row = c, hashlib.sha256(ids.encode()), count, least, (seq, words)
            else:
                hashed.update(b"," + ids.encode())
                n, low = n + count, min(low, least)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True) if done else [()] * 5, schema, strict=True)], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(told(), schema, strict=True)], schema=schema)


def rebuilt(turns: DataFrame, tables: Tables, every: int = 20, most: int = 3) -> DataFrame:
    """(conv, seq, words): each conversation behind the first turns of another one, as labels of 16 bytes and counts of words.

    ``turns`` has conv, turn, role and text.  Conversation c starts with the
    first h turns of c - c % every, h being crc32(c in decimal) % (most + 1),
    and goes on with its own turns after its first h.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    label = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    own = turns.select("conv", F.struct("turn", label.alias("label"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")).alias("t"))
    own = own.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own, _ = tables.write(own.select("conv", F.col("t.label").alias("labels"), F.col("t.words").alias("words")))
    base = own.where(F.col("conv") % every == 0).select(F.col("conv").alias("base"), *[F.slice(c, 1, most).alias(f"base_{c}") for c in ("labels", "words")])
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).cast("int")
    both = own.withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % every).join(base, "base", "left")
    joined = {}
    for c in ("labels", "words"):
        kind = dict(own.dtypes)[c]
        head = F.slice(F.coalesce(f"base_{c}", F.array().cast(kind)), F.lit(1), F.col("h"))
        joined[c] = F.concat(head, F.slice(c, F.col("h") + 1, F.size(c)))
    seq = F.unhex(F.array_join(F.transform(joined["labels"], F.hex), ""))
    return both.select("conv", seq.alias("seq"), joined["words"].cast("array<int>").alias("words"))


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", every: int = 20, most: int = 3, nodes: int = NODES) -> DataFrame:
    """The nodes of the trie of rebuilt conversations; see :func:`rebuilt`.

    A node is a distinct sequence of first turns (role and text), the root the
    empty one.  Returns conv_id (the node's smallest member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless
    nodes of its subtree, itself included), saved_tokens (summed over its
    subtree: members but one, times words of the last text) and ends_sha256 (of
    the ids of the members that end there, ascending, in decimal, joined by
    commas; of the empty string if there are none).

    Turns go by turn_col, null first, those of one number by a hash of role and
    text.  Null role or text count as empty.  Rows with a null id are left out.
    Repeated rows are turns of their own.  An empty table gives no rows; other
    columns are ignored.  Texts are hashed where they are read, whatever their
    length; a task holds a conversation's labels, 20 bytes a turn.
    """
    tables = Tables(conversations.sparkSession)
    turns = conversations.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).where("conv is not null")
    whole = rebuilt(turns, tables, every, most).withColumn("class", F.unhex(F.md5("seq")))
    pieces = whole.groupBy("class", F.shiftright("conv", ID_BITS).alias("piece")).agg(
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"),
        F.count("*").alias("n"),
        F.min("conv").alias("low"),
        F.any_value("seq").alias("seq"),
        F.any_value("words").alias("words"),
    )
    pieces = pieces.repartition("class").sortWithinPartitions("class", "piece")
    classes = pieces.mapInArrow(_named_ends, "seq binary, words array<int>, n long, low long, ends string")
    one = {c: F.array(F.col(c)).alias(c) for c in ("n", "low", "ends")}
    none = {c: F.array(F.lit(0).cast("long")).alias(c) for c in ("kids", "leaves", "saved")}
    columns = {"seq": F.col("seq"), "words": F.col("words"), "first": F.size("words").cast("long").alias("first")} | one | none
    paths, at = tables.write(classes.select(*[columns[c] for c in PATH_COLUMNS]))
    found: list[DataFrame] = []
    while True:
        size = paths.agg(F.sum(F.size("words") + 1).alias("nodes"), F.count("*").alias("rows")).first()
        last = (size["nodes"] or 0) <= nodes or size["rows"] <= LEAST
        tasks = max(1, min(MOST_TASKS, (size["nodes"] or 0) // nodes, size["rows"] // LEAST))
        dealt = paths.coalesce(1) if last else paths.repartitionByRange(tasks, "seq")
        out, out_at = tables.write(dealt.sortWithinPartitions("seq").mapInArrow(_shards(last, bool(found), nodes), f"{_NODE}, {_PATH}"))
        found.append(out.where("seq is null").select(*_NODE_SCHEMA.names))
        tables.delete(at)
        if last:
            break
        paths, at = tables.write(out.where("seq is not null").select(*PATH_COLUMNS))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    upper = rows.where("key is not null").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("upper"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = rows.where("parent_key is not null").drop("parent_conv_id").join(upper, "parent_key").withColumnRenamed("upper", "parent_conv_id")
    return rows.where("parent_key is null").select(*names).unionByName(below.select(*names))
