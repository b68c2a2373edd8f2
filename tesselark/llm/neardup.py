"""Near-duplicate classes by a multi-index Hamming join of b-bit MinHash signatures.

A text's set is its distinct word shingles.  Its signature has CHUNKS * WIDTH
MinHash values of 8 bits.  Split into CHUNKS chunks, two signatures that differ
in at most ``CHUNKS * (ERRORS + 1) - 1`` values have, by pigeonhole, a chunk in
which at most ERRORS values differ.  With ERRORS = 1 the allowed errors of a
chunk are enumerated by leaving out each of its values in turn, so every such
pair meets in the bucket of an equal (chunk, place left out, other values): 56
bits, kept exactly in one long.  At Jaccard 0.8 a pair of signatures misses all
buckets with probability (1 - P[Bin(7, 0.2) <= 1]) ** 16, about 1e-6.

Pairs inside a bucket are not formed.  Equal sets collapse to one
representative first.  A bucket's hub is its smallest member; the members of
all buckets with one hub are its group, so two texts that share a bucket share a
group.  A text is compared with the least of its hubs first, then with those
hubs that its links have not joined it to.  Groups whose members are then one
component are settled; in the others every member outside the group's largest
component meets the members of about its own size in blocks.  In a block
everything is counted as a difference from one of its sets: two sets of which
one is not linked with that set can be linked only if they share a difference,
so an index of differences finds all links and texts on one template, which
share little else, make few candidates.  Every link is confirmed on the full
shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.llm import text as tx
from tesselark.llm.shared import Tables

CHUNKS, WIDTH, ERRORS = 16, 7, 1
VALUES = CHUNKS * WIDTH
#: Shingles in a block of texts that are compared with one another.
BLOCK_SHINGLES = 250_000
#: Texts whose bucket keys are sorted together before they leave a task.
TOGETHER = 8192


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct 64-bit shingle hashes.

    A text with fewer words has its whole word sequence as its one shingle; a
    text without words has none.
    """
    data = tx.lowered(data)
    starts, stops, owner = tx.words_of(data, ends)
    h = tx.span_hashes(data, starts, stops)
    n = len(ends) - 1
    first = np.searchsorted(owner, np.arange(n + 1))
    with np.errstate(over="ignore"):
        salts = tx.mix64(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
        run = max(0, len(h) - words + 1)
        whole = np.zeros(run, np.uint64)
        for k in range(words):
            whole += h[k : k + run] * salts[k]
        whole = tx.mix64(whole)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(whole[a : b - words + 1])
            elif b > a:
                yield tx.mix64((h[a:b] * salts[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)).reshape(1)
            else:
                yield whole[:0]


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        x = tx.mix64(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    return x[:VALUES].astype(np.uint32) | np.uint32(1), x[VALUES:].astype(np.uint32)


_MUL, _ADD = _multipliers()


def signature(shingles: np.ndarray) -> np.ndarray:
    """VALUES 8-bit MinHash values of a set."""
    with np.errstate(over="ignore"):
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 2048):
            np.minimum(least, (x[i : i + 2048, None] * _MUL + _ADD).min(0), out=least)
        mixed = least * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA77)
    return (mixed >> np.uint32(24)).astype(np.uint8)


def _summaries(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = tx.texts_of(batch.column(1)), batch.column(0)
            for i, j in tx.steps(texts):
                size, key, sig = [], [], []
                for s in shingle_sets(*tx.bytes_of(texts.slice(i, j - i)), words):
                    size.append(len(s))
                    key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sig.append(signature(s).tobytes())
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["id", "n", "set_key", "sig"])

    return run


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    """(text, VALUES) keys: one for each chunk and each value left out of it."""
    sig = sig.reshape(-1, CHUNKS, WIDTH).astype(np.int64)
    keys = np.empty(sig.shape, np.int64)
    for out in range(WIDTH):
        k = np.zeros(sig.shape[:2], np.int64)
        for p in range(WIDTH):
            if p != out:
                k = (k << 8) | sig[:, :, p]
        keys[:, :, out] = k | ((np.arange(CHUNKS, dtype=np.int64)[None] * WIDTH + out) << 48)
    return keys.reshape(-1, VALUES)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each value of sorted ``keys`` has its run's first place."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return np.repeat(at, np.diff(np.append(at, len(keys))))


def _packed(together: int):
    """Blocks of texts, ascending, whose buckets are looked at together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, together):
                ids = batch.column(0).slice(i, together)
                order = pc.sort_indices(ids)
                sigs = b"".join(batch.column(1).slice(i, together).take(order).to_pylist())
                ids = ids.take(order)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([sigs], pa.binary())], ["ids", "sigs"])

    return run


def _bucket_rows(leads: bool):
    """(key, id) for each bucket of a block and its smallest member there, or (key, lead, id) for the other members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column(0).slice(r, 1).flatten()
                keys = bucket_keys(np.frombuffer(batch.column(1)[r].as_buffer(), np.uint8)).ravel()
                owner = np.repeat(np.arange(len(ids)), VALUES)
                by = np.argsort(keys, kind="stable")  # of equal keys the smaller id comes first
                keys, owner = keys[by], owner[by]
                first = _runs(keys)
                lead = first == np.arange(len(keys))
                if leads:
                    yield pa.RecordBatch.from_arrays([pa.array(keys[lead]), ids.take(pa.array(owner[lead]))], ["key", "id"])
                else:
                    columns = [pa.array(keys[~lead]), ids.take(pa.array(owner[first[~lead]])), ids.take(pa.array(owner[~lead]))]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "lead", "id"])

    return run


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, hub, lead) of leads that are not their bucket's hub, from (key, id) rows sorted by both."""
    key = hub = None
    for batch in batches:
        ids = batch.column(1)
        if not len(ids):
            continue
        keys = batch.column(0).to_numpy()
        hubs = ids.take(pa.array(_runs(keys)))
        if key is not None and keys[0] == key:  # the bucket began in the batch before
            goes_on = int(np.searchsorted(keys != key, True)) if (keys != key).any() else len(keys)
            hubs = pa.concat_arrays([pa.array([hub] * goes_on, ids.type), hubs.slice(goes_on)])
        key, hub = int(keys[-1]), hubs[-1].as_py()
        apart = pc.not_equal(hubs, ids)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(apart), hubs.filter(apart), ids.filter(apart)], ["key", "hub", "lead"])


def _meet(sets: list[np.ndarray], percent: int, part: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links of the texts ``of`` with texts of other parts, one for each part.

    A link makes one part of two, so the parts shrink as it goes.  Let H be the
    first set and a set's differences what it has beyond H and what it lacks of
    H.  Then |a & b| is |H| less what a lacks, less what b lacks, plus the
    differences they share; and for b not linked with H it takes at least one
    shared difference to link a and b.  Sets linked with H are one part.  Where
    the sets have little in common with H, all of their shingles are indexed
    instead, as differences from an empty set.
    """
    size = np.array([len(s) for s in sets])
    first = np.cumsum(size) - size
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    base = codes[: size[0]]
    in_base = np.zeros(codes.max() + 1, bool)
    in_base[base] = True
    held = in_base[codes]
    shared = np.add.reduceat(held.astype(np.int64), first)
    lacks = np.zeros(len(sets), np.int64)
    whole = 0
    if (size[0] - shared).sum() < shared.sum():
        near = np.flatnonzero((100 * shared >= percent * (size[0] + size - shared)) & (part != part[0]))
        near = near[np.unique(part[near], return_index=True)[1]]
        for b in near.tolist():
            yield 0, b
        if len(near):
            part[np.isin(part, part[near])] = part[0]
        lacks, whole = size[0] - shared, int(size[0])
        tokens = []
        for k in range(len(sets)):
            own, has = codes[first[k] : first[k] + size[k]], held[first[k] : first[k] + size[k]]
            gone = in_base.copy() if lacks[k] else None
            if gone is not None:
                gone[own] = False
                tokens.append(np.concatenate([own[~has], np.flatnonzero(gone) if lacks[k] * 8 > len(base) else base[gone[base]]]))
            else:
                tokens.append(own[~has])
        count = np.array([len(t) for t in tokens])
        codes = np.concatenate(tokens)
    else:
        count = size
    start = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(sets)), count)
    holders = owner[np.argsort(codes, kind="stable")]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=1))])
    for a in of.tolist():
        c = codes[start[a] : start[a] + count[a]]
        n = bounds[c + 1] - bounds[c]
        at = np.arange(n.sum()) + np.repeat(bounds[c] - (np.cumsum(n) - n), n)
        met, common = np.unique(holders[at], return_counts=True)
        common = common + (whole - lacks[a] - lacks[met] if whole else 0)
        hits = met[(100 * common >= percent * (size[a] + size[met] - common)) & (part[met] != part[a])]
        hits = hits[np.unique(part[hits], return_index=True)[1]]
        for b in hits.tolist():
            yield a, b
        if len(hits):
            part[np.isin(part, part[hits])] = part[a]


def _groups(words: int, read: list[str], work):
    """A task over rows sorted by the columns ``read`` (all but id and text, the last two), one group of equal ones at a time.

    Only a group's sets are held; rows that repeat the one before are skipped.
    ``work`` gets the ids, the sets and the last of the ``read`` columns of the rows.
    """
    group_columns = len(read) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets, marks, found = None, [], [], [], []
        kind = None
        for batch in batches:
            kind = batch.schema.field(len(read)).type
            names = list(zip(*(batch.column(k).to_pylist() for k in range(group_columns)), strict=True))
            mark, own = batch.column(group_columns).to_pylist(), batch.column(len(read)).to_pylist()
            texts = tx.texts_of(batch.column(len(read) + 1))
            for i, j in tx.steps(texts):
                for r, s in enumerate(shingle_sets(*tx.bytes_of(texts.slice(i, j - i)), words), i):
                    if names[r] != group:
                        found += work(ids, sets, marks)
                        group, ids, sets, marks = names[r], [], [], []
                    if len(s) and not (ids and ids[-1] == own[r] and np.array_equal(sets[-1], s)):
                        ids.append(own[r])
                        sets.append(s)
                        marks.append(mark[r])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], kind), pa.array([y for _, y in found], kind)], ["a", "b"])
            found = []
        found += work(ids, sets, marks)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], kind), pa.array([y for _, y in found], kind)], ["a", "b"])

    return run


def _around_hub(percent: int):
    """Links of a block whose first row is the hub."""

    def work(ids: list, sets: list[np.ndarray], _: list) -> list[tuple]:
        if len(ids) < 2:
            return []
        size = np.array([len(s) for s in sets[1:]])
        held = np.isin(np.concatenate(sets[1:]), sets[0])
        common = np.add.reduceat(held.astype(np.int64), np.cumsum(size) - size)
        near = 100 * common >= percent * (len(sets[0]) + size - common)
        out = [(ids[0], ids[k + 1]) for k in np.flatnonzero(near).tolist()]
        apart = np.flatnonzero(~near) + 1
        if len(apart) and len(ids) > 2:
            part = np.zeros(len(ids), np.int64)
            part[apart] = apart
            out += [(ids[a], ids[b]) for a, b in _meet(sets, percent, part, apart)]
        return out

    return work


def _between_parts(percent: int):
    """Links of marked rows (component, whether it is to be compared) with rows of other components."""

    def work(ids: list, sets: list[np.ndarray], marks: list) -> list[tuple]:
        if len(ids) < 2:
            return []
        names = {c: k for k, c in enumerate(dict.fromkeys(m["component"] for m in marks))}
        part = np.array([names[m["component"]] for m in marks])
        return [(ids[a], ids[b]) for a, b in _meet(sets, percent, part, np.flatnonzero([m["asks"] for m in marks]))]

    return work


def components(links: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(id, component) of each node that has a link; component is its smallest id.

    ``links`` has columns a and b.  In each round every node links all its
    neighbours and itself to the smallest of them (a grouped minimum and a
    join), until every link points at a smallest id.  Rounds grow with the
    logarithm of the longest path.  The minima are a table of their own, one row
    a node, so a node with very many links is a skewed join of two shuffles,
    which Spark splits.  The end is counted exactly: no node is left that links
    to two smaller ones, or to a smaller and a larger one.
    """
    tables = tables or Tables(links.sparkSession)
    links, at = tables.write(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        below, above = F.count_if(F.col("b") < F.col("a")), F.count_if(F.col("b") > F.col("a"))
        least, least_at = tables.write(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), ((below > 1) | ((below == 1) & (above > 0))).alias("open")))
        if least.where("open").isEmpty():
            tables.delete(least_at)
            return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(links.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component")))
        moved = both.join(least.select("a", "m"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        links, new_at = tables.write(moved)
        tables.delete(at, least_at)
        at = new_at


def _candidates(classes: DataFrame, kind: str, tables: Tables) -> tuple[DataFrame, str]:
    """(hub, id) for each text and the smallest text of each of its buckets, once each.

    Buckets are found in blocks of TOGETHER texts first.  The blocks' leads meet
    by key; the other members follow their lead's bucket, by key and lead, so a
    bucket that many texts share gathers a row a block and never its members.
    """
    packed, packed_at = tables.write(classes.select("id", "sig").mapInArrow(_packed(TOGETHER), f"ids array<{kind}>, sigs binary"))
    leads = packed.mapInArrow(_bucket_rows(True), f"key long, id {kind}").repartition("key").sortWithinPartitions("key", "id")
    moved, moved_at = tables.write(leads.mapInArrow(_hubs, f"key long, hub {kind}, lead {kind}"))
    members = packed.mapInArrow(_bucket_rows(False), f"key long, lead {kind}, id {kind}")
    follow = members.join(moved, ["key", "lead"], "left").select(F.coalesce("hub", "lead").alias("hub"), "id")
    edges = tables.write(moved.select("hub", F.col("lead").alias("id")).unionByName(follow).where("hub <> id").distinct())
    tables.delete(packed_at, moved_at)
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Class of near-duplicate texts for each row.

    Two texts are linked when ``100 * |A & B| >= percent * |A | B|`` for their
    distinct ``words``-word shingles (A-Z in lower case; words are runs of
    characters other than space and U+0009-U+000D).

    Returns id_col, n_shingles, component_id (the smallest id reachable by
    links) and kept (the id is its component's).  A null text counts as empty;
    texts without words have no shingle and are linked with nothing.  Rows with
    a null id are returned, unlinked and kept.  Rows that share an id are one
    node.  An empty table gives an empty one.  A text is read whole, whatever
    its length: hashing takes it a few megabytes at a time, and a task holds its
    words' hashes.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(own.dtypes)["id"]
    made, _ = tables.write(own.mapInArrow(_summaries(words), f"id {kind}, n long, set_key binary, sig binary"))
    classes, _ = tables.write(made.where("n > 0 and id is not null").groupBy("set_key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    edges, edges_at = _candidates(classes, kind, tables)
    known = own.where("id is not null")
    sizes = classes.groupBy("id").agg(F.max("n").alias("n"))

    def around(groups: DataFrame) -> tuple[DataFrame, str]:
        """Links of the members of (hub, id) with their hub and with one another, in blocks of bounded size with the hub in each."""
        blocks, blocks_at = tables.write(groups.join(sizes, "id").groupBy("hub").agg(F.ceil(F.sum("n") / block_shingles).alias("blocks")))
        dealt = groups.join(blocks, "hub").select("hub", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.lit(True).alias("member"), "id")
        hubs = blocks.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("member"), F.col("hub").alias("id"))
        texts = known.join(dealt.unionByName(hubs), "id").select("hub", "block", "member", "id", "text")
        texts = texts.repartition("hub", "block").sortWithinPartitions("hub", "block", "member", "id")
        links = tables.write(texts.mapInArrow(_groups(words, ["hub", "block", "member"], _around_hub(percent)), f"a {kind}, b {kind}").distinct())
        tables.delete(blocks_at)
        return links

    def with_components(found: DataFrame) -> DataFrame:
        """The candidates with the component of each id."""
        return edges.join(found, "id", "left").select("hub", "id", F.coalesce("component", "id").alias("component"))

    # every text and its least hub
    links, _ = around(edges.groupBy("id").agg(F.min("hub").alias("hub")).select("hub", "id"))
    found, _ = tables.write(components(links, tables))

    # members that no link has joined to a hub of theirs
    of_hub = with_components(found).groupBy("hub").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    of_hub = of_hub.join(found.select(F.col("id").alias("hub"), F.col("component").alias("own")), "hub", "left").withColumn("own", F.coalesce("own", "hub"))
    apart = with_components(found).join(of_hub.where("least <> own or most <> own").select("hub", "own"), "hub").where("component <> own").select("hub", "id")
    apart, apart_at = tables.write(apart)
    if not apart.isEmpty():
        more, _ = around(apart)
        if not more.isEmpty():
            links = links.unionByName(more)
            found, _ = tables.write(components(links, tables))

    # groups whose members are not one component yet
    parts = with_components(found).groupBy("hub", "component").agg(F.count("*").alias("c"))
    usual = parts.groupBy("hub").agg(F.max_by("component", F.struct("c", "component")).alias("usual"), F.count("*").alias("parts")).where("parts > 1")
    # sets whose sizes differ by more than the threshold allows can't be linked, so a text meets its own step of sizes and the two beside
    step = F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("int") if percent < 100 else F.lit(0)
    members = with_components(found).join(usual.select("hub", "usual"), "hub").join(sizes, "id")
    left, left_at = tables.write(members.select("hub", "id", "n", "component", step.alias("step"), (F.col("component") != F.col("usual")).alias("asks")))
    if not left.isEmpty():
        count = left.groupBy("hub", "step").agg(F.ceil(F.sum("n") / block_shingles).alias("blocks"), F.ceil(F.sum(F.when(F.col("asks"), F.col("n"))) / block_shingles).alias("askers"))
        spread = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n))
        near = lambda c: F.explode(F.array(*[F.col(c) + d for d in ((-1, 0, 1) if percent < 100 else (0,))]))
        asking = left.where("asks").join(count.select("hub", "step", "askers"), ["hub", "step"]).withColumn("part", spread(2, "askers"))
        asking = asking.select("hub", F.col("step").alias("from"), "part", "id", "component", near("step").alias("step"))
        asking = asking.join(count.select("hub", "step", "blocks"), ["hub", "step"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        asked = left.join(count.select("hub", "step", "blocks"), ["hub", "step"]).withColumn("block", spread(1, "blocks"))
        meeting = count.where("askers > 0").select("hub", F.col("step").alias("from"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("askers") - 1)).alias("part"), near("step").alias("step"))
        asked = asked.join(meeting, ["hub", "step"])
        columns = ["hub", "step", "block", "from", "part"]
        mark = lambda df, yes: df.select(*columns, F.struct("component", F.lit(yes).alias("asks")).alias("mark"), "id")
        late = known.join(mark(asking, True).unionByName(mark(asked, False)), "id").select(*columns, "mark", "id", "text")
        # where a text asks and is asked, the first of its rows counts
        late = late.repartition(*columns).sortWithinPartitions(*columns, "id", F.desc("mark.asks"))
        late, late_at = tables.write(late.mapInArrow(_groups(words, [*columns, "mark"], _between_parts(percent)), f"a {kind}, b {kind}").distinct())
        if not late.isEmpty():
            found, _ = tables.write(components(links.unionByName(late), tables))
        tables.delete(late_at)
    tables.delete(edges_at, apart_at, left_at)

    of_class = classes.join(found, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))
    linked = made.where("n > 0 and id is not null").select("id", "n", "set_key").join(of_class, "set_key", "left")
    linked = linked.select("id", "n", F.least("component", "id").alias("component"))
    alone = made.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    out = linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
