"""Histograms of tokens: counts, entropy bounds, distances, code lengths and clusters."""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselark.operators.running import checkpointed


#: Classes of the character before, from 1 on: white space, small letters, capitals, digits, others (0 is a text's start).
CLASSES = (" \n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
#: Characters that are looked at together.
TOGETHER = 1 << 20


def _class_table() -> np.ndarray:
    out = np.full(129, len(CLASSES) + 1, np.int64)  # the last place stands for all beyond ASCII
    for k, members in enumerate(CLASSES, 1):
        out[[ord(c) for c in members]] = k
    return out


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context, value, n) of some texts' characters; a text of any length goes through in pieces."""
    table = _class_table()

    def counted(pieces: list[str], before: list[int]) -> pa.RecordBatch:
        size = np.array([len(p) for p in pieces])
        code = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4").astype(np.int64)
        context = table[np.minimum(np.roll(code, 1), 128)]
        context[(np.cumsum(size) - size)] = before
        kinds, n = np.unique(context << 32 | code, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(kinds >> 32), pa.array(kinds & 0xFFFFFFFF), pa.array(n)], ["context", "value", "n"])

    for batch in batches:
        pieces, before, held = [], [], 0
        for text in batch.column(0):
            text = text.as_py() or ""
            for at in range(0, len(text), TOGETHER):
                pieces.append(text[at : at + TOGETHER])
                before.append(int(table[min(ord(text[at - 1]), 128)]) if at else 0)
                held += len(pieces[-1])
                if held >= TOGETHER:
                    yield counted(pieces, before)
                    pieces, before, held = [], [], 0
        if pieces:
            yield counted(pieces, before)


def characters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as token streams: (context, value, n) with context the class of the character before.

    A value is a code point.  Each task counts pairs where it reads the texts,
    so only counts move.  Null and empty texts have no characters.
    """
    counts = docs.select(text_col).mapInArrow(_pair_counts, "context long, value long, n long")
    return counts.groupBy("context", "value").agg(F.sum("n").alias("n"))


def clustered(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts of (cluster, value) under a context map (one row for each context); Spark broadcasts it if it is small."""
    return counts.join(mapping, "context").groupBy("cluster", "value").agg(F.sum("n").alias("n"))


def shannon(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy bound of each histogram in bits."""
    w = Window.partitionBy(*keys)
    p = counts.withColumn("total", F.sum("n").over(w))
    return p.groupBy(*keys).agg(F.sum(-F.col("n") * F.log2(F.col("n") / F.col("total"))).alias("bits"), F.max("total").alias("total"), F.count("*").alias("symbols"))


def shannon_floor(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The same bound in whole bits, rounded down (from six places, as sums depend on their order)."""
    s = shannon(counts, keys)
    return s.select(*keys, F.floor(F.round("bits", 6)).cast("long").alias("bits"))


def shape_distances(counts: DataFrame, key: str) -> DataFrame:
    """Normalised L1 distance times the smaller total, of every two histograms.

    sum |a - b| = sum a + sum b - 2 sum min(a, b), so only symbols that both
    have meet in the join; histograms without a common symbol are 2 apart.  The
    list of histograms (contexts, not data) is small enough for one row.
    """
    total = counts.groupBy(key).agg(F.sum("n").alias("total"))
    p = counts.join(total, key).select(F.col(key).alias("k"), "value", (F.col("n") / F.col("total")).alias("p"))
    a, b = p.alias("a"), p.alias("b")
    common = a.join(b, (F.col("a.value") == F.col("b.value")) & (F.col("a.k") < F.col("b.k")))
    common = common.groupBy(F.col("a.k").alias("left"), F.col("b.k").alias("right")).agg(F.sum(F.least("a.p", "b.p")).alias("common"))
    every = total.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "total"))).alias("all"))
    pairs = every.select("all", F.posexplode("all").alias("i", "l")).select("i", "l", F.posexplode("all").alias("j", "r")).where("i < j")
    pairs = pairs.select(F.col("l.k").alias("left"), F.col("r.k").alias("right"), F.least("l.total", "r.total").alias("least"))
    out = pairs.join(common, ["left", "right"], "left")
    return out.select("left", "right", ((2 - 2 * F.coalesce("common", F.lit(0.0))) * F.col("least")).alias("distance"))


def code_lengths(counts: list[int], most: int = 15) -> list[int]:
    """Lengths of a Huffman code; counts are raised until no length is above ``most``."""
    used = [i for i, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(used) < 2:
        for i in used:
            out[i] = 1
        return out
    floor = 1
    while True:
        heap = [(max(counts[i], floor), k, (i,)) for k, i in enumerate(used)]
        heapq.heapify(heap)
        depth, tie = dict.fromkeys(used, 0), len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in a[2] + b[2]:
                depth[i] += 1
            heapq.heappush(heap, (a[0] + b[0], tie, a[2] + b[2]))
            tie += 1
        if max(depth.values()) <= most:
            for i, d in depth.items():
                out[i] = d
            return out
        floor *= 2


def bit_cost(counts: list[int]) -> int:
    """Bits of a histogram under its own prefix code; nothing for a single symbol."""
    if sum(c > 0 for c in counts) < 2:
        return 0
    return sum(c * d for c, d in zip(counts, code_lengths(counts), strict=True))


def prefix_costs(counts: DataFrame, key: str, alphabet: int = 256) -> DataFrame:
    """Prefix-code bits of each histogram (at most ``alphabet`` symbols to a group)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        row = [0] * alphabet
        for v, n in zip(frame["value"], frame["n"], strict=True):
            row[int(v)] += int(n)
        return pd.DataFrame({key: [frame[key].iloc[0]], "bits": [bit_cost(row)]})

    return counts.groupBy(key).applyInPandas(run, f"{key} {dict(counts.dtypes)[key]}, bits long")


def cluster_histograms(counts: DataFrame, key: str, most: int = 8, least_gain: float = 64.0, alphabet: int = 256) -> DataFrame:
    """(key, cluster): farthest-first seeds from the largest histogram, then each to its nearest seed.

    A histogram is one row of at most ``alphabet`` counts.  Each round compares
    all rows with the seeds so far (at most ``most``) where the rows are, and
    only the farthest one reaches the driver.  Ties go to the smaller key and to
    the earlier seed.
    """
    rows = checkpointed(counts.groupBy(key).agg(F.sum("n").alias("total"), F.collect_list(F.struct(F.col("value").cast("int").alias("value"), "n")).alias("h")))
    kind = dict(counts.dtypes)[key]

    def dense(h) -> list[int]:
        row = [0] * alphabet
        for r in h:
            row[int(r["value"])] += int(r["n"])
        return row

    def assigned(seeds: list) -> DataFrame:
        names, own = [k for k, _ in seeds], [(h, bit_cost(h)) for _, h in seeds]

        def run(frames):
            for frame in frames:
                near, cluster = [], []
                for k, h in zip(frame[key], map(dense, frame["h"]), strict=True):
                    cost = bit_cost(h)
                    gaps = [bit_cost([x + y for x, y in zip(h, s, strict=True)]) - cost - c for s, c in own]
                    best = names.index(k) if k in names else min(range(len(gaps)), key=gaps.__getitem__)
                    near.append(-1.0 if k in names else float(gaps[best]))
                    cluster.append(best)
                yield pd.DataFrame({key: frame[key], "near": near, "cluster": cluster})

        return rows.select(key, "h").mapInPandas(run, f"{key} {kind}, near double, cluster int")

    first = rows.orderBy(F.desc("total"), key).first()
    seeds = [(first[key], dense(first["h"]))] if first else []
    while seeds and len(seeds) < most:
        far = assigned(seeds).orderBy(F.desc("near"), key).first()
        if far["near"] < least_gain:
            break
        seeds.append((far[key], dense(rows.where(F.col(key) == F.lit(far[key])).first()["h"])))
    return assigned(seeds).select(key, "cluster")


def merge_smallest(cells: list[int], want: int, most: int = 4096) -> list[int]:
    """Labels of cells after merging the least populated two, again and again, until ``want`` are left.

    The merges follow one another, so they are done in one place; more than
    ``most`` cells are an error.
    """
    if len(cells) > most:
        raise ValueError(f"{len(cells)} cells; at most {most} can be merged")
    n, into = list(cells), list(range(len(cells)))
    alive = sorted(into, key=lambda c: -n[c])
    while len(alive) > want:
        gone, kept = alive.pop(), alive.pop()
        n[kept] += n[gone]
        into[gone] = kept
        insort(alive, kept, key=lambda c: -n[c])  # behind those that hold as many
    labels: dict[int, int] = {}

    def root(c: int) -> int:
        while into[c] != c:
            c = into[c]
        return c

    return [labels.setdefault(root(c), len(labels)) for c in range(len(cells))]
