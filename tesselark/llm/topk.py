"""Exact top-k inner products by Fagin's threshold algorithm over per-dimension lists.

Candidates are dealt into blocks and queries into groups; a task has one of
each.  It sorts its block's vectors once along every dimension, and the queries
stream past the lists.  A query walks them from the end its component favours,
scores the vectors it meets, and stops when the sum of what the lists can still
offer is below its k-th score so far: no vector left can then be among the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselark.llm.shared import Tables

#: Vectors in a block of candidates, queries in a group, and queries answered at a time.
BLOCK, QUERIES, TOGETHER = 8192, 16384, 512


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component as long; null if the vector is null or a component is null or not finite.

    A finite component whose product does not fit a long is an error.
    """
    x = F.transform(vector, lambda v: v.cast("double"))
    good = vector.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fits = lambda v: (v * factor >= -float(1 << 63)) & (v * factor < float(1 << 63))
    wide = F.raise_error(F.lit(f"a component times {factor} does not fit a long")).cast("long")
    return F.when(good, F.transform(x, lambda v: F.when(fits(v), F.floor(v * factor).cast("long")).otherwise(wide)))


class Lists:
    """A block's vectors, sorted along every dimension."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        n, d = vectors.shape
        self.vectors, self.ids = vectors, ids
        self.order = np.argsort(vectors, 0, kind="stable") if n else np.zeros((0, d), np.int64)
        self.values = np.take_along_axis(vectors, self.order, 0)


def threshold_top(lists: Lists, queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the (ids, scores) of its k best in this block, ties to smaller ids.

    A vector is not a candidate of a query with its own id.  Depth doubles from
    a first step; newly met vectors are scored together.
    """
    vectors, ids, order, sorted_values = lists.vectors, lists.ids, lists.order, lists.values
    n, d = vectors.shape
    # sums below 2**53 are exact in double precision; else in Python-sized steps of int64
    largest = max(1, d)
    for a in (vectors, queries):
        largest *= max(int(a.max(initial=0)), -int(a.min(initial=0)))
    exact = np.float64 if largest < 2**53 else (np.int64 if largest < 2**63 else object)
    table, asked = vectors.astype(exact), queries.astype(exact)
    found = []
    for q, own in zip(asked, query_ids, strict=True):
        met = np.zeros(n, bool)
        best_ids, best = ids[:0], table[:0, 0] if d else np.zeros(0, exact)
        used = np.flatnonzero(q != 0)
        depth, step = 0, max(1, n // 64)
        while depth < n:
            to = min(n, depth + step)
            if len(used) == 0:
                to = n
                new = np.arange(n)
            else:
                up, down = used[q[used] > 0], used[q[used] < 0]
                new = np.concatenate([order[n - to : n - depth][:, up].ravel(), order[depth:to][:, down].ravel()])
            fresh = np.zeros(n, bool)
            fresh[new] = True
            fresh &= ~met
            met |= fresh
            at = np.flatnonzero(fresh)
            at = at[ids[at] != own]
            scores = table[at] @ q
            if len(best) >= k:
                at, scores = at[scores >= best[-1]], scores[scores >= best[-1]]
            all_ids, all_scores = np.concatenate([best_ids, ids[at]]), np.concatenate([best, scores])
            if exact is object:
                top = np.array(sorted(range(len(all_ids)), key=lambda i: (-all_scores[i], all_ids[i]))[:k], np.int64)
            else:
                top = np.lexsort((all_ids, -all_scores))[:k]
            best_ids, best = all_ids[top], all_scores[top]
            depth, step = to, step * 2
            if depth < n and len(best) >= k:
                edge = np.where(q > 0, sorted_values[n - depth - 1], sorted_values[depth]).astype(exact)
                if edge @ q < best[-1]:
                    break
        found.append((best_ids, best))
    return found


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """The k highest integer inner products of each query row with all other rows.

    Components become floor(factor * x).  Rows whose id or vector is null, or
    whose vector holds a null or non-finite component, take no part; a component
    or a score among the best that does not fit a long is an error.  Vectors of
    different lengths are compared within their length only.  Rows that share
    an id are one another's own row.  Returns query_id, rank (from 1), id_col
    and score; ties go to the smaller id; a query with fewer candidates returns
    them all.  Of query rows that share an id the one with the least vector asks
    (the shorter first), and gets one answer.  An empty table gives no rows;
    other columns are ignored.

    A block of candidates has about ``block`` rows, dealt by their place in the
    written table, so no id can gather; it is copied once for ``queries`` queries.
    """
    tables = Tables(rows.sparkSession)
    own = rows.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col), factor).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    own, _ = tables.write(own.where("id is not null and v is not null"))
    count = own.agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("asked"), F.col("id"))).alias("q")).first()
    blocks, parts = max(1, -(-count["n"] // block)), max(1, -(-count["q"] // queries))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
    candidates = own.select(F.size("v").alias("d"), place.alias("block"), every(parts).alias("part"), F.lit(False).alias("asks"), "id", "v")
    asked = own.where("asked").groupBy("id").agg(F.min(F.struct(F.size("v").alias("d"), "v")).alias("q"))
    asked = asked.select("q.d", every(blocks).alias("block"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.lit(True).alias("asks"), "id", "q.v")
    key = ["d", "block", "part"]
    dealt = candidates.unionByName(asked).repartition(*key).sortWithinPartitions(*key, "asks", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, lists = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*key, "asks")], 1)
            ids = batch.column("id").to_numpy()
            edges = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)], strict=True):
                *own_key, asks = marks[i].tolist()
                if own_key != now:
                    now, held, lists = own_key, [], None
                v = batch.column("v").slice(i, j - i).flatten().to_numpy(zero_copy_only=False).reshape(j - i, own_key[0])
                if not asks:
                    held.append((v, ids[i:j]))
                    continue
                if not held:
                    continue
                lists = lists or Lists(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                for a in range(0, j - i, TOGETHER):
                    query_ids = ids[i + a : min(j, i + a + TOGETHER)]
                    found = threshold_top(lists, v[a : a + TOGETHER], query_ids, k)
                    frame = pd.DataFrame({"query_id": np.repeat(query_ids, [len(x) for x, _ in found]), "id": np.concatenate([x for x, _ in found]), "score": np.concatenate([s for _, s in found]).astype(np.int64)})
                    yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    found = dealt.mapInArrow(run, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
