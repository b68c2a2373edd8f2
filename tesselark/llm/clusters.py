"""Exact k-means on integer vectors by Lloyd's rounds over what has changed.

The vectors are written once, in blocks, bucketed by the block's number.  The
assignments (owner and squared distance of each vector) are a small table of
their own with the same buckets, so a round joins both without a shuffle and
writes only assignments.  A vector whose owner's centroid has stayed where it
was is compared with the centroids that changed, any other with all of them.
What a block's vectors take from one cluster to another leaves as signed integer
sums and counts; the driver holds the global sums, k rows, and adds them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tesselark.llm.shared import Tables
from tesselark.llm.topk import scaled

#: Vectors in a block, about as many in a bucket (a task), and the most buckets there are.
BLOCK, BUCKET, MOST_BUCKETS = 1024, 65536, 10_000
#: Components are below this in magnitude, so a squared distance of 64 of them fits a long.
WIDEST = 1 << 27


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors, centroids)."""
    if not len(centroids) or not len(vectors):
        return np.zeros((len(vectors), len(centroids)), np.int64)
    largest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if vectors.shape[1] * (2 * largest) ** 2 < 2**53:  # whole numbers that double precision holds
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1)


def reassigned(vectors: np.ndarray, owner: np.ndarray | None, near: np.ndarray | None, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, squared distance) after the centroids marked ``changed`` took their present values.

    Of equal distances the smaller number wins.
    """
    if owner is None:
        d = distances(vectors, centroids)
        owner = d.argmin(1)
        return owner, d[np.arange(len(d)), owner]
    owner, near = owner.copy(), near.copy()
    lost = changed[owner]
    owner[lost], near[lost] = reassigned(vectors[lost], None, None, centroids, changed)
    rest, new = np.flatnonzero(~lost), np.flatnonzero(changed)
    if len(rest) and len(new):
        d = distances(vectors[rest], centroids[new])
        least = d.argmin(1)
        d, to = d[np.arange(len(d)), least], new[least]
        won = (d < near[rest]) | ((d == near[rest]) & (to < owner[rest]))
        owner[rest[won]], near[rest[won]] = to[won], d[won]
    return owner, near


def transfers(vectors: np.ndarray, was: np.ndarray | None, now: np.ndarray, k: int) -> list[dict] | None:
    """Signed counts and sums of the clusters that vectors left or joined; None if none moved."""
    n, sums = np.zeros(k, np.int64), np.zeros((k, vectors.shape[1]), np.int64)
    moved = np.arange(len(now)) if was is None else np.flatnonzero(was != now)
    if not len(moved):
        return None
    for to, sign in ((now, 1), (was, -1)):
        if to is not None:
            np.add.at(n, to[moved], sign)
            np.add.at(sums, to[moved], sign * vectors[moved])
    return [{"cluster": c, "n": int(n[c]), "sums": sums[c].tolist()} for c in np.flatnonzero((n != 0) | sums.any(1)).tolist()]


def _blocks(ids_type: pa.DataType):
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(ids_type)), ("vectors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False)
                if len(v) and np.abs(v).max() >= WIDEST:
                    raise ValueError(f"a component of {WIDEST} or more: squared distances may not fit a long")
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([made]), ids, pa.array([v.astype("<i4").tobytes()], pa.binary())], schema=schema)
                made += 1

    return run


_ASSIGNED = "block long, owner binary, near binary, moves array<struct<cluster: int, n: long, sums: array<long>>>"
_MOVES = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))


def _vectors(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4").reshape(-1, dim).astype(np.int64)


def _round(centroids: np.ndarray, changed: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            old = batch.schema.get_field_index("owner") >= 0
            for r in range(batch.num_rows):
                v = _vectors(batch.column("vectors")[r].as_buffer(), centroids.shape[1])
                was = np.frombuffer(batch.column("owner")[r].as_buffer(), "<i4").astype(np.int64) if old else None
                near = np.frombuffer(batch.column("near")[r].as_buffer(), "<i8") if old else None
                owner, d = reassigned(v, was, near, centroids, changed)
                out.append((owner.astype("<i4").tobytes(), d.astype("<i8").tobytes(), transfers(v, was, owner, len(centroids))))
            owner, d, moves = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(owner, pa.binary()), pa.array(d, pa.binary()), pa.array(moves, _MOVES)], ["block", "owner", "near", "moves"])

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, cluster, distance) of each vector, from blocks and their assignments."""
    for batch in batches:
        owner = np.frombuffer(b"".join(batch.column("owner").to_pylist()), "<i4")
        near = np.frombuffer(b"".join(batch.column("near").to_pylist()), "<i8")
        yield pa.RecordBatch.from_arrays([batch.column("ids").flatten(), pa.array(owner), pa.array(near)], ["id", "cluster", "distance"])


class Buckets:
    """Tables bucketed by ``block`` in the shared folder; joins of two of them need no shuffle."""

    def __init__(self, tables: Tables, n: int):
        self.tables, self.n, self.names = tables, n, {}

    def write(self, df: DataFrame) -> DataFrame:
        self.tables.made += 1
        name, path = f"blocks_{uuid.uuid4().hex}", f"{self.tables.folder}/{self.tables.made}"
        df.write.format("parquet").bucketBy(self.n, "block").sortBy("block").option("path", path).saveAsTable(name)
        found = self.tables.spark.table(name)
        self.names[id(found)] = name, path
        return found

    def delete(self, df: DataFrame) -> None:
        name, path = self.names.pop(id(df))
        self.tables.spark.sql(f"DROP TABLE {name}")
        self.tables.delete(path)


def lloyd(rows: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3:", dim: int = 64, factor: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id_col, cluster and distance of each kept vector, the final centroids); see :func:`cluster`."""
    spark = rows.sparkSession
    tables = Tables(spark)
    kept = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.size("v") == dim)
    kept = kept.select("id", scaled(F.col("v"), factor).alias("v")).where("v is not null")
    kind = dict(kept.dtypes)["id"]
    hashed = kept.where("id is not null").select(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256).alias("hash"), "v")
    centroids = np.array([r.v for r in hashed.orderBy("hash", "v").limit(k).collect()], np.int64).reshape(-1, dim)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long"), centroids
    count = kept.count()
    blocks = -(-count // BLOCK)
    buckets = Buckets(tables, min(MOST_BUCKETS, max(-(-count // BUCKET), min(blocks, spark.sparkContext.defaultParallelism))))
    # sorted, so that a task that runs again makes the same blocks
    made = kept.sortWithinPartitions("id", "v").mapInArrow(_blocks(to_arrow_type(kept.schema["id"].dataType)), f"block long, ids array<{kind}>, vectors binary")
    vectors = buckets.write(made.repartition(buckets.n, "block"))
    sums, held, changed = [[0] * dim for _ in range(k)], [0] * k, np.ones(k, bool)
    assigned = buckets.write(vectors.select("block", "vectors").mapInArrow(_round(centroids, changed), _ASSIGNED))
    for _ in range(rounds):
        moves = assigned.where("moves is not null").select(F.inline("moves")).select("cluster", "n", F.posexplode("sums").alias("at", "value"))
        whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        for r in moves.groupBy("cluster", "at").agg(whole("n"), whole("value")).collect():  # at most k * dim rows
            sums[r.cluster][r["at"]] += int(r.value)
            if r["at"] == 0:
                held[r.cluster] += int(r.n)
        new = np.array([[x // n for x in s] if n else c for s, n, c in zip(sums, held, centroids.tolist(), strict=True)], np.int64).reshape(-1, dim)
        changed = (new != centroids).any(1)
        if not changed.any():
            break  # each round that is left would end as this one
        centroids = new
        both = vectors.select("block", "vectors").join(assigned.select("block", "owner", "near").hint("shuffle_hash"), "block")
        last, assigned = assigned, buckets.write(both.mapInArrow(_round(centroids, changed), _ASSIGNED))
        buckets.delete(last)
    both = vectors.select("block", "ids").join(assigned.select("block", "owner", "near").hint("shuffle_hash"), "block")
    found, _ = tables.write(both.mapInArrow(_rows, f"id {kind}, cluster int, distance long"))
    buckets.delete(vectors)
    buckets.delete(assigned)
    return found.withColumnRenamed("id", id_col), centroids


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3:", dim: int = 64, factor: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Clusters of integer vectors after ``rounds`` rounds of Lloyd's algorithm and a last assignment.

    Kept are vectors with ``dim`` components, none of them null or non-finite;
    components become floor(factor * x).  The first centroids are the k vectors
    whose id has the smallest sha256 of ``seed`` and the id in decimal (of equal
    ids the least vector first); fewer vectors make fewer clusters.  A vector
    goes to the nearest centroid by squared distance, to the smaller number if
    two are as near; centroids become the floor of their vectors' mean, and
    those without vectors stay.

    Returns id_col, cluster, distance (squared), cluster_inertia and inertia
    (its sum over the cluster and over all) and centroid_sha256 (of the final
    centroid's components in decimal, joined by commas).  Rows with a null id
    take part, but don't begin a cluster; repeated rows count each.  An empty
    table gives no rows; other columns are ignored.  A component of 2**27 or
    more after scaling is an error, as distances may not fit a long.
    """
    found, centroids = lloyd(rows, k, rounds, seed, dim, factor, id_col, vector_col)
    totals = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = [(c, s, sum(totals.values()), sha[c]) for c, s in sorted(totals.items())]
    of_cluster = found.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of_cluster), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
