import hashlib
import math
import random

import numpy as np
import pytest

from tesselark.llm import clusters


def brute(rows, k=8, rounds=10, dim=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v]))
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in seeds[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((min(d), d.index(min(d))))
        return out

    for _ in range(rounds):
        to = assign()
        for c in range(len(centroids)):
            mine = [v for (_, v), (_, o) in zip(kept, to, strict=True) if o == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    to = assign()
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = sum(d for d, _ in to)
    own = [sum(d for d, o in to if o == c) for c in range(len(centroids))]
    return [(i, o, d, own[o], total, sha[o]) for (i, _), (d, o) in zip(kept, to, strict=True)]


def vectors(n, seed, dim=64, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(dim)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, spread / 2) for x in rng.choice(centres)]) for i in range(n)]


def same(spark, rows, **more):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [tuple(r) for r in clusters.cluster(frame, **more).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, **more), key=str)
    return got


def test_same_clusters_as_plain_lloyd(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 50)
    monkeypatch.setattr(clusters, "BUCKET", 100)
    got = same(spark, vectors(420, 1))
    assert len({r[1] for r in got}) == 8


def test_ties_repeats_nulls_and_vectors_that_are_left_out(spark):
    rows = vectors(30, 2) + [(None, [0.5] * 64), (5, [0.5] * 64), (5, [0.25] * 64), (5, [0.25] * 64)]
    rows += [(40 + i, [float(i % 2)] * 64) for i in range(12)]
    rows += [(90, None), (91, [1.0] * 63), (92, [1.0] * 63 + [None]), (93, [float("nan")] + [0.0] * 63), (94, [float("inf")] + [0.0] * 63), (95, [])]
    same(spark, rows)


def test_fewer_vectors_than_clusters_and_empty_tables(spark):
    same(spark, vectors(3, 4))
    same(spark, [(i, [1.5] * 64) for i in range(10)])  # equal centroids: all but one stay empty
    assert same(spark, []) == []


def test_large_components_are_exact_and_too_large_ones_an_error(spark):
    same(spark, vectors(60, 5, spread=9000.0), rounds=3)
    with pytest.raises(Exception, match="fit a long"):
        same(spark, [(1, [2.0e5] * 64)])


def test_clashing_names(spark):
    rows = vectors(12, 6)
    frame = spark.createDataFrame([(i, v, 1, 2, "o") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance long, owner string")
    assert sorted(tuple(r) for r in clusters.cluster(frame).collect()) == sorted(brute(rows))


def test_rounds_that_compare_only_changed_centroids():
    rng = np.random.default_rng(3)
    v, c = rng.integers(-9, 9, (300, 4)), rng.integers(-9, 9, (6, 4))
    owner, near = clusters.reassigned(v, None, None, c, np.ones(6, bool))
    for _ in range(20):
        changed = rng.random(6) < 0.4
        c = np.where(changed[:, None], rng.integers(-9, 9, (6, 4)), c)
        was = owner
        owner, near = clusters.reassigned(v, owner, near, c, changed)
        whole = clusters.reassigned(v, None, None, c, changed)
        assert (owner == whole[0]).all() and (near == whole[1]).all()
        sums = np.zeros((6, 4), np.int64)
        for m in clusters.transfers(v, was, owner, 6) or []:
            sums[m["cluster"]] += m["sums"]
        assert (sums == [v[owner == k].sum(0) - v[was == k].sum(0) for k in range(6)]).all()


def test_rounds_join_without_a_shuffle(spark):
    from tesselark.llm.shared import Tables

    buckets = clusters.Buckets(Tables(spark), 3)
    a = buckets.write(spark.range(40).selectExpr("id as block", "id as x").repartition(3, "block"))
    b = buckets.write(spark.range(40).selectExpr("id as block", "id as y").repartition(3, "block"))
    plan = a.join(b.hint("shuffle_hash"), "block")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    buckets.delete(a)
    buckets.delete(b)
