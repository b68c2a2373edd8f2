"""The first field and the adaptive loop against plain Python."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselark.operators import adaptive, halo, metric, tilings
from tesselark.operators.tilings import BY_NAME


def blocks_of(h, w):
    """A tiling of h x w blocks, each two columns of 4x2 in turn with single blocks."""
    out = []
    for y in range(h):
        for x in range(w):
            large = (x // 2) % 2 == 0 and y // 4 * 4 + 4 <= h and x // 2 * 2 + 2 <= w
            out.append((y, x, "32x16", y // 4 * 4, x // 2 * 2) if large else (y, x, "8x8", y, x))
    return out


KIND = "by long, bx long, shape string, ay long, ax long"


@pytest.mark.parametrize("target", [1.0, 2.5])
def test_a_shape_has_one_quant(spark, target):
    rng = np.random.default_rng(2)
    rows = blocks_of(9, 7)
    quant = {(r[0], r[1]): float(rng.uniform(0.5, 2)) for r in rows}
    field = spark.createDataFrame([(*k, v) for k, v in quant.items()], "by long, bx long, quant double")
    got = {(r.by, r.bx): r.quant for r in adaptive.adjusted(field, spark.createDataFrame(rows, KIND), target).collect()}
    share = 1.0 if target == 1.0 else 1 - (2.5 - adaptive.MIX_LIMIT) * adaptive.MIX_SLOPE
    for y, x, name, ay, ax in rows:
        own = [quant[r[0], r[1]] for r in rows if r[3:] == (ay, ax)]
        want = max(own) if len(own) < 4 else max(own) * share + sum(own) / len(own) * (1 - share)
        assert got[y, x] == pytest.approx(want) and len(own) == BY_NAME[name].blocks


def plain_scale(values, dc):
    v = sorted(values)
    median = v[len(v) // 2]
    mad = sorted(abs(x - median) for x in v)[len(v) // 2]
    scale = math.floor(min(max(65536 * (median - mad) / 5, 1), 32768))
    most = math.floor(dc * 4096 * 1.6)
    return (max(1, most) if scale > most else scale) / 65536


def plain_loop(first, judge, target, rounds):
    """The loop on a map from blocks to quants; judge takes and returns such maps."""
    q, low, high = dict(first), min(first.values()), max(first.values())
    spread = math.sqrt(250 / (high / low))
    a, b = low / (min(2, spread) * spread), high * spread / min(2, spread)
    dc = adaptive.first_quant_dc(target)
    for i in range(rounds + 1):
        scale = plain_scale(q.values(), dc)
        whole = lambda v: math.floor(v / scale + 0.5)  # noqa: E731, B023
        distance = judge({k: min(max(whole(v), 1), 255) * scale for k, v in q.items()})
        if i == rounds:
            return q, distance
        for k, old in q.items():
            if i == 1 and old < 0.4 * old + 0.6 * first[k]:
                old = min(max(0.4 * old + 0.6 * first[k], a), b)
            off = distance[k] / target
            if off <= 1:
                new = old * off**0.2 if i < 2 else old
            else:
                new = old * off if whole(old * off) != whole(old) else old + scale
            q[k] = min(max(new, a), b)


def test_loop_changes_blocks_as_a_plain_one_does(spark):
    rng = np.random.default_rng(5)
    rows = blocks_of(8, 9)
    first = {(r[0], r[1]): float(rng.uniform(0.4, 1.5)) for r in rows}
    need = {k: float(rng.choice([0.2, 0.8, 1.004, 1.4, 3.0])) for k in first}
    field = spark.createDataFrame([(*r, first[r[0], r[1]]) for r in rows], KIND + ", quant double")
    needs = spark.createDataFrame([(*k, v) for k, v in need.items()], "by long, bx long, need double")
    found, history = adaptive.adapt(field, lambda f: f.join(needs, ["by", "bx"]).select("by", "bx", (F.col("need") / F.col("quant")).alias("distance")), 1.3, rounds=4)
    want, distance = plain_loop(first, lambda q: {k: need[k] / v for k, v in q.items()}, 1.3, 4)
    got = {(r.by, r.bx): (r.quant, r.distance) for r in found.collect()}
    assert set(got) == set(want) and len(history) == 5
    for k in want:
        assert got[k] == pytest.approx((want[k], distance[k]), rel=1e-9)
    assert history[-1] == pytest.approx(max(distance.values())) and history[-1] < history[0]


def test_rounds_leave_one_table(spark):
    field = spark.createDataFrame([(0, 0, "8x8", 0, 0, 1.0)], KIND + ", quant double")
    found, _ = adaptive.adapt(field, lambda f: f.select("by", "bx", F.lit(2.0).alias("distance")), 1.0, rounds=3)
    folder = os.path.dirname(found.inputFiles()[0].replace("file://", ""))
    assert len(os.listdir(os.path.dirname(folder))) == 1


def test_an_empty_field_has_no_rounds(spark):
    field = spark.createDataFrame([], KIND + ", quant double")
    found, history = adaptive.adapt(field, lambda f: f, 1.0)
    assert found.count() == 0 and history == []


def test_whole_evaluation_on_a_small_plane(spark):
    rng = np.random.default_rng(9)
    h, w = 5, 6
    planes = [rng.normal(0, s, (8 * h, 8 * w)).cumsum(1) for s in (0.001, 0.01, 0.01)]
    rows = blocks_of(h, w)
    quant = {(r[3], r[4]): float(rng.uniform(0.3, 1.5)) for r in rows}
    pixels = spark.createDataFrame([(y, x, *[float(p[y, x]) for p in planes]) for y in range(8 * h) for x in range(8 * w)], "y long, x long, c0 double, c1 double, c2 double")
    field = spark.createDataFrame([(*r, quant[r[3], r[4]]) for r in rows], KIND + ", quant double")
    got = {(r.by, r.bx): r.distance for r in adaptive.coding_distance(pixels, 90.0, tile=24)(field).collect()}
    left = [np.zeros_like(p) for p in planes]
    for (ay, ax), q in quant.items():
        s = BY_NAME[next(r[2] for r in rows if r[3:] == (ay, ax))]
        cell = np.s_[8 * ay : 8 * (ay + s.rows), 8 * ax : 8 * (ax + s.cols)]
        n, m = 8 * s.rows, 8 * s.cols
        kept = {}
        for c in (1, 0, 2):
            step = tilings.weights(s, c) / q
            value = tilings.basis(n) @ planes[c][cell] @ tilings.basis(m).T / math.sqrt(n * m) - (kept[1] if c == 2 else 0)
            kept[c] = np.rint(value / step) * step + (kept[1] if c == 2 else 0)
            left[c][cell] = tilings.basis(n).T @ kept[c] @ tilings.basis(m) * math.sqrt(n * m)
    bands = [halo.bands_of([p * 90 for p in side]) for side in (planes, left)]
    error = metric.band_difference(*bands)
    for y, x, name, ay, ax in rows:
        s = BY_NAME[name]
        part = error[8 * ay : 8 * (ay + s.rows), 8 * ax : 8 * (ax + s.cols)]
        assert got[y, x] == pytest.approx(1.2 * np.mean(part**16) ** (1 / 16), rel=1e-6)


def test_first_field_in_tiles_is_that_of_the_plane(spark):
    rng = np.random.default_rng(1)
    planes = [rng.normal(0, 0.01, (40, 24)), rng.uniform(0, 0.4, (40, 24)), rng.uniform(0, 0.4, (40, 24))]
    pixels = spark.createDataFrame([(y, x, *[float(p[y, x]) for p in planes]) for y in range(40) for x in range(24)], "y long, x long, c0 double, c1 double, c2 double")
    want = adaptive.first_field_of(3.0)(planes)
    for r in adaptive.first_field(pixels, 3.0, tile=8).collect():
        assert (r.quant, r.strategy_mask, r.mask) == pytest.approx(tuple(float(a[r.y, r.x]) for a in want))
