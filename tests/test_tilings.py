"""Shape search, mixed tilings and wide stencils against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselark.operators import halo, tilings
from tesselark.operators.tilings import BY_NAME, SHAPES


def plain_search(rows, cols, cost, small):
    """A tile's search on a map from blocks to (shape, anchor), by the rules as they are told."""
    at = {(y, x): ("8x8", y, x) for y in range(rows) for x in range(cols)}
    price = {b: cost["8x8", *b] * small for b in at}
    rank = dict.fromkeys(at, 0)

    def cells(y, x, h, w):
        return [(b, a) for b in range(y, y + h) for a in range(x, x + w)]

    def fits(y, x, n):
        return y + n <= rows and x + n <= cols

    def put(name, y, x):
        for b in cells(y, x, BY_NAME[name].rows, BY_NAME[name].cols):
            at[b], price[b] = (name, y, x), 0.0
        price[y, x] = cost[name, y, x]

    def merge(name, y, x, level):
        own = cells(y, x, BY_NAME[name].rows, BY_NAME[name].cols)
        if any(rank[b] >= level for b in own) or cost[name, y, x] >= sum(price[b] for b in own):
            return
        put(name, y, x)
        rank.update(dict.fromkeys(own, level))

    def across(blocks, side):
        return any(b in at and at[b][1 + side] < b[side] for b in blocks)

    def divide(n, y, x):
        k = n // 2
        lines = [([(y, a) for a in range(x, x + n)], 0), ([(y + n, a) for a in range(x, x + n)], 0), ([(b, x) for b in range(y, y + n)], 1), ([(b, x + n) for b in range(y, y + n)], 1)]
        if any(across(*line) for line in lines):
            return
        tall, flat, square = {2: ("16x8", "8x16", "16x16"), 4: ("32x16", "16x32", "32x32")}[n]
        halves = {"tall": [(y, x, n, k), (y, x + k, n, k)], "flat": [(y, x, k, n), (y + k, x, k, n)]}
        free = {"tall": not across([(b, x + k) for b in range(y, y + n)], 1), "flat": not across([(y + k, a) for a in range(x, x + n)], 0)}
        best = {}
        for way, name in (("tall", tall), ("flat", flat)):
            best[way] = []
            for b, a, h, w in halves[way]:
                now = sum(price[c] for c in cells(b, a, h, w))
                new = cost[name, b, a] if free[way] and at[b, a][0] != name else math.inf
                best[way].append((min(now, new), new < now, name, b, a))
        total = {way: sum(c[0] for c in options) for way, options in best.items()}
        if cost[square, y, x] < total["tall"] and cost[square, y, x] < total["flat"]:
            return put(square, y, x)
        for _, better, name, b, a in best["tall" if total["tall"] < total["flat"] else "flat"]:
            if better:
                put(name, b, a)

    for name in ("16x8", "8x16", "16x32", "32x16"):
        s = BY_NAME[name]
        for y in range(0, rows - s.rows + 1, s.rows):
            for x in range(0, cols - s.cols + 1, s.cols):
                n = 2 if s.blocks == 2 else 4
                if fits(y, x, n):
                    if s.cols > s.rows and y % n == 0 and x % n == 0:
                        divide(n, y, x)
                elif (y if s.cols > s.rows else x) % n == 0:
                    merge(name, y, x, n)
    for n, step in ((2, 1), (4, 2)):
        for y in range(0, rows - n + 1, step):
            for x in range(0, cols - n + 1, step):
                if y % n or x % n:
                    divide(n, y, x)
    return at


def random_costs(rng, rows, cols, ty=0, tx=0):
    out = []
    for s in SHAPES:
        for y in range(0, rows - s.rows + 1, s.step):
            for x in range(0, cols - s.cols + 1, s.step):
                out.append((8 * ty + y, 8 * tx + x, s.name, round(s.blocks * rng.uniform(0.7, 1.1) * 8) / 8))  # ties are common
    return out


def test_placement_follows_the_rules(spark):
    rng = random.Random(9)
    sizes = [(8, 8), (8, 8), (8, 5), (3, 8), (4, 4), (7, 6), (1, 1), (2, 1), (5, 3), (6, 8)]
    rows = [r for t, (h, w) in enumerate(sizes) for r in random_costs(rng, h, w, 3 * t, t)]
    got = {(r.by, r.bx): (r["shape"], r.ay, r.ax) for r in tilings.place_shapes(spark.createDataFrame(rows, "by long, bx long, shape string, cost double"), 1.3).collect()}
    want, used = {}, set()
    for t, (h, w) in enumerate(sizes):
        cost = {(s, y - 24 * t, x - 8 * t): c for y, x, s, c in rows if y // 24 == t and x // 8 == t}
        for (y, x), (name, ay, ax) in plain_search(h, w, cost, 1 - 0.4 / 2.7).items():
            want[24 * t + y, 8 * t + x] = (name, 24 * t + ay, 8 * t + ax)
            used.add(name)
    assert got == want and len(used) >= 6


def test_every_placement_is_a_tiling():
    rng = random.Random(2)
    for _ in range(60):
        h, w = rng.randint(1, 8), rng.randint(1, 8)
        tile = tilings.Placement(h, w, {(s, y, x): c for y, x, s, c in random_costs(rng, h, w)}, 0.85)
        tile.run()
        for y in range(h):
            for x in range(w):
                s, ay, ax = BY_NAME[tile.name[y, x]], tile.top[y, x], tile.left[y, x]
                assert ay <= y < ay + s.rows <= h and ax <= x < ax + s.cols <= w and tile.name[ay, ax] == s.name and (tile.top[ay, ax], tile.left[ay, ax]) == (ay, ax)


def dct(a, forward=True):
    h, w = a.shape
    def basis(n):
        return np.array([[math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * k * (2 * i + 1) / (2 * n)) for i in range(n)] for k in range(n)])
    return basis(h) @ a @ basis(w).T if forward else basis(h).T @ a @ basis(w)


@pytest.mark.parametrize("name", ["8x8", "16x8", "16x16", "16x32"])
def test_cost_of_a_candidate(name):
    rng = np.random.default_rng(3)
    s = BY_NAME[name]
    planes, mask, quant = rng.normal(0, 0.05, (3, 64, 48)), rng.uniform(0.5, 5, (64, 48)), rng.uniform(0.5, 2, (8, 6))
    at, costs = tilings.costs_of_shape(s, planes, mask, quant, (0.1, 0.9), 1.5)
    h, w = 8 * s.rows, 8 * s.cols
    ratio = (1.5 + tilings.COST_BIAS) / (1 + tilings.COST_BIAS)
    for (by, bx), cost in list(zip(at.tolist(), costs.tolist(), strict=True))[:: max(1, len(at) // 5)]:
        q = quant[by : by + s.rows, bx : bx + s.cols].ravel()
        norm = max(q) if len(q) <= 2 else (sum(v**16 for v in q) / len(q)) ** (1 / 16)
        window = np.s_[8 * by : 8 * by + h, 8 * bx : 8 * bx + w]
        co = [dct(p[window]) / math.sqrt(h * w) for p in planes]
        told = lost = 0.0
        for c, f in enumerate((0.1, 0.0, 0.9)):
            weight = tilings.weights(s, c)
            scaled = (co[c] - f * co[1]) / weight * norm
            level = np.array([[math.floor(abs(v) + 0.5) * (1 if v > 0 else -1) for v in r] for r in scaled])
            error = dct(weight * (scaled - level), False) * math.sqrt(h * w)
            told += tilings.MAGNITUDE[0] * ratio ** tilings.MAGNITUDE[1] * np.sqrt(abs(level)).sum()
            bits = math.ceil(math.log2((level != 0).sum() + 1)) + 1
            told += tilings.ZEROS[0] * ratio ** tilings.ZEROS[1] * (math.ceil(math.log2(bits + 17)) + bits)
            lost += (((mask[window] + tilings.MASK_OFFSET[c]) * error) ** 8).sum() * tilings.ERROR_WEIGHT[c]
            if c == 0 and s.blocks > 1:
                told, lost = told * (1 + s.blocks / 8), lost * (1 + s.blocks / 8)
        want = told * s.multiplier + tilings.LOSS[0] * ratio ** tilings.LOSS[1] * (lost / (h * w)) ** 0.125 * h * w / norm
        assert cost == pytest.approx(want, rel=1e-9)


def test_transforms_over_a_random_tiling_and_back(spark):
    rng = random.Random(4)
    blocks = []
    for ty, tx, h, w in ((0, 0, 8, 8), (0, 1, 8, 3), (1, 0, 5, 8), (1, 1, 5, 3)):
        tile = tilings.Placement(h, w, {(s, y, x): c for y, x, s, c in random_costs(rng, h, w)}, 0.85)
        tile.run()
        blocks += [(8 * ty + y, 8 * tx + x, tile.name[y, x], 8 * ty + int(tile.top[y, x]), 8 * tx + int(tile.left[y, x])) for y in range(h) for x in range(w)]
    tiling = spark.createDataFrame(blocks, "by long, bx long, shape string, ay long, ax long")
    a = np.random.default_rng(1).normal(size=(104, 88))
    plane = spark.createDataFrame([(y, x, float(a[y, x])) for y in range(104) for x in range(88)], "y long, x long, value double")
    found = tilings.tiled_dct(plane, tiling)
    got = {}
    for r in found.collect():
        got.setdefault((r.ay, r.ax, r["shape"]), {})[r.v, r.u] = r.value
    assert set(got) == {(ay, ax, s) for _, _, s, ay, ax in blocks}
    for (ay, ax, name), values in got.items():
        h, w = 8 * BY_NAME[name].rows, 8 * BY_NAME[name].cols
        want = dct(a[8 * ay : 8 * ay + h, 8 * ax : 8 * ax + w])
        assert np.allclose([[values[v, u] for u in range(w)] for v in range(h)], want, atol=1e-9)
    back = {(r.y, r.x): r.value for r in tilings.tiled_idct(found, tiling).collect()}
    assert len(back) == a.size and all(abs(v - a[at]) < 1e-6 for at, v in back.items())


def test_samples_and_blocks_meet_in_one_shuffle_each(spark):
    plane = spark.range(4096).select(F.expr("id div 64").alias("y"), (F.col("id") % 64).alias("x"), F.lit(1.0).alias("value"))
    tiling = spark.range(64).select(F.expr("id div 8").alias("by"), (F.col("id") % 8).alias("bx"), F.lit("8x8").alias("shape"), F.expr("id div 8").alias("ay"), (F.col("id") % 8).alias("ax"))
    plan = tilings.tiled_dct(plane, tiling)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    bands = halo.frequency_bands(plane.select("y", "x", *[F.col("value").alias(f"c{i}") for i in range(3)]))
    assert bands._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def plain_blur(a, sigma):
    r = max(1, int(2.25 * sigma))
    weight = {d: math.exp(-d * d / (2 * sigma * sigma)) for d in range(-r, r + 1)}

    def line(v):
        n, out = len(v), []
        for i in range(n):
            if r == 2:
                fold = lambda k: n - 1 - (k % (2 * n) - n) if k % (2 * n) >= n else k % (2 * n)
                out.append(sum(w * v[fold(i + d)] for d, w in weight.items()) / sum(weight.values()))
            else:
                has = {d: w for d, w in weight.items() if 0 <= i + d < n}
                out.append(sum(w * v[i + d] for d, w in has.items()) / sum(has.values()))
        return out

    rows = [line(r) for r in a]
    return [list(c) for c in zip(*[line(c) for c in zip(*rows, strict=True)], strict=True)]


@pytest.mark.parametrize("sigma", [0.9, 1.2, 2.7, halo.LOW])
@pytest.mark.parametrize("size", [(1, 1), (3, 40), (21, 6)])
def test_blurs_at_the_edges(sigma, size):
    a = np.random.default_rng(7).normal(size=size)
    assert np.allclose(halo.blurred(a, sigma), plain_blur(a.tolist(), sigma), atol=1e-12)


def test_tiles_give_what_the_whole_plane_gives(spark):
    rng = np.random.default_rng(8)
    a = [rng.normal(0, s, (70, 45)) for s in (8, 20, 15)]
    rows = [(y, x, *[float(p[y, x]) for p in a]) for y in range(70) for x in range(45)]
    plane = spark.createDataFrame(rows, "y long, x long, c0 double, c1 double, c2 double")
    for found, names, whole in (
        (halo.frequency_bands(plane, tile=16), halo.BANDS, halo.bands_of(a)),
        (halo.adapted_colours(plane.select("y", "x", *[F.abs(c).alias(c) for c in ("c0", "c1", "c2")]), tile=16), ("c0", "c1", "c2"), halo.adapted(80.0)([abs(p) for p in a])),
    ):
        got = found.collect()
        assert len(got) == 70 * 45
        for r in got:
            assert [r[n] for n in names] == pytest.approx([float(p[r.y, r.x]) for p in whole], abs=1e-9)


def test_empty_tables(spark):
    pixels = spark.createDataFrame([], "y long, x long, c0 double, c1 double, c2 double, mask double")
    field = spark.createDataFrame([], "by long, bx long, quant double, x_factor double, b_factor double")
    costs = tilings.shape_costs(pixels, field, 1.0)
    assert costs.count() == 0 and tilings.place_shapes(costs, 1.0).count() == 0 and halo.frequency_bands(pixels).count() == 0


def plain_filter(channels, sigma, mixed, compared, scale):
    h, w = sigma.shape
    fold = lambda k, n: -1 - k if k < 0 else 2 * n - 1 - k if k >= n else k
    at = lambda c, y, x: channels[c][fold(y, h), fold(x, w)]
    out = channels.copy()
    for y in range(h):
        for x in range(w):
            if sigma[y, x] < halo.LEAST_SIGMA:
                continue
            unit = sigma[y, x] * halo.SIGMA_SCALE * scale * (halo.EDGE_SCALE if y % 8 in (0, 7) or x % 8 in (0, 7) else 1)
            total, sums = 1.0, [channels[c][y, x] for c in range(3)]
            for dy, dx in mixed:
                if (dy, dx) != (0, 0):
                    gap = sum(halo.CHANNEL_SCALE[c] * abs(at(c, y + a, x + b) - at(c, y + dy + a, x + dx + b)) for c in range(3) for a, b in compared)
                    weight = max(0.0, 1 + gap * unit)
                    total += weight
                    sums = [s + weight * at(c, y + dy, x + dx) for c, s in enumerate(sums)]
            for c in range(3):
                out[c, y, x] = sums[c] / total
    return out


@pytest.mark.parametrize("iterations", [1, 2, 3])
def test_edge_preserving_passes(spark, iterations):
    rng = np.random.default_rng(iterations)
    h, w = 24, 21
    channels = rng.normal(0, 0.01, (3, h, w)).cumsum(1)
    blocks = rng.choice([-0.05, -0.3, -1.0, -5.0], (3, 3))
    sigma = np.repeat(np.repeat(blocks, 8, 0), 8, 1)[:h, :w]
    rows = [(y, x, *[float(c[y, x]) for c in channels], float(sigma[y, x])) for y in range(h) for x in range(w)]
    pixels = spark.createDataFrame(rows, "y long, x long, c0 double, c1 double, c2 double, sigma double")
    want = channels
    for p in halo.ITERATIONS[iterations]:
        want = plain_filter(want, sigma, *p)
    for r in halo.edge_preserving(pixels, iterations, tile=8).collect():
        assert (r.c0, r.c1, r.c2) == pytest.approx(tuple(want[:, r.y, r.x].tolist()), abs=1e-12)


@pytest.mark.parametrize(("target", "candidates"), [(1.0, (0, 2, 7)), (6.0, (0, 4)), (0.3, None)])
def test_sharpness_search(spark, target, candidates):
    rng = np.random.default_rng(6)
    h, w = 20, 17
    first = rng.normal(0, 0.02, (3, h, w)).cumsum(2)
    restored = first + rng.normal(0, 0.004, first.shape)
    mask = rng.uniform(0.5, 2, (h, w))
    level = np.repeat(np.repeat(rng.choice([0.05, 0.4, 3.0], (3, 3)), 8, 0), 8, 1)[:h, :w]
    rows = [(y, x, *[float(a[y, x]) for a in (*first, *restored, mask, level)]) for y in range(h) for x in range(w)]
    pixels = spark.createDataFrame(rows, "y long, x long, " + ", ".join(f"{c} double" for c in ("c0", "c1", "c2", "r0", "r1", "r2", "mask", "level")))
    got = {(r["by"], r.bx): r.sharpness for r in halo.sharpness_search(pixels, target, tile=8).collect()}
    assert set(got) == {(y, x) for y in range(3) for x in range(3)}
    if candidates is None:
        assert set(got.values()) == {4}
        return
    errors = {}
    for s in candidates:
        sigma = np.array([[1 / min(-1e-4, 0.46 / (v * -1.1715728752538099) * s / 7) for v in r] for r in level])
        out = restored
        for p in halo.ITERATIONS[2]:
            out = plain_filter(out, sigma, *p)
        errors[s] = mask**2 * (12.339445295782363 * (first[0] - out[0]) ** 2 + (first[1] - out[1]) ** 2 + 0.2 * (first[2] - out[2]) ** 2)
    for (y, x), s in got.items():
        e = {k: v[8 * y : 8 * y + 8, 8 * x : 8 * x + 8].sum() for k, v in errors.items()}
        best, least = 0, e[0] * max(0.85970338919928291, 0.98017198824148288 ** min(5.0, target))
        for k in candidates[1:]:
            if e[k] < least:
                best, least = k, e[k]
        assert s == best
