"""Streams, intervals, low frequencies, plans of steps and dead zones against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselark.operators import deadzones, intervals, lowfrequencies, orderstats, sequences, streams, tilings
from tesselark.operators.sequences import Channel, Palette, Rct, Squeeze
from tesselark.operators.tilings import BY_NAME, SHAPES


def plain_ranks(symbols):
    front, out = list(range(max(symbols, default=0) + 1)), []
    for s in symbols:
        out.append(front.index(s))
        front.insert(0, front.pop(out[-1]))
    return out


def test_move_to_front_ranks(spark):
    rng = random.Random(3)
    groups = {0: rng.choices(range(9), k=200), 1: [4], 2: [7, 7, 7, 0, 7], 3: list(range(12))[::-1] * 2, 4: rng.choices((1, 250), k=40)}
    rows = [(g, 3 * i + g, s) for g, symbols in groups.items() for i, s in enumerate(symbols)]
    rng.shuffle(rows)
    got = {(r.grp, r.pos): r["rank"] for r in streams.move_to_front(spark.createDataFrame(rows, "grp long, pos long, symbol long")).collect()}
    assert got == {(g, 3 * i + g): k for g, symbols in groups.items() for i, k in enumerate(plain_ranks(symbols))}
    assert streams.move_to_front(spark.createDataFrame([], "grp long, pos long, symbol long")).count() == 0


def test_move_to_front_ranks_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(orderstats, "CHUNK", 40)
    symbols = random.Random(6).choices(range(30), k=900)
    rows = [("g", i, s) for i, s in enumerate(symbols)]
    got = {r.pos: r["rank"] for r in streams.move_to_front(spark.createDataFrame(rows, "grp string, pos long, symbol long")).collect()}
    assert [got[i] for i in range(900)] == plain_ranks(symbols)


def test_ranges_hold_what_lies_between_their_bounds(spark):
    rng = random.Random(5)
    values = [(i, i % 3, rng.choice((rng.uniform(-50, 50), float(rng.randint(-20, 20)), 1e12, -3e-9))) for i in range(300)] + [(900, 0, None), (901, 1, float("nan"))]
    ranges = []
    for j in range(80):
        lo = rng.choice((rng.uniform(-60, 60), float(rng.randint(-20, 20)), 0.0))
        ranges.append((j, j % 3, lo, lo + rng.choice((0.0, 1e-9, 0.5, 1.0, 3.7, 8.0, 100.0, 1e13, -1.0))))
    ranges += [(100, 0, None, 3.0), (101, 1, -2.0, None), (102, 2, None, None), (103, 0, -1e300, 1e300)]
    v = spark.createDataFrame(values, "i long, g long, value double")
    r = spark.createDataFrame(ranges, "j long, g long, lo double, hi double")
    inside = lambda x, lo, hi: x is not None and not math.isnan(x) and (lo is None or lo <= x) and (hi is None or x < hi)
    for keys in ([], ["g"]):
        right = r if keys else r.withColumnRenamed("g", "h")
        found = intervals.range_join(v, right, "value", keys=keys)
        got = sorted((a.i, a.j) for a in found.collect())
        assert got == sorted((i, j) for i, g, x in values for j, h, lo, hi in ranges if (not keys or g == h) and inside(x, lo, hi))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.range_join(v, r.limit(0).withColumnRenamed("g", "h"), "value").count() == 0


def test_bits_under_a_code(spark):
    tokens = [(s, c, v, n) for s, c, v, n in ((0, 0, 3, 5), (0, 0, 900, 2), (0, 1, 3, 1), (1, 1, 0, 7), (1, 0, 17, 3))]
    t = spark.createDataFrame(tokens, "section long, context long, value long, n long")
    mapping = spark.createDataFrame([(0, 0), (1, 0)], "context long, cluster long")
    counts = streams.symbol_counts(t, mapping)
    code = {(r.cluster, r.symbol): r.depth for r in streams.shannon_code(counts, ["cluster"]).collect()}
    total = sum(x[3] for x in tokens)

    def symbol(v):
        e = v.bit_length() - 1
        return (v, 0) if v < 16 else (16 + (e - 4) * 4 + ((v - (1 << e)) >> (e - 2)), e - 2)

    n = {}
    for _, _, v, k in tokens:
        n[symbol(v)[0]] = n.get(symbol(v)[0], 0) + k
    assert code == {(0, s): max(1, math.ceil(math.log2(total / k))) for s, k in n.items()}
    assert sum(2.0**-d for d in code.values()) <= 1
    got = {r.section: (r.tokens, r.bits) for r in streams.code_bits(t, mapping, streams.shannon_code(counts, ["cluster"]), ["section"]).collect()}
    for s in (0, 1):
        own = [(v, k) for a, _, v, k in tokens if a == s]
        assert got[s] == (sum(k for _, k in own), sum(k * (code[0, symbol(v)[0]] + symbol(v)[1]) for v, k in own))
    short = spark.createDataFrame([(0, 3, 1)], "cluster long, symbol long, depth long")
    with pytest.raises(Exception, match="no code for value"):
        streams.code_bits(t, mapping, short, ["section"]).collect()
    lone = streams.shannon_code(spark.createDataFrame([(0, 5, 9)], "cluster long, symbol long, n long"), ["cluster"])
    assert lone.first().depth == 0


@pytest.mark.parametrize("name", ["8x8", "16x8", "16x32", "32x32"])
def test_low_frequencies_and_means_undo_each_other(spark, name):
    s = BY_NAME[name]
    rng = np.random.default_rng(4)
    values = [(0, 0, name, v, u, float(rng.normal())) for v in range(s.rows) for u in range(s.cols)]
    low = spark.createDataFrame(values + [(0, 0, name, 7, 7, 5.0)], "ay long, ax long, shape string, v long, u long, value double")
    tiling = spark.createDataFrame([(y, x, name, 0, 0) for y in range(s.rows) for x in range(s.cols)], "by long, bx long, shape string, ay long, ax long")
    means = lowfrequencies.block_means(low)
    got = {(r.by, r.bx): r.value for r in means.collect()}
    for y in range(s.rows):
        for x in range(s.cols):
            wave = lambda n, k, i: (1 if k == 0 else math.sqrt(2)) * math.cos(math.pi * k * (2 * i + 1) / (2 * n))
            scale = lambda n, k: math.prod(math.cos(math.pi * k * m / (16 * n)) for m in (1, 2, 4)) if k else 1.0
            assert got[y, x] == pytest.approx(sum(c * wave(s.rows, v, y) * wave(s.cols, u, x) * scale(s.rows, v) * scale(s.cols, u) for *_, v, u, c in values))
    back = {(r.v, r.u): r.value for r in lowfrequencies.low_frequencies(means, tiling).collect()}
    assert back == pytest.approx({(v, u): c for *_, v, u, c in values})


def test_means_of_a_smooth_plane_are_those_of_its_blocks(spark):
    rng = np.random.default_rng(1)
    waves = np.array([[math.cos(math.pi * k * (2 * i + 1) / 64) for i in range(32)] for k in range(4)])
    a = waves.T @ rng.normal(size=(4, 4)) @ waves
    plane = spark.createDataFrame([(y, x, float(a[y, x])) for y in range(32) for x in range(32)], "y long, x long, value double")
    tiling = spark.createDataFrame([(y, x, "32x32", 0, 0) for y in range(4) for x in range(4)], "by long, bx long, shape string, ay long, ax long")
    got = lowfrequencies.block_means(lowfrequencies.mean_scaled(tilings.tiled_dct(plane, tiling))).collect()
    assert all(abs(r.value - a[8 * r.by : 8 * r.by + 8, 8 * r.bx : 8 * r.bx + 8].mean()) < 1e-9 for r in got)


def image(spark, h=7, w=10):
    rng = np.random.default_rng(2)
    planes = {"r": rng.integers(-40, 200, (h, w)), "g": rng.integers(0, 255, (h, w)), "b": rng.integers(0, 9, (h, w)), "k": rng.integers(0, 4, (h, w)) * 11}
    rows = [(n, y, x, int(a[y, x])) for n, a in planes.items() for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "channel string, y long, x long, value long"), [Channel(n, h, w) for n in planes], rows


PLANS = [
    [],
    [Rct("r", 6)],
    [Squeeze("g"), Squeeze("g", along_x=False), Squeeze("g-"), Squeeze("g")],
    [Palette("b", 2, 64), Squeeze("b")],
    [Rct("g", 30), Palette("r"), Squeeze("k", along_x=False), Rct("r", 3)],
]


@pytest.mark.parametrize("steps", PLANS)
def test_plans_are_undone(spark, steps):
    rows, channels, plain = image(spark)
    shapes = sequences.planned(channels, steps)
    there = sequences.forward(rows, channels, steps)
    sizes = {r.channel: (r.h, r.w) for r in there.groupBy("channel").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")).collect()}
    assert set(sizes) == {c.name for c in shapes[-1]}
    assert all(sizes[c.name] == (c.height, c.width) for c in shapes[-1] if not c.name.endswith("#"))
    assert sorted(tuple(r) for r in sequences.inverse(there, channels, steps).collect()) == sorted(plain)


def test_plans_that_can_t_be_followed_are_refused(spark):
    rows, channels, _ = image(spark)
    for steps, why in (
        ([Rct("g", 1), Rct("b", 1)], "there are no 3"),
        ([Rct("r", 42)], "no colour transform"),
        ([Squeeze("g"), Rct("r", 1)], "differ in size"),
        ([Squeeze("x")], "there are no 1"),
        ([Palette("r", 5)], "one to four"),
        ([Palette("r", 1, 257)], "at most 256"),
        ([Palette("k"), Palette("k")], "already"),
        ([Squeeze("r")] * 9, "at most 8"),
        ([Squeeze("r")] * 5, "too small"),
    ):
        with pytest.raises(ValueError, match=why):
            sequences.forward(rows, channels, steps)
    with pytest.raises(ValueError, match="different names"):
        sequences.planned([Channel("a", 1, 1), Channel("a", 1, 1)], [])
    with pytest.raises(ValueError, match="more than 3 colours"):
        sequences.forward(rows, channels, [Palette("k", 1, 3)])


def plain_choice(coefficients, name, raw, scale):
    """Quant and dead zones of one shape from (3, h, w) coefficients."""
    s = BY_NAME[name]
    h, w, n = 8 * s.rows, 8 * s.cols, s.blocks
    best, kept = 0, None
    for c in (1, 0, 2):
        less = min(0.003 * n, 0.08) if n > 1 else 0.0
        zones = [max(0.54, z - less) if n > 1 else z for z in (0.58, 0.64, 0.64, 0.64)]
        r, held, lost, border, errors, levels = raw, [0.0] * 4, [0.0] * 4, 0.0, 0.0, 0.0
        for v in range(h):
            for u in range(w):
                if v < s.rows and u < s.cols:
                    continue
                q = 2 * (v >= h // 2) + (u >= w // 2)
                value = coefficients[c, v, u] / tilings.weights(s, c)[v, u] * scale * raw
                level = 0.0 if abs(value) < zones[q] else abs(float(np.rint(value)))
                errors, levels, held[q] = errors + abs(abs(value) - level), levels + level, held[q] + level
                if level == 0:
                    lost[q] = max(lost[q], abs(value))
                elif v >= 7 * s.rows and u >= 7 * s.cols or ((v == h - 1 or u == w - 1) and v >= h // 2 and u >= w // 2):
                    border += abs(value)
        near = [held[q] == 0 and lost[q] > 0.46 for q in range(4)]
        if c == 1 and levels * 8 < n:
            r += any(near[1:])
            wide = 0.9999 * r / raw
            if near[3]:
                zones[3] = wide * lost[3]
            elif near[1] or near[2]:
                zones[1] = zones[2] = wide * max(lost[1:3])
            elif near[0]:
                zones[0] = wide * lost[0]
        cap = lambda k: 255 if k >= 256 else k
        every = sum(held)
        far = (70.0, 30.0, 60.0)[c] * border
        if far >= every + 1:
            r = cap(int(r + far / (every + 1)))
        if name == "8x8" and every < 11:
            r = cap(r + 1)
        if n > 1:
            k = {"16x32": "32x16", "8x16": "16x8"}.get(name, name)
            allowed = deadzones.ERROR_SHARE[k][c] * n * 64 + deadzones.LEVEL_SHARE[k][c] * levels * deadzones.NORMALIZER
            if errors * deadzones.NORMALIZER > allowed:
                r = cap(r + min(2, int(errors * deadzones.NORMALIZER / allowed)))
        active = (int(min(held)) + n // 2) // n if min(held) < 15 * n else 15
        best = max(best, max(r - active, 4, r // 2))
        if c == 1:
            kept = [zones[0], *[z + 0.01 * active for z in zones[1:]]]
    return best, kept


def test_quants_and_dead_zones(spark):
    rng = np.random.default_rng(8)
    rows, field, want = [], [], {}
    for k in range(42):
        s = SHAPES[k % len(SHAPES)]
        h, w = 8 * s.rows, 8 * s.cols
        spread = (0.02, 0.2, 0.45, 1.0, 4.0, 12.0)[k // 7]
        raw = int(rng.integers(2, 250))
        co = np.stack([rng.normal(0, spread, (h, w)) * tilings.weights(s, c) / (0.05 * raw) for c in range(3)])
        if k % 2:
            co *= rng.random((3, h, w)) < 0.1
        want[k] = plain_choice(co, s.name, raw, 0.05)
        field.append((k, 0, raw))
        rows += [(c, k, 0, s.name, v, u, float(co[c, v, u])) for c in range(3) for v in range(h) for u in range(w)]
    stats = deadzones.statistics(spark.createDataFrame(rows, "channel long, ay long, ax long, shape string, v long, u long, value double"), spark.createDataFrame(field, "ay long, ax long, raw long"), 0.05)
    got = {r.ay: r for r in deadzones.choose(stats).collect()}
    for k, (raw, zones) in want.items():
        assert got[k].raw == raw, k
        assert [got[k][f"zone{i}"] for i in range(4)] == pytest.approx(zones), k
