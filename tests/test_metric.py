"""The visual difference against plain Python."""

import math

import numpy as np
import pytest

from tesselark.functions import pointwise as pw
from tesselark.operators import halo, metric


def at(a, y, x, other=0.0):
    return a[y][x] if 0 <= y < len(a) and 0 <= x < len(a[0]) else other


@pytest.mark.parametrize("lines", [metric.LINES, metric.FULL_LINES])
def test_line_energies(lines):
    assert len(lines) == 16
    a = np.random.default_rng(1).normal(size=(9, 7)).tolist()
    got = metric.line_energy(np.array(a), lines)
    for y in range(9):
        for x in range(7):
            sums = [a[y][x] + sum(at(a, y + s * dy, x + s * dx) for dx, dy in half for s in (1, -1)) for half in lines]
            assert got[y, x] == pytest.approx(sum(s * s for s in sums))


def plain_lines(a, b, full, over, under, norm):
    h, w = a.shape
    m = (metric.FULL_SCALE if full else metric.SHORT_SCALE) / 8.5
    scaled = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            p, q = a[y, x], b[y, x]
            up, down = (m * math.sqrt(k * v) * norm / (norm + (abs(p) + abs(q)) / 2) for k, v in ((0.5, over), (0.33, under)))
            v = up * (p - q)
            small, big = 0.55 * abs(p), 1.05 * abs(p)
            if p < 0:
                v += -down * (q + small) if q > -small else down * (-q - big) if q < -big else 0
            else:
                v += down * (small - q) if q < small else -down * (q - big) if q > big else 0
            scaled[y, x] = v
    return metric.line_energy(scaled, metric.FULL_LINES if full else metric.LINES)


@pytest.mark.parametrize("full", [False, True])
def test_line_differences(full):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(10, 9))
    b = a * rng.choice([0.2, 0.7, 1.0, 1.04, 1.6, -0.5], a.shape)
    a[0] = 0
    assert np.allclose(metric.line_difference(a, b, full, 3.0, 7.0, 5.0), plain_lines(a, b, full, 3.0, 7.0, 5.0), rtol=1e-12)


def plain_difference(first, second, asymmetry, x_share):
    a, b = (dict(zip(halo.BANDS, x, strict=True)) for x in (first, second))
    shape = a["low_x"].shape
    low, high = np.zeros(shape), np.zeros(shape)
    for k, c in enumerate("xyb"):
        share = x_share if c == "x" else 1.0
        low += share * metric.LOW_ERROR[k] * (a[f"low_{c}"] - b[f"low_{c}"]) ** 2
        high += share * metric.MEDIUM_ERROR[k] * (a[f"medium_{c}"] - b[f"medium_{c}"]) ** 2
        if c == "b":
            continue
        for band, power in (("medium", 0.0), ("high", 0.5), ("ultra", 1.0)):
            weight = metric.LINE_WEIGHT[band][k]
            high += share * plain_lines(a[f"{band}_{c}"], b[f"{band}_{c}"], band == "ultra", weight * asymmetry**power, weight / asymmetry**power, metric.LINE_NORM[band][k])
        for y in range(shape[0]):
            for x in range(shape[1]):
                p, q = a[f"high_{c}"][y, x], b[f"high_{c}"][y, x]
                size, own = abs(p), (q if p >= 0 else -q)
                off = 0.4 * size - own if own < 0.4 * size else own - size if own > size else 0
                high[y, x] += share * 0.8 * metric.HIGH_ERROR[k] * (asymmetry * (p - q) ** 2 + off**2 / asymmetry)
    active = []
    for bands in (a, b):
        n = np.sqrt(((bands["high_x"] + bands["ultra_x"]) * 2.5) ** 2 + ((bands["high_y"] + bands["ultra_y"]) * 0.4) ** 2)
        active.append(halo.blurred(np.sqrt(6.19424080439 * n + 6.19424080439 * 12.61050594197) - math.sqrt(6.19424080439 * 12.61050594197), 2.7))
    high += 10 * (active[0] - active[1]) ** 2
    out = np.zeros(shape)
    for y in range(shape[0]):
        for x in range(shape[1]):
            v = active[0][y, x]
            near = sorted([v, 2 * v, 2 * v] + [at(active[0], y + dy, x + dx, math.inf) for dy in (-3, 0, 3) for dx in (-3, 0, 3) if dy or dx])
            mask = 0.45 * near[0] + 0.3 * near[1] + 0.25 * near[2]
            seen = [((1 + m / (s * mask + o)) / (g * pw.INTENSITY)) ** 2 for g, m, s, o in (pw.MASK_DC_Y, pw.MASK_Y)]
            out[y, x] = math.sqrt(low[y, x] * seen[0] + high[y, x] * seen[1])
    return out


@pytest.mark.parametrize(("asymmetry", "x_share"), [(1.0, 1.0), (0.8, 1.4)])
def test_differences_of_bands(asymmetry, x_share):
    rng = np.random.default_rng(3)
    planes = [rng.normal(0, s, (12, 14)) for s in (4, 12, 9)]
    bands = [halo.bands_of(planes), halo.bands_of([p + rng.normal(0, 1, p.shape) for p in planes])]
    got = metric.band_difference(*bands, asymmetry, x_share)
    assert np.allclose(got, plain_difference(*bands, asymmetry, x_share), rtol=1e-10) and (got > 0).all()
    assert (metric.band_difference(bands[0], bands[0]) == 0).all()


def test_two_scales_in_tiles(spark):
    rng = np.random.default_rng(5)
    h, w = 45, 38
    light = [np.clip(rng.normal(0.4, 0.1, (h, w)), 0, 1) for _ in range(3)]
    other = [np.clip(p + rng.normal(0, 0.03, (h, w)), 0, 1) for p in light]
    rows = [(y, x, *[float(p[y, x]) for p in (*light, *other)]) for y in range(h) for x in range(w)]
    pixels = spark.createDataFrame(rows, "y long, x long, " + ", ".join(f"{c} double" for c in metric.BOTH))
    work = metric.image_difference(80.0, 1.0, 1.0)
    whole = work([*light, *other])[0]
    means = [np.array([[p[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].mean() for x in range((w + 1) // 2)] for y in range((h + 1) // 2)]) for p in (*light, *other)]
    half = work(means)[0]
    got = {(r.y, r.x): r.difference for r in metric.visible_difference(pixels, tile=32).collect()}
    assert len(got) == h * w
    for (y, x), v in got.items():
        assert v == pytest.approx(0.85 * whole[y, x] + 0.5 * half[y // 2, x // 2], rel=1e-9)
    assert metric.visible_difference(pixels.limit(0)).count() == 0
