"""Wavefronts against walks over the samples in plain Python."""

import math

import numpy as np
import pytest

from tesselark.operators import wavefronts as wf


def frame(spark, planes, names):
    """Planes (channel lists of (p, h, w)) as rows."""
    rows = [(p, y, x, *[a[p, y, x].item() for a in planes]) for p in range(len(planes[0])) for y in range(planes[0].shape[1]) for x in range(planes[0].shape[2])]
    kind = "long" if planes[0].dtype == np.int64 else "double"
    return spark.createDataFrame(rows, "plane long, y long, x long, " + ", ".join(f"{n} {kind}" for n in names))


def around(v, y, x):
    h, w = len(v), len(v[0])
    left = v[y][x - 1] if x else v[y - 1][x] if y else 0
    top = v[y - 1][x] if y else left
    return left, top, v[y - 1][x - 1] if x and y else left, v[y - 1][x + 1] if y and x + 1 < w else top, v[y - 2][x] if y > 1 else top


class Walk:
    """The weighted predictor one sample at a time; ``off`` gains what a later sample adds to its upper right neighbour."""

    def __init__(self, w):
        self.w, self.error, self.off = w, {}, {}

    def predict(self, v, y, x):
        left, top, tl, tr, tt = (8 * n for n in around(v, y, x))
        near = [x, x + 1 if x + 1 < self.w else x, x - 1 if x else x]
        weights = []
        for k in range(4):
            e = sum(self.off.get((k, y - 1, c), 0) for c in near)
            s = max(0, (e + 1).bit_length() - 6)
            weights.append(4 + ((wf.MOST_WEIGHT[k] * ((1 << 24) // ((e >> s) + 1))) >> s))
        s = sum(weights).bit_length() - 5
        weights = [n >> s for n in weights]
        el, et, er, eb = self.error.get((y, x - 1), 0), *(self.error.get((y - 1, c), 0) for c in near)
        worst = el
        for e in (et, eb, er):
            worst = e if abs(e) > abs(worst) else worst
        f = wf.GUESS_FACTORS
        self.guesses = [left + tr - top, top - (((et + el + er) * f[0]) >> 5), left - (((et + el + eb) * f[1]) >> 5), top - ((eb * f[2] + et * f[3] + er * f[4] + (tt - top) * f[5] + (tl - left) * f[6]) >> 5)]
        n = sum(weights)
        self.mix = (((n >> 1) - 1 + sum(g * q for g, q in zip(self.guesses, weights, strict=True))) * ((1 << 24) // n)) >> 24
        if ((et ^ el) | (et ^ eb)) <= 0:
            self.mix = min(max(self.mix, min(left, tr, top)), max(left, tr, top))
        return (self.mix + 3) >> 3, worst

    def update(self, value, y, x):
        self.error[y, x] = self.mix - 8 * value
        for k, g in enumerate(self.guesses):
            e = (abs(g - 8 * value) + 3) >> 3
            self.off[k, y, x] = e
            self.off[k, y - 1, x + 1] = self.off.get((k, y - 1, x + 1), 0) + e


@pytest.mark.parametrize("size", [(1, 1), (1, 9), (7, 1), (2, 2), (9, 13)])
def test_weighted_predictions(spark, size):
    rng = np.random.default_rng(sum(size))
    planes = rng.integers(-300, 300, (19, *size))
    planes[3] = np.arange(size[0] * size[1]).reshape(size) * 5
    planes[4] = 12
    planes[5] *= 10**6
    got = {(r.plane, r.y, r.x): r for r in wf.weighted_residuals(frame(spark, [planes], ["value"])).collect()}
    assert len(got) == planes.size
    for p, v in enumerate(planes.tolist()):
        walk = Walk(size[1])
        for y in range(size[0]):
            for x in range(size[1]):
                guess, worst = walk.predict(v, y, x)
                walk.update(v[y][x], y, x)
                r, rest = got[p, y, x], v[y][x] - guess
                run = next(c for end, c in zip(wf.CONTEXT_ENDS, wf.CONTEXTS, strict=True) if min(max(512 + worst, 0), 1023) <= end)
                assert (r.prediction, r.context, r.token) == (guess, run, 2 * rest if rest >= 0 else -2 * rest - 1)


@pytest.mark.parametrize("weighted", [False, True])
def test_levels_rounded_by_prediction(spark, weighted):
    rng = np.random.default_rng(4)
    size, steps = (11, 8), (0.5, 2.0, 1.25)
    channels = [rng.normal(0, s, (2, *size)).cumsum(2) for s in (1, 4, 3)]
    got = {(r.plane, r.y, r.x): (r.level0, r.level1, r.level2) for r in wf.predicted_levels(frame(spark, channels, ["c0", "c1", "c2"]), steps, weighted).collect()}
    away = lambda v: math.trunc(v + math.copysign(0.5, v))
    for p in range(2):
        levels = [[[0] * size[1] for _ in range(size[0])] for _ in range(3)]
        for c in (1, 0, 2):
            walk = Walk(size[1])
            for y in range(size[0]):
                for x in range(size[1]):
                    left, top, tl, *_ = around(levels[c], y, x)
                    guess = walk.predict(levels[c], y, x)[0] if weighted else min(max(top + left - tl, min(top, left)), max(top, left))
                    value = channels[c][p, y, x] - (levels[1][y][x] * steps[1] if c == 2 else 0)
                    rest = value / steps[c] - guess
                    rest = 0 if -0.62 < rest < 0.62 else rest
                    levels[c][y][x] = guess + (away(rest / 2) * 2 if abs(away(rest)) > 2 else away(rest))
                    if weighted:
                        walk.update(levels[c][y][x], y, x)
        for y in range(size[0]):
            for x in range(size[1]):
                assert got[p, y, x] == tuple(levels[c][y][x] for c in range(3))


def test_groups_know_nothing_of_each_other(spark, monkeypatch):
    monkeypatch.setattr(wf, "SIDE", 4)
    v = np.random.default_rng(1).integers(0, 50, (1, 6, 9))
    got = {(r.y, r.x): r.prediction for r in wf.weighted_residuals(frame(spark, [v], ["value"])).collect()}
    for y0 in (0, 4):
        for x0 in (0, 4, 8):
            part = v[:, y0 : y0 + 4, x0 : x0 + 4]
            guess = wf.weighted_predictions(part)[0]
            assert all(got[y + y0, x + x0] == guess[0, y, x] for y in range(part.shape[1]) for x in range(part.shape[2]))


def test_fronts_cover_each_sample_after_those_it_needs():
    for h, w in ((1, 1), (3, 1), (1, 4), (5, 7)):
        seen = set()
        for ys, xs in wf.fronts(h, w):
            now = list(zip(ys.tolist(), xs.tolist(), strict=True))
            for y, x in now:
                assert all((b, a) in seen for b, a in ((y, x - 1), (y - 1, x), (y - 1, x + 1), (y - 2, x)) if 0 <= a < w and b >= 0)
            seen.update(now)
        assert seen == {(y, x) for y in range(h) for x in range(w)}


def test_an_empty_table_gives_no_rows(spark):
    assert wf.weighted_residuals(spark.createDataFrame([], "plane long, y long, x long, value long")).count() == 0
