"""Recurrences that need the samples before, by wavefronts over many planes at once.

A sample that hangs on its left, upper left, upper and upper right neighbours
can be worked on as soon as they are done.  All samples with one x + 2 y are
independent then, so a task walks a group's wavefronts, at most half a group's
width each, in numpy, for TOGETHER planes side by side.  Planes are cut into
groups of SIDE rows and columns which know nothing of each other, so a task
holds TOGETHER * SIDE * SIDE samples of a channel, however large a plane is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and columns of a group, and planes that a task works on together.
SIDE, TOGETHER = 256, 16

# Fixed values of the weighted predictor: what errors and differences count, and the most weight of each guess.
GUESS_FACTORS, MOST_WEIGHT = (16, 10, 7, 7, 7, 0, 0), (13, 12, 12, 12)
RECIPROCAL = (1 << 24) // np.arange(1, 65)

# Contexts of the weighted predictor's error, each up to a last value of 512 + error.
CONTEXT_ENDS = (12, 120, 257, 321, 385, 417, 449, 465, 481, 489, 497, 501, 505, 508, 509, 511, 512, 513, 515, 517, 519, 523, 527, 535, 543, 559, 575, 607, 639, 703, 767, 904, 1012, 1023)
CONTEXTS = (44, 43, 40, 39, 38, 37, 36, 35, 34, 33, 32, 31, 30, 29, 28, 27, 26, 42, 41, 25, 24, 23, 22, 21, 20, 19, 18, 17, 16, 15, 14, 13, 12, 11)


def fronts(h: int, w: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of each wavefront, in order."""
    for d in range(w + 2 * (h - 1) if h and w else 0):
        y = np.arange(max(0, (d - w + 2) // 2), min(h - 1, d // 2) + 1)
        if len(y):
            yield y, d - 2 * y


class Neighbours:
    """Causal neighbours in planes (p, h, w): what lies outside is taken from the nearest that is known."""

    def __init__(self, planes: np.ndarray):
        self.planes = planes

    def at(self, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """(left, top, top left, top right, two above) of the samples, (p, samples) each."""
        v, last = self.planes, self.planes.shape[2] - 1
        above = np.where(y > 0, v[:, y - 1, x], 0)
        left = np.where(x > 0, v[:, y, x - 1], above)
        top = np.where(y > 0, above, left)
        top_left = np.where((x > 0) & (y > 0), v[:, y - 1, x - 1], left)
        top_right = np.where((y > 0) & (x < last), v[:, y - 1, np.minimum(x + 1, last)], top)
        return left, top, top_left, top_right, np.where(y > 1, v[:, np.maximum(y - 2, 0), x], top)


class Weighted:
    """A mix of four guesses, weighted by how far each was off nearby; works on whole numbers alone, with three bits of fraction."""

    def __init__(self, planes: int, h: int, w: int):
        self.w = w
        self.error = np.zeros((planes, h + 1, w), np.int64)  # of the mix; row 0 lies above the planes
        self.off = np.zeros((planes, 4, h + 1, w), np.int64)  # of each guess, in whole values

    def predict(self, y: np.ndarray, x: np.ndarray, neighbours: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(prediction, greatest error nearby)."""
        right, before = np.where(x + 1 < self.w, x + 1, x), np.where(x > 0, x - 1, x)

        def near(column: np.ndarray) -> np.ndarray:
            """What the guesses were off above, with the sample left below it if that is done."""
            done = (column > 0) & (column - 1 < x)
            return self.off[:, :, y, column] + np.where(done, self.off[:, :, y + 1, column - 1], 0)

        off = near(x) + near(right) + near(before)
        shift = np.maximum(np.frexp((off + 1).astype(np.float64))[1] - 6, 0)
        weight = 4 + ((np.array(MOST_WEIGHT)[:, None] * RECIPROCAL[off >> shift]) >> shift)
        weight >>= (np.frexp(weight.sum(1).astype(np.float64))[1] - 5)[:, None]
        total = weight.sum(1)
        e_left = np.where(x > 0, self.error[:, y + 1, x - 1], 0)
        e_top, e_before, e_right = (self.error[:, y, c] for c in (x, before, right))
        worst = e_left
        for e in (e_top, e_before, e_right):
            worst = np.where(np.abs(e) > np.abs(worst), e, worst)
        left, top, top_left, top_right, two_up = (8 * n for n in neighbours)
        a, b, *rest = GUESS_FACTORS
        mixed = sum(f * v for f, v in zip(rest, (e_before, e_top, e_right, two_up - top, top_left - left), strict=True))
        self.guesses = np.stack([left + top_right - top, top - (((e_top + e_left + e_right) * a) >> 5), left - (((e_top + e_left + e_before) * b) >> 5), top - (mixed >> 5)], 1)
        mix = (((total >> 1) - 1 + (self.guesses * weight).sum(1)) * RECIPROCAL[total - 1]) >> 24
        bounds = np.stack([left, top_right, top])
        differ = ((e_top ^ e_left) | (e_top ^ e_before)) <= 0
        self.mix = np.where(differ, np.clip(mix, bounds.min(0), bounds.max(0)), mix)
        return (self.mix + 3) >> 3, worst

    def update(self, y: np.ndarray, x: np.ndarray, value: np.ndarray) -> None:
        scaled = 8 * value
        self.error[:, y + 1, x] = self.mix - scaled
        self.off[:, :, y + 1, x] = (np.abs(self.guesses - scaled[:, None]) + 3) >> 3


def weighted_predictions(planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(predictions, errors nearby) of integer planes (p, h, w)."""
    guess, worst = np.zeros_like(planes), np.zeros_like(planes)
    state, around = Weighted(*planes.shape), Neighbours(planes)
    for y, x in fronts(*planes.shape[1:]):
        guess[:, y, x], worst[:, y, x] = state.predict(y, x, around.at(y, x))
        state.update(y, x, planes[:, y, x])
    return guess, worst


def rounded_by_prediction(channels: list[np.ndarray], steps: tuple[float, float, float], weighted: bool) -> list[np.ndarray]:
    """Levels of three channels (p, h, w), rounded so that what the decoder predicts from levels is cheap to correct.

    The middle channel goes first; its levels are taken off the last.  A rest
    within 0.62 of the prediction becomes it, one beyond two steps an even number.
    """
    levels = [np.zeros(c.shape, np.int64) for c in channels]
    for c in (1, 0, 2):
        around = Neighbours(levels[c])
        state = Weighted(*channels[c].shape)
        for y, x in fronts(*channels[c].shape[1:]):
            near = around.at(y, x)
            left, top, top_left = near[:3]
            guess = state.predict(y, x, near)[0] if weighted else np.clip(top + left - top_left, np.minimum(top, left), np.maximum(top, left))
            value = channels[c][:, y, x]
            if c == 2:
                value = value - levels[1][:, y, x] * steps[1]
            rest = value / steps[c] - guess
            rest = np.where(np.abs(rest) < 0.62, 0.0, rest)
            near_int = np.trunc(rest + np.copysign(0.5, rest))
            far = np.trunc(rest / 2 + np.copysign(0.5, rest)) * 2
            levels[c][:, y, x] = guess + np.where(np.abs(near_int) > 2, far, near_int).astype(np.int64)
            if weighted:
                state.update(y, x, levels[c][:, y, x])
    return levels


def over_groups(rows: DataFrame, inputs: list[str], outputs: list[str], work: Callable[[list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
    """(plane, y, x, outputs) of ``work`` on the groups of planes (long ``plane``, y, x from 0, no gaps); outputs are longs.

    Groups at one place of TOGETHER planes in a row are one unit of work; those
    of one size go through together.
    """
    placed = rows.select("plane", "y", "x", *inputs, F.expr(f"y div {SIDE}").alias("gy"), F.expr(f"x div {SIDE}").alias("gx"), F.floor(F.col("plane") / TOGETHER).alias("batch"))

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = key[1] * SIDE, key[2] * SIDE
        sizes = f.groupby("plane").agg(h=("y", "max"), w=("x", "max")).reset_index()
        out = []
        for (h, w), of in sizes.groupby(["h", "w"]):
            h, w = int(h) - y0 + 1, int(w) - x0 + 1
            names = of["plane"].to_numpy()
            part = f[f["plane"].isin(names)].sort_values(["plane", "y", "x"])
            found = work([part[c].to_numpy().reshape(len(names), h, w) for c in inputs])
            out.append(part[["plane", "y", "x"]].assign(**{c: a.ravel() for c, a in zip(outputs, found, strict=True)}))
        return pd.concat(out)

    return placed.groupBy("batch", "gy", "gx").applyInPandas(run, "plane long, y long, x long, " + ", ".join(f"{c} long" for c in outputs))


def weighted_residuals(rows: DataFrame) -> DataFrame:
    """(plane, y, x, prediction, context, token) of integer planes under the weighted predictor.

    A token is the signed residual packed; its context is that of the greatest
    error of the predictor nearby.
    """

    def work(planes: list[np.ndarray]) -> list[np.ndarray]:
        guess, worst = weighted_predictions(planes[0])
        context = np.array(CONTEXTS)[np.searchsorted(CONTEXT_ENDS, np.clip(512 + worst, 0, 1023))]
        rest = planes[0] - guess
        return [guess, context, np.where(rest >= 0, 2 * rest, -2 * rest - 1)]

    return over_groups(rows, ["value"], ["prediction", "context", "token"], work)


def predicted_levels(rows: DataFrame, steps: tuple[float, float, float], weighted: bool = False) -> DataFrame:
    """(plane, y, x, level0, level1, level2) of three channels c0, c1, c2; see :func:`rounded_by_prediction`."""
    return over_groups(rows, ["c0", "c1", "c2"], ["level0", "level1", "level2"], lambda channels: rounded_by_prediction(channels, steps, weighted))
