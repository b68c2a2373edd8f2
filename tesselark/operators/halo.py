"""Wide stencils over tiles with a halo: every sample travels to the tiles that need it, once.

A plane is cut into square tiles.  A sample goes to its own tile and to those
beside it whose halo it lies in, four at most where the halo is under half a
tile.  A task works on whole tiles in numpy, cut off at the plane's edges, and
returns the inner part; any number of passes and bands take one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.functions.pointwise import CLAMP_SLOPE, SUPPRESS, SUPPRESS_LEAST
from tesselark.operators.fields import SIGMA_LEAST, SIGMA_UNIT
from tesselark.operators.stencils import CHANNEL_SCALE, DIAMOND, EDGE_SCALE, LEAST_SIGMA, PLUS, SIGMA_SCALE

#: Rows and columns of a tile.
TILE = 256


def over_tiles(plane: DataFrame, inputs: list[str], outputs: list[str], halo: int, work: Callable[[list[np.ndarray]], list[np.ndarray]], tile: int = TILE) -> DataFrame:
    """(y, x, outputs) of a stencil of ``halo`` samples either way on the columns ``inputs``.

    ``work`` gets the inputs of a tile with its halo, as arrays that end where
    the plane ends, and returns as many arrays of that size as ``outputs`` has
    names; samples nearer than ``halo`` to a side that is not the plane's edge
    may be wrong.  The plane (y, x from 0) has no gaps.
    """

    def tiles(at: str) -> F.Column:
        """Tiles whose halo holds the place: those from the one at the place less the halo to the one at it plus the halo."""
        return F.explode(F.sequence(F.floor((F.col(at) - halo) / tile).cast("long"), F.floor((F.col(at) + halo) / tile).cast("long")))

    spread = plane.select(tiles("y").alias("ty"), "y", "x", *inputs).select("ty", tiles("x").alias("tx"), "y", "x", *inputs)
    spread = spread.where("ty >= 0 and tx >= 0")

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(p["y"].min()), int(p["x"].min())
        y, x = p["y"].to_numpy() - y0, p["x"].to_numpy() - x0
        arrays = []
        for c in inputs:
            a = np.zeros((y.max() + 1, x.max() + 1))
            a[y, x] = p[c].to_numpy()
            arrays.append(a)
        inner = (p["y"].to_numpy() // tile == key[0]) & (p["x"].to_numpy() // tile == key[1])
        y, x = y[inner], x[inner]
        found = {"y": y + y0, "x": x + x0}
        if len(y):  # a tile past the plane's end has a halo only
            found |= {name: a[y, x] for name, a in zip(outputs, work(arrays), strict=True)}
        else:
            found |= {name: np.zeros(0) for name in outputs}
        return pd.DataFrame(found)

    return spread.groupBy("ty", "tx").applyInPandas(run, "y long, x long, " + ", ".join(f"{c} double" for c in outputs))


def radius(sigma: float) -> int:
    return max(1, int(2.25 * abs(sigma)))


def _along(a: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Weighted sums along an axis; beyond the ends lies nothing."""
    r, n = len(weights) // 2, a.shape[axis]
    out = np.zeros_like(a)
    for d, w in zip(range(-r, r + 1), weights.tolist(), strict=True):
        if abs(d) < n:
            to, of = [slice(None)] * 2, [slice(None)] * 2
            to[axis], of[axis] = slice(max(0, -d), n - max(0, d)), slice(max(0, d), n - max(0, -d))
            out[tuple(to)] += w * a[tuple(of)]
    return out


def blurred(a: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian blur: five taps mirror the plane at its edges, wider ones weigh what there is."""
    r = radius(sigma)
    weights = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    if r == 2:
        weights /= weights.sum()
        for axis in (1, 0):
            n = a.shape[axis]
            at = np.arange(-r, n + r) % (2 * n)
            wide = np.take(a, np.where(at < n, at, 2 * n - 1 - at), axis)
            a = _along(wide, weights, axis)
            a = a[:, r:-r] if axis else a[r:-r]
        return a
    for axis in (1, 0):
        share = _along(np.ones((a.shape[axis], 1)), weights, 0).reshape((-1, 1) if axis == 0 else (1, -1))
        a = _along(a, weights, axis) / share
    return a


# Blur widths of the bands, what the low band's channels are scaled by, and the ranges of the others.
LOW, HIGH, ULTRA = 7.15593339443, 3.22489901262, 1.56416327805
LOW_SCALE, LOW_Y_TO_B = (33.832837186260, 14.458268100570, 49.87984651440), -0.362267051518
MEDIUM_REMOVED, MEDIUM_AMPLIFIED = 0.29, 0.1
HIGH_REMOVED, HIGH_CLAMP, HIGH_SCALE, HIGH_AMPLIFIED = 1.5, 28.4691806922, 2.155, 0.132
ULTRA_REMOVED, ULTRA_CLAMP, ULTRA_SCALE = 0.04, 5.19175294647, 2.69313763794
#: What the bands take around a sample.
BANDS_HALO = radius(LOW) + radius(HIGH) + radius(ULTRA)
BANDS = ("low_x", "low_y", "low_b", "medium_x", "medium_y", "medium_b", "high_x", "high_y", "ultra_x", "ultra_y")


def _removed(v: np.ndarray, width: float) -> np.ndarray:
    return np.sign(v) * np.maximum(np.abs(v) - width, 0)


def _amplified(v: np.ndarray, width: float) -> np.ndarray:
    return np.where(np.abs(v) > width, v + np.sign(v) * width, 2 * v)


def _clamped(v: np.ndarray, most: float) -> np.ndarray:
    edge = np.clip(v, -most, most)
    return edge + (v - edge) * CLAMP_SLOPE


def bands_of(planes: list[np.ndarray]) -> list[np.ndarray]:
    """The frequency bands of three opponent channels, in the order of BANDS.

    What a blur leaves is the next band's source.  The last channel has no high
    bands; the first one's high band fades where the second one's is strong.
    """
    low = [blurred(p, LOW) for p in planes]
    rest = [p - q for p, q in zip(planes, low, strict=True)]
    medium = [blurred(p, HIGH) for p in rest]
    high = [rest[c] - medium[c] for c in (0, 1)]
    low[2] = low[2] + LOW_Y_TO_B * low[1]
    low = [p * s for p, s in zip(low, LOW_SCALE, strict=True)]
    medium[:2] = _removed(medium[0], MEDIUM_REMOVED), _amplified(medium[1], MEDIUM_AMPLIFIED)
    high[0] = high[0] * (SUPPRESS / (high[1] ** 2 + SUPPRESS) * (1 - SUPPRESS_LEAST) + SUPPRESS_LEAST)
    smooth = [blurred(p, ULTRA) for p in high]
    clamped = _clamped(smooth[1], HIGH_CLAMP)
    ultra = [_removed(high[0] - smooth[0], ULTRA_REMOVED), _clamped(high[1] - clamped, ULTRA_CLAMP) * ULTRA_SCALE]
    high = [_removed(smooth[0], HIGH_REMOVED), _amplified(clamped * HIGH_SCALE, HIGH_AMPLIFIED)]
    return [*low, *medium, *high, *ultra]


def frequency_bands(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """(y, x, BANDS) of a plane of opponent channels (y, x, c0, c1, c2), in one shuffle."""
    return over_tiles(pixels, ["c0", "c1", "c2"], list(BANDS), BANDS_HALO, bands_of, tile)


# Fixed values of the adapted colours: the mixing matrix with its biases, the response and the least values.
MIX = ((0.29956550340058319, 0.63373087833825936, 0.077705617820981968), (0.22158691104574774, 0.69391388044116142, 0.0987313588422), (0.02, 0.02, 0.20480129041026129))
MIX_BIAS = (1.7557483643287353, 1.7557483643287353, 12.226454707163354)
RESPONSE, RESPONSE_BIAS, RESPONSE_OFFSET = 19.245013259874995, 9.9710635769299145, -23.16046239805755
ADAPT_BLUR, LEAST = 1.2, 1e-4


def adapted(intensity: float) -> Callable[[list[np.ndarray]], list[np.ndarray]]:
    """Opponent colours of linear light, each receptor scaled by its response to the light around, blurred."""

    def mixed(planes: list[np.ndarray], c: int) -> np.ndarray:
        return sum(p * intensity * m for p, m in zip(planes, MIX[c], strict=True)) + MIX_BIAS[c]

    def work(planes: list[np.ndarray]) -> list[np.ndarray]:
        around = [blurred(p, ADAPT_BLUR) for p in planes]
        seen = []
        for c in range(3):
            base = np.maximum(mixed(around, c), MIX_BIAS[c])
            response = RESPONSE * np.log(base + RESPONSE_BIAS) + RESPONSE_OFFSET
            seen.append(np.maximum(mixed(planes, c) * np.maximum(response / base, LEAST), MIX_BIAS[c]))
        return [seen[0] - seen[1], seen[0] + seen[1], seen[2]]

    return work


def adapted_colours(pixels: DataFrame, intensity: float = 80.0, tile: int = TILE) -> DataFrame:
    """(y, x, c0, c1, c2): difference and sum of the first two adapted receptors, and the third, of linear light (same columns)."""
    return over_tiles(pixels, ["c0", "c1", "c2"], ["c0", "c1", "c2"], radius(ADAPT_BLUR), adapted(intensity), tile)


# Fixed values of the edge-preserving filter: what differences count in its first and last pass.
FIRST_SCALE, LAST_SCALE = 0.9, 6.5
#: Rows and columns of a block.
BLOCK = 8
#: Passes: neighbours that are mixed in, places that are compared, and what the block's inverse sigma is scaled by.
PASSES = ((DIAMOND, PLUS, FIRST_SCALE), (PLUS, PLUS, 1.0), (PLUS, [(0, 0)], LAST_SCALE))
#: Passes of a filter of one, two and three iterations.
ITERATIONS = {1: PASSES[1:2], 2: PASSES[1:], 3: PASSES}


def filtered(iterations: int) -> Callable[[list[np.ndarray]], list[np.ndarray]]:
    """Channels after the filter's passes, from three channels and each sample's inverse sigma; arrays begin at a block."""

    def one(channels: np.ndarray, sigma: np.ndarray, mixed: list, compared: list, scale: float) -> np.ndarray:
        h, w = sigma.shape
        reach = max(abs(a) + abs(b) for d in mixed for o in compared for a, b in ((d[0] + o[0], d[1] + o[1]),))
        wide = np.pad(channels, ((0, 0), (reach, reach), (reach, reach)), mode="symmetric")
        at = lambda dy, dx: wide[:, reach + dy : reach + dy + h, reach + dx : reach + dx + w]
        y, x = np.arange(h) % BLOCK, np.arange(w) % BLOCK
        edge = np.isin(y, (0, BLOCK - 1))[:, None] | np.isin(x, (0, BLOCK - 1))[None]
        unit = sigma * SIGMA_SCALE * scale * np.where(edge, EDGE_SCALE, 1.0)
        total, out = np.ones((h, w)), channels.copy()
        for dy, dx in mixed:
            if dy or dx:
                gap = sum(np.tensordot(CHANNEL_SCALE, np.abs(at(a, b) - at(a + dy, b + dx)), 1) for a, b in compared)
                weight = np.maximum(gap * unit + 1, 0)
                total += weight
                out += weight * at(dy, dx)
        return np.where(sigma < LEAST_SIGMA, channels, out / total)

    def work(arrays: list[np.ndarray]) -> list[np.ndarray]:
        channels, sigma = np.stack(arrays[:3]), arrays[3]
        for mixed, compared, scale in ITERATIONS[iterations]:
            channels = one(channels, sigma, mixed, compared, scale)
        return list(channels)

    return work


def edge_preserving(pixels: DataFrame, iterations: int = 3, tile: int = TILE) -> DataFrame:
    """(y, x, c0, c1, c2) after one to three passes of the edge-preserving filter, in one shuffle.

    ``pixels`` has y, x, three channels and sigma, the (negative) inverse sigma
    of a sample's block.  A pass mixes a sample with its neighbours, weighted by
    how alike their surroundings are; samples of blocks below the least sigma
    stay.  Edges are mirrored.  ``tile`` is a multiple of 8.
    """
    return over_tiles(pixels, ["c0", "c1", "c2", "sigma"], ["c0", "c1", "c2"], BLOCK, filtered(iterations), tile)


# Fixed values of the sharpness search: candidates near and far, their border, what no smoothing gains, and what errors weigh.
SHARPNESSES, FAR_SHARPNESSES, FAR_TARGET = (0, 2, 7), (0, 4), 4.5
PLAIN_LEAST, PLAIN_BASE, PLAIN_MOST = 0.85970338919928291, 0.98017198824148288, 5.0
BLOCK_ERROR = (12.339445295782363, 1.0, 0.2)
#: Sharpness where no search is worth it: below this target.
DEFAULT_SHARPNESS, LEAST_TARGET = 4, 0.5


def inverse_sigma(level: np.ndarray, sharpness: int, strength: float = 0.46) -> np.ndarray:
    """The filter's inverse width at a level (positive) and a sharpness from 0 to 7."""
    return 1 / np.minimum(SIGMA_LEAST, strength / (level * SIGMA_UNIT) * sharpness / 7)


def sharpness_errors(candidates: tuple[int, ...], iterations: int) -> Callable[[list[np.ndarray]], list[np.ndarray]]:
    """The weighted error of each candidate's filter, from original and restored channels, a mask and levels."""
    work_one = filtered(iterations)

    def work(arrays: list[np.ndarray]) -> list[np.ndarray]:
        first, restored, mask, level = arrays[:3], arrays[3:6], arrays[6], arrays[7]
        out = []
        for s in candidates:
            found = work_one([*restored, inverse_sigma(level, s)])
            out.append(mask**2 * sum(w * (a - b) ** 2 for w, a, b in zip(BLOCK_ERROR, first, found, strict=True)))
        return out

    return work


def sharpness_search(pixels: DataFrame, target: float, iterations: int = 2, tile: int = TILE) -> DataFrame:
    """(by, bx, sharpness): for each block the filter that restores it best, all candidates in one shuffle.

    ``pixels`` has y, x, original channels c0 to c2, restored ones r0 to r2, a
    mask and the level of a sample's block.  A candidate filters the whole
    plane; no smoothing wins unless another one is better by some margin.
    """
    blocks = F.expr(f"y div {BLOCK}").alias("by"), F.expr(f"x div {BLOCK}").alias("bx")
    if target < LEAST_TARGET:
        return pixels.select(*blocks).distinct().withColumn("sharpness", F.lit(DEFAULT_SHARPNESS))
    candidates = FAR_SHARPNESSES if target > FAR_TARGET else SHARPNESSES
    names = [f"e{s}" for s in candidates]
    inputs = ["c0", "c1", "c2", "r0", "r1", "r2", "mask", "level"]
    errors = over_tiles(pixels, inputs, names, BLOCK, sharpness_errors(candidates, iterations), tile)
    of_block = errors.groupBy(*blocks).agg(*[F.sum(n).alias(n) for n in names])
    plain = max(PLAIN_LEAST, PLAIN_BASE ** min(PLAIN_MOST, target))
    best, error = F.lit(candidates[0]), F.col(names[0]) * plain
    for s, n in zip(candidates[1:], names[1:], strict=True):
        best, error = F.when(F.col(n) < error, s).otherwise(best), F.least(error, F.col(n))
    return of_block.select("by", "bx", best.cast("int").alias("sharpness"))
