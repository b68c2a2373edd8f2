"""How different two images look: line energies, asymmetric errors and masking of all bands, in one shuffle a scale."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.functions.pointwise import INTENSITY, MASK_DC_Y, MASK_Y
from tesselark.operators import halo
from tesselark.operators.stencils import LINES

#: Sixteen lines of seven or nine samples: one half's places (dx, dy), the other half mirrors it; the last four are there twice (fixed values).
FULL_LINES = (
    ((1, 0), (2, 0), (3, 0), (4, 0)), ((0, 1), (0, 2), (0, 3), (0, 4)), ((1, 1), (2, 2), (3, 3)), ((-1, 1), (-2, 2), (-3, 3)),
    ((1, 1), (1, 2), (2, 3)), ((-1, 1), (-1, 2), (-2, 3)), ((1, 1), (2, 1), (3, 2)), ((-1, 1), (-2, 1), (-3, 2)),
    *(((0, 1), (-1, 2), (-1, 3), (-1, 4)), ((0, 1), (1, 2), (1, 3), (1, 4)), ((1, 0), (2, 1), (3, 1), (4, 1)), ((1, 0), (2, -1), (3, -1), (4, -1))) * 2,
)
# Fixed values of the line energies, by band (medium, high, ultra) and channel (x, y): weight and norm; and what all share.
LINE_WEIGHT = {"medium": (8246.75321353, 37.0819870399), "high": (6923.99476109, 18.7237414387), "ultra": (173.5, 1.10039032555)}
LINE_NORM = {"medium": (1009002.70582, 130262059.556), "high": (8051.15833247, 4498534.45232), "ultra": (5.0, 71.7800275169)}
SHORT_SCALE, FULL_SCALE, LENGTH, OVER, UNDER, SMALL, BIG = 0.611612573796, 0.39905817637, 3.75, 0.5, 0.33, 0.55, 1.05
# Fixed values of the squared errors: of the high band, which weighs what is lost or added as well, the medium and the low one, by channel.
HIGH_ERROR, MEDIUM_ERROR, LOW_ERROR, ASYMMETRIC, LOST = (400.0, 1.50815703118), (2150.0, 10.6195433239, 16.2176043152), (29.2353797994, 0.844626970982, 0.703646627719), 0.8, 0.4
# Fixed values of the mask: what the high bands count, its root's slope and bias, its blur, its erosion and what its own difference weighs.
ACTIVE_X, ACTIVE_Y, ROOT, ROOT_BIAS, MASK_BLUR, ERODED, MASK_ERROR = 2.5, 0.4, 6.19424080439, 12.61050594197, 2.7, (0.45, 0.3, 0.25), 10.0
STEP = 3
#: What the differences take around a sample of the bands, and of an image.
STAGES_HALO = halo.radius(MASK_BLUR) + STEP
HALO = halo.radius(halo.ADAPT_BLUR) + halo.BANDS_HALO + STAGES_HALO


def line_energy(a: np.ndarray, lines: tuple) -> np.ndarray:
    """Sum over lines of the squared sum along the line; nothing beyond the edges."""
    h, w = a.shape
    wide = np.pad(a, 4)
    at = lambda dx, dy: wide[4 + dy : 4 + dy + h, 4 + dx : 4 + dx + w]
    return sum((a + sum(at(dx, dy) + at(-dx, -dy) for dx, dy in half)) ** 2 for half in lines)


def _outside(a: np.ndarray, b: np.ndarray, small: float, big: float) -> np.ndarray:
    """How far b lies below ``small`` times a (positive) or beyond ``big`` times a (negative), seen from a's side of zero."""
    size, b = np.abs(a), np.where(a < 0, -b, b)
    return np.maximum(small * size - b, 0) - np.maximum(b - big * size, 0)


def line_difference(a: np.ndarray, b: np.ndarray, full: bool, over: float, under: float, norm: float) -> np.ndarray:
    """Energy along lines of how a and b differ, relative to their size; what b loses or adds of a counts once more."""
    scale = (FULL_SCALE if full else SHORT_SCALE) / (2 * LENGTH + 1) * norm / (norm + (np.abs(a) + np.abs(b)) / 2)
    side = np.where(a < 0, -1.0, 1.0)
    difference = scale * (math.sqrt(OVER * over) * (a - b) + math.sqrt(UNDER * under) * side * _outside(a, b, SMALL, BIG))
    return line_energy(difference, FULL_LINES if full else LINES)


def _activity(bands: dict[str, np.ndarray]) -> np.ndarray:
    x, y = (bands[f"high_{c}"] + bands[f"ultra_{c}"] for c in "xy")
    active = np.hypot(x * ACTIVE_X, y * ACTIVE_Y)
    bias = ROOT * ROOT_BIAS
    return halo.blurred(np.sqrt(ROOT * active + bias) - math.sqrt(bias), MASK_BLUR)


def _eroded(a: np.ndarray) -> np.ndarray:
    """The three smallest of a sample, its doubles and its neighbours at STEP, weighted."""
    h, w = a.shape
    wide = np.pad(a, STEP, constant_values=np.inf)
    near = [wide[STEP + dy : STEP + dy + h, STEP + dx : STEP + dx + w] for dy in (-STEP, 0, STEP) for dx in (-STEP, 0, STEP) if dy or dx]
    return np.tensordot(ERODED, np.sort(np.stack([a, 2 * a, 2 * a, *near]), 0)[:3], 1)


def _seen(delta: np.ndarray, constants: tuple) -> np.ndarray:
    scale, multiplier, scaler, offset = constants
    return ((1 + multiplier / (scaler * delta + offset)) / (scale * INTENSITY)) ** 2


def band_difference(first: list[np.ndarray], second: list[np.ndarray], asymmetry: float = 1.0, x_share: float = 1.0) -> np.ndarray:
    """How different two images look at each sample, from their bands in the order of BANDS.

    ``asymmetry`` is how much more what the second image adds weighs than what it loses.
    """
    a, b = (dict(zip(halo.BANDS, x, strict=True)) for x in (first, second))
    power = {"medium": 1.0, "high": math.sqrt(asymmetry), "ultra": asymmetry}
    lows, highs = [], []
    for k, c in enumerate("xyb"):
        low = LOW_ERROR[k] * (a[f"low_{c}"] - b[f"low_{c}"]) ** 2
        high = MEDIUM_ERROR[k] * (a[f"medium_{c}"] - b[f"medium_{c}"]) ** 2
        if c != "b":
            for band in ("ultra", "high", "medium"):
                weight = LINE_WEIGHT[band][k]
                high = high + line_difference(a[f"{band}_{c}"], b[f"{band}_{c}"], band == "ultra", weight * power[band], weight / power[band], LINE_NORM[band][k])
            p, q = a[f"high_{c}"], b[f"high_{c}"]
            high = high + ASYMMETRIC * HIGH_ERROR[k] * (asymmetry * (p - q) ** 2 + _outside(p, q, LOST, 1.0) ** 2 / asymmetry)
        lows.append(low)
        highs.append(high)
    active = _activity(a)
    highs[1] = highs[1] + MASK_ERROR * (active - _activity(b)) ** 2
    mask = _eroded(active)
    low, high = (x_share * parts[0] + parts[1] + parts[2] for parts in (lows, highs))
    return np.sqrt(low * _seen(mask, MASK_DC_Y) + high * _seen(mask, MASK_Y))


def image_difference(intensity: float, asymmetry: float, x_share: float):
    """The difference of two linear images, six channels in a row."""
    adapt = halo.adapted(intensity)

    def work(channels: list[np.ndarray]) -> list[np.ndarray]:
        bands = [halo.bands_of(adapt(side)) for side in (channels[:3], channels[3:])]
        return [band_difference(*bands, asymmetry, x_share)]

    return work


#: The channels of two images side by side.
BOTH = ["c0", "c1", "c2", "r0", "r1", "r2"]
#: What the half-size image's difference adds, and what the whole one loses for it (fixed values).
HALF_SHARE, MIXED = 0.5, 0.3


def difference_map(pixels: DataFrame, intensity: float = 80.0, asymmetry: float = 1.0, x_share: float = 1.0, tile: int = halo.TILE) -> DataFrame:
    """(y, x, difference) of two linear images (y, x, c0 to c2 and r0 to r2) at one scale, in one shuffle."""
    return halo.over_tiles(pixels, BOTH, ["difference"], HALO, image_difference(intensity, asymmetry, x_share), tile)


def visible_difference(pixels: DataFrame, intensity: float = 80.0, asymmetry: float = 1.0, x_share: float = 1.0, tile: int = halo.TILE) -> DataFrame:
    """(y, x, difference) over two scales: the map of the whole images, mixed with that of their half-size means."""
    whole = difference_map(pixels, intensity, asymmetry, x_share, tile)
    cells = F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")
    half = difference_map(pixels.groupBy(*cells).agg(*[F.avg(c).alias(c) for c in BOTH]), intensity, asymmetry, x_share, tile)
    half = half.select(F.col("y").alias("hy"), F.col("x").alias("hx"), F.col("difference").alias("half"))
    both = whole.withColumn("hy", F.expr("y div 2")).withColumn("hx", F.expr("x div 2")).join(half, ["hy", "hx"])
    return both.select("y", "x", (F.col("difference") * (1 - MIXED * HALF_SHARE) + F.col("half") * HALF_SHARE).alias("difference"))
