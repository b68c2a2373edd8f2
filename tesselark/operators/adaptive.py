"""Fields of quants: where they start, what a field costs in fidelity, and the loop that adapts them.

A round of the loop evaluates the whole field and changes every block from what
it got.  Rounds hang on each other, so each one's field is written to the shared
folder, read back, and the one before deleted; a lost executor costs a stage.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.functions import pointwise as pw
from tesselark.operators import halo, metric, orderstats, tilings
from tesselark.operators.fields import BLUE_LIMIT, BLUE_MOST, BLUE_OFFSET, BLUE_SLOPE, GAMMA_BIAS, GAMMA_CUBE, GAMMA_REST, GAMMA_SLOPE, GAMMA_SMALL, GAMMA_TOP, HIGH_LIMIT, HIGH_OFFSET, HIGH_SLOPE
from tesselark.operators.running import Written
from tesselark.operators.stencils import erosion_weights
from tesselark.operators.tilings import BLOCK, BY_NAME

# Fixed values of the first field: quant at a target of one, what a damped field keeps, offsets and limits of differences.
AC_QUANT, KEPT = 0.765, 0.48
DIFFERENCE_OFFSET, DIFFERENCE_LIMIT, MASK_LEAST = 0.019, 0.2, 0.01
#: Weights of the mask's 5x5 blur by squared distance (fixed values).
MASK_TAPS = {0: 1.0, 1: 0.364911248, 2: 0.1688888021, 4: 0.05, 5: 0.221069183, 8: 0.306563504}


def _gamma(v: np.ndarray) -> np.ndarray:
    v = np.maximum(v, 0)
    return (GAMMA_TOP * v * v + GAMMA_SMALL) / (GAMMA_CUBE * v**3 + GAMMA_REST + GAMMA_SMALL)


def _cells(a: np.ndarray, n: int) -> np.ndarray:
    """Sums of n by n cells."""
    return a.reshape(a.shape[0] // n, n, a.shape[1] // n, n).sum((1, 3))


def first_field_of(target: float, rescale: float = 1.0) -> Callable[[list[np.ndarray]], list[np.ndarray]]:
    """quant, strategy mask (both constant in a block) and pixel mask of three opponent channels in whole blocks."""
    scale = AC_QUANT / target * rescale
    dampen = min(1.0, max(0.0, 1 - (target - 2) / 12))
    weights = np.array(erosion_weights(target))

    def work(planes: list[np.ndarray]) -> list[np.ndarray]:
        x, y, b = planes
        h, w = y.shape
        wide = np.pad(y, 1, mode="edge")
        around = (wide[2:, 1:-1] + wide[:-2, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:]) / 4
        difference = (y - around) / _gamma(y + DIFFERENCE_OFFSET)
        mask = np.pad(1 / (np.log1p(np.abs(difference)) + MASK_LEAST), 2, mode="symmetric")
        taps = {(dy, dx): MASK_TAPS[dy * dy + dx * dx] for dy in range(-2, 3) for dx in range(-2, 3)}
        mask = sum(t * mask[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w] for (dy, dx), t in taps.items()) / sum(taps.values())
        active = 0.25 * np.sqrt(np.minimum(difference**2, DIFFERENCE_LIMIT) * (pw.SQRT_SCALE * 1e8) ** 0.5 + pw.SQRT_OFFSET)
        quiet = np.pad(_cells(active, 4) / 4, 1, mode="edge")
        near = np.stack([quiet[1 + dy : 1 + dy + h // 4, 1 + dx : 1 + dx + w // 4] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        quiet = _cells(np.tensordot(weights, np.sort(near, 0)[: len(weights)], 1), 2)
        v = np.maximum(quiet * pw.MASK_SCALE, 1e-3)
        k4, k2, k3 = pw.MASK_TERMS
        base = pw.MASK_BASE + k4 / (v * v + 0.25 * pw.MASK_OFFSET_3) + k2 / (v + pw.MASK_OFFSET_2) + k3 / (v * v + pw.MASK_OFFSET_3)
        base = base + GAMMA_SLOPE * np.log2(_cells(_gamma(y + GAMMA_BIAS - x) + _gamma(y + GAMMA_BIAS + x), BLOCK) / (2 * BLOCK * BLOCK))
        right, below = np.minimum(np.abs(np.diff(y, axis=1, append=0)), HIGH_LIMIT), np.minimum(np.abs(np.diff(y, axis=0, append=0)), HIGH_LIMIT)
        right[:, BLOCK - 1 :: BLOCK], below[BLOCK - 1 :: BLOCK] = 0, 0  # differences stay inside a block
        high = _cells(right + below, BLOCK) * HIGH_SLOPE + HIGH_OFFSET
        blue = _cells(np.clip(b - y - BLUE_OFFSET - np.abs(x), 0, BLUE_LIMIT), BLOCK)
        blue = np.where(blue >= 32 * BLUE_LIMIT, 64 * BLUE_LIMIT - blue, blue)
        blue = np.minimum(blue, BLUE_MOST * BLUE_LIMIT) * BLUE_SLOPE
        quant = np.exp(base + np.minimum(high, blue)) * scale * dampen + (1 - dampen) * KEPT * scale
        blocks = [np.repeat(np.repeat(a, BLOCK, 0), BLOCK, 1) for a in (quant, 1 / (quiet + 0.001))]
        return [*blocks, mask]

    return work


def first_field(pixels: DataFrame, target: float, rescale: float = 1.0, tile: int = halo.TILE) -> DataFrame:
    """(y, x, quant, strategy_mask, mask) of opponent channels (y, x, c0, c1, c2) in whole blocks, in one shuffle.

    Quants and strategy masks are those of a sample's block.
    """
    return halo.over_tiles(pixels, ["c0", "c1", "c2"], ["quant", "strategy_mask", "mask"], BLOCK, first_field_of(target, rescale), tile)


# Up to which target the greatest quant of a shape stands for it, and how soon the mean does.
MIX_LIMIT, MIX_SLOPE = 1.54138, 0.56391


def adjusted(field: DataFrame, tiling: DataFrame, target: float) -> DataFrame:
    """(by, bx, ay, ax, shape, quant): one quant for all blocks of a shape, its greatest or, for four and more, mixed with the mean."""
    share = min(1.0, max(0.0, 1 - (target - MIX_LIMIT) * MIX_SLOPE))
    both = tiling.join(field.select("by", "bx", "quant"), ["by", "bx"])
    most, mean = F.max("quant"), F.avg("quant")
    of_shape = both.groupBy("ay", "ax").agg(F.when(F.count("*") >= 4, most * share + mean * (1 - share)).otherwise(most).alias("quant"))
    return tiling.join(of_shape, ["ay", "ax"]).select("by", "bx", "ay", "ax", "shape", "quant")


#: Raw quants are whole, from 1 on.
MOST_RAW = 255
DC_QUANT, DC_POWER, DC_SLOPE, DC_MOST = 1.095924047623553, 0.83, 0.3, 50.0  # fixed values


def first_quant_dc(target: float) -> float:
    """The quant of block means at a target."""
    return min(DC_QUANT / max(target / 2, min(target, DC_SLOPE * (target / DC_SLOPE) ** DC_POWER)), DC_MOST)


def scale_of(field: DataFrame, quant_dc: float) -> float:
    """What a raw quant of one stands for, from median and deviation of the field; one row reaches the driver."""
    stats = orderstats.median_mad(field.select(F.lit(0).alias("all"), "quant"), ["all"], "quant")
    row = orderstats.quantizer(stats, F.lit(quant_dc)).first()
    return row["global_scale"] / orderstats.SCALE_DENOMINATOR


def adapt(field: DataFrame, evaluate: Callable[[DataFrame], DataFrame], target: float, rounds: int = 4) -> tuple[DataFrame, list[float]]:
    """(field with quant and distance, the greatest distance before each round and at the end).

    ``field`` is that of :func:`adjusted`.  ``evaluate`` gets it with the quants
    as they will be coded (whole multiples of the scale) and returns by, bx and
    distance.  A block that is too far gets a quant greater in proportion, at
    least by one raw step; one that is near enough loses some in the first two
    rounds only.  Before the second update no quant may be below 0.4 of itself
    and 0.6 of where it began.  Bounds follow from the first field.
    """
    store = Written(field.sparkSession)
    state, at = store.write(field.withColumn("first", F.col("quant")))
    low, high = state.agg(F.min("quant"), F.max("quant")).first()
    if low is None:
        return state.drop("first").withColumn("distance", F.lit(None).cast("double")), []
    spread = math.sqrt(250 * low / high)
    uneven = min(2.0, spread)
    bounded = lambda q: F.least(F.greatest(q, F.lit(low / (uneven * spread))), F.lit(high * spread / uneven))
    history, quant_dc = [], first_quant_dc(target)
    for i in range(rounds + 1):
        scale = scale_of(state, quant_dc)
        raw = F.floor(F.col("quant") / scale + 0.5)
        coded = state.withColumn("quant", F.least(F.greatest(raw, F.lit(1)), F.lit(MOST_RAW)) * scale)
        judged, judged_at = store.write(state.join(evaluate(coded).select("by", "bx", "distance"), ["by", "bx"]))
        history.append(judged.agg(F.max("distance")).first()[0])
        store.delete(at)
        if i == rounds:
            return judged.drop("first"), history
        q = F.col("quant")
        if i == 1:
            least = 0.4 * q + 0.6 * F.col("first")
            q = F.when(q < least, bounded(least)).otherwise(q)
        off = F.col("distance") / target
        grown = q * off
        same = F.floor(q / scale + 0.5) == F.floor(grown / scale + 0.5)
        near = q * F.pow(off, F.lit(0.2)) if i < 2 else q
        new = F.when(off <= 1, near).when(same, q + scale).otherwise(grown)
        state, at = store.write(judged.select("by", "bx", "ay", "ax", "shape", bounded(new).alias("quant"), "first"))
        store.delete(judged_at)
    raise ValueError("rounds is negative")


def coded_tiles(pixels: DataFrame, field: DataFrame) -> DataFrame:
    """(y, x, c0, c1, c2, r0, r1, r2): channels and what is left of them after rounding under the field's tiling and quants.

    ``field`` has by, bx, ay, ax, shape and quant.  Samples and blocks meet by
    tile; the middle channel is taken off the last one, as coded.
    """

    def run(key: tuple, p: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        height, width = (int(f[c].max() % 8 + 1) * BLOCK for c in ("by", "bx"))
        p = p.sort_values(["y", "x"])
        planes = p[["c0", "c1", "c2"]].to_numpy().T.reshape(3, height, width)
        anchors = f[(f["by"] == f["ay"]) & (f["bx"] == f["ax"])]
        out = np.zeros_like(planes)
        for name, of in anchors.groupby("shape"):
            s = BY_NAME[name]
            h, w = BLOCK * s.rows, BLOCK * s.cols
            unit = math.sqrt(h * w)
            at = (of["ay"].to_numpy() % 8 * BLOCK)[:, None, None] + np.arange(h)[None, :, None], (of["ax"].to_numpy() % 8 * BLOCK)[:, None, None] + np.arange(w)[None, None, :]
            quant = of["quant"].to_numpy()[:, None, None]
            kept = {}
            for c in (1, 0, 2):
                step = tilings.weights(s, c) / quant
                value = tilings.basis(h) @ planes[c][at] @ tilings.basis(w).T / unit
                value = value - kept[1] if c == 2 else value
                kept[c] = np.rint(value / step) * step + (kept[1] if c == 2 else 0)
                out[c][at] = unit * tilings.basis(h).T @ kept[c] @ tilings.basis(w)
        return p[["y", "x", "c0", "c1", "c2"]].assign(**{f"r{c}": out[c].ravel() for c in range(3)})

    tiles = tilings._tiles(pixels, "y", "x", tilings.TILE).groupBy("ty", "tx").cogroup(tilings._tiles(field, "by", "bx", tilings.TILE // BLOCK).groupBy("ty", "tx"))
    return tiles.applyInPandas(run, "y long, x long, " + ", ".join(f"{c}{i} double" for c in "cr" for i in range(3)))


def seen_error(channels: list[np.ndarray]) -> list[np.ndarray]:
    """How different three channels and three others look, for each sample."""
    return [metric.band_difference(halo.bands_of(channels[:3]), halo.bands_of(channels[3:]))]


def coding_distance(pixels: DataFrame, light: float, tile: int = halo.TILE) -> Callable[[DataFrame], DataFrame]:
    """An evaluation for :func:`adapt`: codes the channels under a field and tells each block its shape's distance.

    The distance is 1.2 times the sixteenth-power mean of the shape's errors;
    channels are widened by ``light`` first.
    """

    def evaluate(field: DataFrame) -> DataFrame:
        rows = coded_tiles(pixels, field)
        rows = rows.select("y", "x", *[(F.col(c) * light).alias(c) for c in rows.columns[2:]])
        error = halo.over_tiles(rows, rows.columns[2:], ["error"], halo.BANDS_HALO + metric.STAGES_HALO, seen_error, tile)
        of_block = error.groupBy(F.expr(f"y div {BLOCK}").alias("by"), F.expr(f"x div {BLOCK}").alias("bx")).agg(F.avg(F.pow("error", F.lit(16.0))).alias("power"))
        of_shape = field.join(of_block, ["by", "bx"]).groupBy("ay", "ax").agg((1.2 * F.pow(F.avg("power"), F.lit(1 / 16))).alias("distance"))
        return field.join(of_shape, ["ay", "ax"]).select("by", "bx", "distance")

    return evaluate
