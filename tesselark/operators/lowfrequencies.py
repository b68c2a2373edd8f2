"""Low frequencies of mixed shapes, and the means of the blocks that shapes cover."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.operators.tilings import BLOCK, SHAPES


def shrink(n: int, k: int) -> float:
    """What a low frequency of n blocks is worth among their means: a mean over 8 samples instead of each sample."""
    a = math.pi * k / (16 * n)
    return 1.0 if k == 0 else math.cos(a) * math.cos(2 * a) * math.cos(4 * a)


def _wave(n: int, k: int, i: int) -> float:
    return math.sqrt(1 if k == 0 else 2) * math.cos(math.pi * k * (2 * i + 1) / (2 * n))


def resampling(forward: bool) -> list[tuple[str, int, int, int, int, float]]:
    """(shape, v, u, y, x, weight): what a low frequency adds to a block's mean, or (forward) a mean to a low frequency.

    As many rows as the shapes' block counts squared, 409.
    """
    out = []
    for s in SHAPES:
        for v in range(s.rows):
            for u in range(s.cols):
                for y in range(s.rows):
                    for x in range(s.cols):
                        wave = _wave(s.rows, v, y) * _wave(s.cols, u, x)
                        scale = shrink(s.rows, v) * shrink(s.cols, u)
                        out.append((s.name, v, u, y, x, wave / scale / s.blocks if forward else wave * scale))
    return out


def _matrix(df: DataFrame, forward: bool) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(resampling(forward), "shape string, v long, u long, y long, x long, weight double"))


def block_means(coefficients: DataFrame) -> DataFrame:
    """(by, bx, value): means of all blocks, from the low frequencies of their shapes (ay, ax, shape, v, u, value).

    Coefficients are scaled as means are: an orthonormal one divided by the root
    of its shape's samples.  Higher frequencies are ignored.
    """
    both = coefficients.join(_matrix(coefficients, False), ["shape", "v", "u"])
    at = (F.col("ay") + F.col("y")).alias("by"), (F.col("ax") + F.col("x")).alias("bx")
    return both.groupBy(*at).agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def low_frequencies(means: DataFrame, tiling: DataFrame) -> DataFrame:
    """(ay, ax, shape, v, u, value): the low frequencies that block means (by, bx, value) give under a tiling."""
    placed = means.join(tiling, ["by", "bx"]).select("ay", "ax", "shape", (F.col("by") - F.col("ay")).alias("y"), (F.col("bx") - F.col("ax")).alias("x"), "value")
    both = placed.join(_matrix(means, True), ["shape", "y", "x"])
    return both.groupBy("ay", "ax", "shape", "v", "u").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def mean_scaled(coefficients: DataFrame) -> DataFrame:
    """Orthonormal coefficients of shapes, scaled as means are."""
    unit = F.lit(1.0)
    for s in SHAPES:
        unit = F.when(F.col("shape") == s.name, BLOCK * math.sqrt(s.blocks)).otherwise(unit)
    return coefficients.withColumn("value", F.col("value") / unit)
