"""Fields of blocks and the small integer codes chosen from them."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselark.functions.pointwise import adjust_quantization_bias, pack_signed
from tesselark.operators.prediction import predictor, segment
from tesselark.operators.stencils import causal, neighbours

# Fixed values of the block modulations.
HIGH_LIMIT, HIGH_SLOPE, HIGH_OFFSET = 0.0206, -0.38, 0.42
GAMMA_BIAS, GAMMA_SLOPE = 0.16, 0.1005613337192697
BLUE_LIMIT, BLUE_OFFSET, BLUE_MOST, BLUE_SLOPE = 0.010474084867598155, 0.0031994768654636393, 15.463398341612438, 0.90590804735610064
# Fixed values of the gamma slope: (a v^2 + small) / (b v^3 + c + small).
GAMMA_SMALL = 1.0e-2
GAMMA_TOP = 18.6580932135 / 73.377132366608819 * math.log(2) * 3 * 226.77216153508914
GAMMA_CUBE, GAMMA_REST = 226.77216153508914 * math.log(2), 7.7825991679894591 * math.log(2)


def gamma_slope(v: Column) -> Column:
    """Slope of the simple gamma curve relative to the cube root's, at light ``v`` (negative: 0)."""
    v = F.greatest(v, F.lit(0.0))
    return (GAMMA_TOP * v * v + GAMMA_SMALL) / (GAMMA_CUBE * v * v * v + GAMMA_REST + GAMMA_SMALL)


def modulations(planes: DataFrame, size: int = 8) -> DataFrame:
    """What texture, brightness and exposed blue add to each block's field (by, bx, high, gamma, blue).

    ``planes`` has y, x and opponent channels c0, c1, c2.  Rows are dealt by
    block once; both neighbour differences and the sums stay in that shuffle.
    """
    p = planes.withColumn("by", F.expr(f"y div {size}")).withColumn("bx", F.expr(f"x div {size}")).repartition("by", "bx")
    gap = [F.abs(F.col("c1") - F.lead("c1").over(Window.partitionBy("by", "bx", a).orderBy(b))) for a, b in (("y", "x"), ("x", "y"))]
    p = p.withColumn("right", gap[0]).withColumn("below", gap[1])
    high = sum((F.least(F.lit(HIGH_LIMIT), F.coalesce(F.col(c), F.lit(0.0))) for c in ("right", "below")), F.lit(0.0))
    light = F.col("c1") + GAMMA_BIAS
    excess = F.col("c2") - (F.col("c1") + BLUE_OFFSET + F.abs("c0"))
    g = p.groupBy("by", "bx").agg(F.sum(high).alias("h"), F.sum(gamma_slope(light - F.col("c0")) + gamma_slope(light + F.col("c0"))).alias("g"), F.sum(F.greatest(F.lit(0.0), F.least(excess, F.lit(BLUE_LIMIT)))).alias("b"))
    area = size * size
    folded = F.when(F.col("b") >= area / 2 * BLUE_LIMIT, area * BLUE_LIMIT - F.col("b")).otherwise(F.col("b"))
    return g.select("by", "bx", (F.col("h") * HIGH_SLOPE + HIGH_OFFSET).alias("high"), (F.log2(F.col("g") * (0.5 / area)) * GAMMA_SLOPE).alias("gamma"), (F.least(folded, F.lit(BLUE_MOST * BLUE_LIMIT)) * BLUE_SLOPE).alias("blue"))


def edge_statistics(planes: DataFrame, size: tuple[int, int]) -> DataFrame:
    """One row: greatest edge of c0, of c2 - c1, and greatest exposed blue, off the first row and column."""
    n = neighbours(planes.select("y", "x", F.struct("c0", "c1", "c2").alias("value")), [(0, 0, "c"), (0, -1, "l"), (-1, 0, "t")], size, "drop")
    g = n.groupBy("y", "x").agg(*[F.max(F.when(F.col("t0") == k, F.col("value"))).alias(k) for k in "clt"]).where("l is not null and t is not null")

    def steps(f) -> list[Column]:
        return [F.abs(f("c") - f(k)) for k in "lt"]

    red = steps(lambda k: F.col(f"{k}.c0"))
    blue = steps(lambda k: F.col(f"{k}.c2") - F.col(f"{k}.c1"))
    bare = F.col("c.c2") - 1.2 * F.col("c.c1")
    exposed = F.when(bare >= 0, bare * sum(steps(lambda k: F.col(f"{k}.c2")), F.lit(0.0))).otherwise(0.0)
    return g.agg(*[F.coalesce(F.max(v), F.lit(0.0)).alias(c) for c, v in (("x_edge", F.greatest(*red)), ("b_edge", F.greatest(*blue)), ("exposed_blue", exposed))])


# Fixed steps of the matrix scales.
TARGET_STEPS, RED_STEPS, BLUE_STEPS, EXPOSED = (2.5, 5.5, 9.5), (0.015, 0.022, 0.026), (0.28, 0.33, 0.38), 0.13


def matrix_scales(stats: DataFrame, target: float) -> DataFrame:
    """``stats`` with the two scale codes: coarser for a greater target, finer where edges are strong."""
    by_target = 3 + sum(target > t for t in TARGET_STEPS)
    red = sum((F.when(F.col("x_edge") >= t, 1).otherwise(0) for t in RED_STEPS), F.lit(2))
    level = segment(F.col("b_edge"), list(BLUE_STEPS))
    blue = F.when(level > 0, level - 1 + F.when(F.col("exposed_blue") >= EXPOSED, 1).otherwise(0)).otherwise(0)
    return stats.select("*", F.greatest(F.lit(by_target), red).cast("int").alias("x_scale"), (blue + 2).cast("int").alias("b_scale"))


#: The properties of a sample that a tree may ask for, by number.
PROPERTIES = ("channel", "stream", "y", "x", "top_size", "left_size", "top", "left", "left_gradient_gap", "slope", "left_step", "top_step", "right_step", "two_up_step", "two_left_step")


def properties(plane: DataFrame, channel: int = 0, stream: int = 0) -> DataFrame:
    """The plane's causal neighbours with the context properties of each sample (struct ``p``)."""
    left, top, tl = F.col("left"), F.col("top"), F.col("top_left")
    c = causal(plane).withColumn("slope", left + top - tl)
    before = F.coalesce(F.lag("slope").over(Window.partitionBy("y").orderBy("x")), F.lit(0))
    found = (F.lit(channel).cast("long"), F.lit(stream).cast("long"), F.col("y"), F.col("x"), F.abs(top), F.abs(left), top, left, left - before, F.col("slope"), left - tl, tl - top, top - F.col("top_right"), top - F.col("top_top"), left - F.col("left_left"))
    return c.withColumn("p", F.struct(*[v.alias(n) for v, n in zip(found, PROPERTIES, strict=True)]))


def leaf(tree: tuple, of: Column) -> Column:
    """What the leaf holds that a sample's properties lead to.

    A node is (property, split, above, not above); a leaf is a 1-tuple of its
    Column.  The tree becomes one nested CASE.
    """
    if len(tree) == 1:
        return tree[0]
    name, split, above, other = tree
    return F.when(of.getField(name) > split, leaf(above, of)).otherwise(leaf(other, of))


def leaf_tokens(plane: DataFrame, tree: tuple) -> DataFrame:
    """(y, x, context, token): residuals under the predictor, and in the context, of each sample's leaf.

    A leaf of ``tree`` is ((context, predictor),).
    """

    def filled(node: tuple, value) -> tuple:
        return (value(*node[0]),) if len(node) == 1 else (*node[:2], filled(node[2], value), filled(node[3], value))

    context = leaf(filled(tree, lambda c, _: F.lit(c)), F.col("p"))
    guess = leaf(filled(tree, lambda _, n: predictor(n)), F.col("p"))
    return properties(plane).select("y", "x", context.cast("long").alias("context"), pack_signed(F.col("value") - guess).alias("token"))


#: Scan order family of each of the 27 transforms, and the context of each (channel row, family) (fixed values).
ORDER_OF = (0, 1, 1, 1, 2, 3, 4, 4, 5, 5, 6, 6, 1, 1, 1, 1, 1, 1, 7, 8, 8, 9, 10, 10, 11, 12, 12)
CONTEXT_OF = (0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3, 3, 3, 3, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3, 3, 3, 3)


def block_context(strategy: Column, channel: Column, level: Column, thresholds: list[int], contexts: list[int]) -> Column:
    """Context of a block: ``contexts`` by channel (the first two swapped), order family and level segment."""
    row = F.when(channel == 0, 1).when(channel == 1, 0).otherwise(2)
    order = F.get(F.array(*map(F.lit, ORDER_OF)), strategy.cast("int"))
    place = (row * (max(ORDER_OF) + 1) + order) * (len(thresholds) + 1) + segment(level, thresholds)
    return F.get(F.array(*map(F.lit, contexts)), place.cast("int"))


def metadata_tokens(anchors: DataFrame, group: str, order: str) -> DataFrame:
    """Tokens of each anchor's transform and level, in the context of the anchor before.

    ``anchors`` has ``code`` and ``level``; a group holds a bounded number of
    them.  The first transform follows code 0, the first level the first code.
    """
    w = Window.partitionBy(group).orderBy(order)
    a = anchors.withColumn("code_before", F.coalesce(F.lag("code").over(w), F.lit(0))).withColumn("level_before", F.coalesce(F.lag("level").over(w), F.col("code")))

    def context(before: str, first: int) -> Column:
        return first + 3 - segment(F.col(before), [3, 5, 11])

    return a.select(order, context("code_before", 7).alias("code_context"), pack_signed(F.col("code")).alias("code_token"), context("level_before", 3).alias("level_context"), pack_signed(F.col("level") - F.col("level_before")).alias("level_token"))


SIGMA_UNIT, SIGMA_LEAST = -1.1715728752538099024, -1e-4  # fixed values


def inverse_sigma(blocks: DataFrame, key: str, order: str, scale: float, strength: float = 0.46) -> DataFrame:
    """``blocks`` with the inverse filter width of each, from its sharpness (0-7) and the level of its transform's first block."""
    level = F.first("level").over(Window.partitionBy(key).orderBy(order))
    sigma = F.lit(strength / (scale * SIGMA_UNIT)) / level * (F.col("sharpness") / 7)
    return blocks.withColumn("inverse_sigma", 1.0 / F.least(F.lit(SIGMA_LEAST), sigma))


#: First weight and steps of the distance bands of the 8x8 matrices, by channel (fixed values).
BANDS = ((3150.0, 0.0, -0.4, -0.4, -0.4, -2.0), (560.0, 0.0, -0.3, -0.3, -0.3, -0.3), (512.0, -2.0, -1.0, 0.0, -1.0, -2.0))


def dequant_matrix(bands: tuple[float, ...], n: int = 8, wide: int | None = None) -> list[tuple[int, int, float]]:
    """(v, u, weight) of ``n`` rows and ``wide`` columns (``n`` if not told): the inverse of a weight that falls with the frequency's distance from 0, between bands geometrically."""
    m = wide or n
    level = list(accumulate(bands, lambda b, step: b * (1 + step) if step > 0 else b / (1 - step)))
    out = []
    for v in range(n):
        for u in range(m):
            at = math.hypot(v / (n - 1), u / (m - 1)) * (len(level) - 1) / (math.sqrt(2) + 1e-6)
            i = int(at)
            out.append((v, u, 1 / (level[i] * (level[i + 1] / level[i]) ** (at - i))))
    return out


def quantize_by_matrix(rows: DataFrame, matrix: list[tuple[int, int, float]], step: float, dead_zone: float = 0.58) -> DataFrame:
    """Levels of coefficients (.., v, u, value) under ``step`` times the matrix (broadcast: n * n rows)."""
    m = F.broadcast(rows.sparkSession.createDataFrame(matrix, "v int, u int, weight double"))
    scaled = F.col("value") / (F.col("weight") * step)
    return rows.join(m, ["v", "u"]).withColumn("level", F.when(F.abs(scaled) < dead_zone, 0).otherwise(F.rint(scaled)).cast("long"))


def dequantize(levels: DataFrame, step: float, unit: float, rest: float) -> DataFrame:
    """The coefficients that levels stand for, drawn towards 0 as small ones mostly lie below their level."""
    return levels.withColumn("value", adjust_quantization_bias(F.col("level"), unit, rest) * F.col("weight") * step)


def expand(plane: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Each sample as a 2x2 cell; what lies beyond ``size`` is left out."""
    def both(at: str) -> Column:
        return F.explode(F.array(2 * F.col(at), 2 * F.col(at) + 1)).alias(at)

    out = plane.select(both("y"), "x", "value").select("y", both("x"), "value")
    return out.where((F.col("y") < size[0]) & (F.col("x") < size[1]))
