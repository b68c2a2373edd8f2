"""Neighbourhood filters of planes (y, x, value).

A pixel is sent to the targets it weighs in, so the sum over taps is a grouped
sum with partial aggregation in every task: no plane or row gathers in one
place, and neighbours need no self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _places(at: Column, n: int, reach: int, edge: str) -> Column:
    """The coordinates at which a sample is seen: its own, and those beyond an edge that show it."""
    if edge == "drop":
        return F.array(at)
    if edge == "mirror":
        beyond = [F.when(at < reach, -1 - at), F.when(at >= n - reach, 2 * n - 1 - at)]
        return F.array_compact(F.array(at, *beyond))
    lo = F.when(at == 0, F.sequence(F.lit(-reach).cast("long"), F.lit(-1).cast("long")))
    hi = F.when(at == n - 1, F.sequence(F.lit(n).cast("long"), F.lit(n + reach - 1).cast("long")))
    none = F.array().cast("array<bigint>")
    return F.concat(F.array(at), F.coalesce(lo, none), F.coalesce(hi, none))  # clamp


def neighbours(plane: DataFrame, taps: list[tuple], size: tuple[int, int], edge: str) -> DataFrame:
    """(y, x, value, *rest of the tap) of every sample at every target it reaches.

    A tap (dy, dx, ...) takes the sample at (y + dy, x + dx).  Edges: mirror
    (edge sample repeated), clamp, or drop (nothing beyond).  The plane must be
    larger than the reach.
    """
    h, w = size
    reach = max(max(abs(t[0]), abs(t[1])) for t in taps)
    seen = plane.select("value", F.explode(_places(F.col("y"), h, reach, edge)).alias("sy"), "x")
    seen = seen.select("value", "sy", F.explode(_places(F.col("x"), w, reach, edge)).alias("sx"))
    names = [f"t{i}" for i in range(len(taps[0]) - 2)]
    sent = seen.withColumn("t", F.explode(F.array(*[F.struct(F.lit(t[0]).alias("dy"), F.lit(t[1]).alias("dx"), *[F.lit(v).alias(n) for v, n in zip(t[2:], names, strict=True)]) for t in taps])))
    out = sent.select((F.col("sy") - F.col("t.dy")).alias("y"), (F.col("sx") - F.col("t.dx")).alias("x"), "value", *[F.col(f"t.{n}").alias(n) for n in names])
    return out.where(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1))


def symmetric5(weights: dict[int, float]) -> list[tuple]:
    """25 taps by squared distance (0, 1, 2, 4, 5, 8)."""
    return [(dy, dx, float(weights[dy * dy + dx * dx])) for dy in range(-2, 3) for dx in range(-2, 3)]


def convolve(plane: DataFrame, taps: list[tuple], size: tuple[int, int], edge: str = "mirror", renormalize: bool = False) -> DataFrame:
    """Weighted sum over the taps; optionally over the weights that lie inside."""
    n = neighbours(plane, taps, size, edge).withColumn("part", F.col("value") * F.col("t0"))
    total = F.sum("part")
    return n.groupBy("y", "x").agg((total / F.sum("t0") if renormalize else total).alias("value"))


def separable(plane: DataFrame, kernel: list[float], size: tuple[int, int]) -> DataFrame:
    """Horizontal then vertical pass of an odd kernel; edges are cut off and weights renormalised."""
    r = len(kernel) // 2
    across = convolve(plane, [(0, d, float(k)) for d, k in zip(range(-r, r + 1), kernel, strict=True)], size, "drop", True)
    return convolve(across, [(d, 0, float(k)) for d, k in zip(range(-r, r + 1), kernel, strict=True)], size, "drop", True)


def gaussian_kernel(sigma: float) -> list[float]:
    """Radius max(1, floor(2.25 sigma)); weights exp(-d^2 / 2 sigma^2)."""
    import math

    r = max(1, int(2.25 * abs(sigma)))
    return [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-r, r + 1)]


def gaborish(plane: DataFrame, side: float, corner: float, size: tuple[int, int]) -> DataFrame:
    """3x3 smoothing whose weights (1, side, corner) are scaled to sum to one."""
    total = 1 + 4 * (side + corner)
    taps = [(dy, dx, (1.0, side, corner)[abs(dy) + abs(dx)] / total) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return convolve(plane, taps, size)


#: Weights of the inverse smoothing by squared distance, for a multiplier of one (fixed values).
SHARPENING = {1: -0.09495815671340026, 2: 0.013710004822696948, 4: -0.041031725066768575, 5: 0.006510206083837737, 8: -0.0014789063378272242}


def sharpening_taps(multiplier: float) -> list[tuple]:
    taps = {(dy, dx): SHARPENING[dy * dy + dx * dx] * multiplier if dy or dx else 1.0 for dy in range(-2, 3) for dx in range(-2, 3)}
    total = max(sum(taps.values()), 1e-5)
    return [(dy, dx, w / total) for (dy, dx), w in taps.items()]


def gaborish_inverse(plane: DataFrame, multiplier: float, size: tuple[int, int]) -> DataFrame:
    """5x5 sharpening that nearly undoes :func:`gaborish`; weights are scaled to sum to one."""
    return convolve(plane, sharpening_taps(multiplier), size)


def smallest_sum(plane: DataFrame, weights: list[float], size: tuple[int, int]) -> DataFrame:
    """Weighted sum of the smallest of 3x3 (edges clamped); at most nine values are gathered for a pixel."""
    taps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    least = F.slice(F.array_sort(F.collect_list("value")), 1, len(weights))
    value = sum((F.get("least", F.lit(i)) * w for i, w in enumerate(weights)), F.lit(0.0))
    return neighbours(plane, taps, size, "clamp").groupBy("y", "x").agg(least.alias("least")).select("y", "x", value.alias("value"))


def erosion_weights(target: float) -> list[float]:
    """Weights of the four smallest for a distance target, scaled to their fixed total."""
    base, add, total = (0.125, 0.1, 0.09, 0.06), (0.0, -0.1, -0.09, -0.06), 0.29959705784054957  # fixed values
    mix = max(0.0, (2 - target) / 2)
    w = [b + mix * a for b, a in zip(base, add, strict=True)]
    return [x * total / sum(w) for x in w]


def fuzzy_erosion_half(plane: DataFrame, target: float, size: tuple[int, int]) -> DataFrame:
    """Four-smallest sums added over 2x2 cells."""
    e = smallest_sum(plane, erosion_weights(target), size)
    return e.groupBy(F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(F.sum("value").alias("value"))


def fuzzy_erosion_wide(plane: DataFrame, size: tuple[int, int], step: int = 3) -> DataFrame:
    """0.45, 0.30 and 0.25 of the three smallest of a sample, its doubles and its neighbours at ``step``."""
    taps = [(dy, dx, dy == 0 and dx == 0) for dy in (-step, 0, step) for dx in (-step, 0, step)]
    n = neighbours(plane, taps, size, "drop")
    seen = n.withColumn("v", F.explode(F.when(F.col("t0"), F.array(F.col("value"), 2 * F.col("value"), 2 * F.col("value"))).otherwise(F.array("value"))))
    least = F.array_sort(F.collect_list("v"))
    g = seen.groupBy("y", "x").agg(least.alias("s"))
    return g.select("y", "x", (0.45 * F.get("s", F.lit(0)) + 0.3 * F.get("s", F.lit(1)) + 0.25 * F.get("s", F.lit(2))).alias("value"))


# Fixed weights of the DC smoothing.
SIDE, CORNER = 0.20345139757231578, 0.0334829185968739


def smooth_dc(planes: DataFrame, steps: dict[str, float], size: tuple[int, int]) -> DataFrame:
    """3x3 smoothing of several channels, weaker where any channel's step-normalised gap is large.

    ``planes`` has y, x and a column for each key of ``steps``; border samples stay.
    """
    names = list(steps)
    centre = 1 - 4 * (SIDE + CORNER)
    taps = [(dy, dx, (centre, SIDE, CORNER)[abs(dy) + abs(dx)], dy == 0 and dx == 0) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    n = neighbours(planes.select("y", "x", F.struct(*names).alias("value")), taps, size, "drop")
    g = n.groupBy("y", "x").agg(F.count("*").alias("n"), *[F.sum(F.col(f"value.{c}") * F.col("t0")).alias(f"{c}_s") for c in names], *[F.max(F.when(F.col("t1"), F.col(f"value.{c}"))).alias(f"{c}_c") for c in names])
    gap = F.greatest(F.lit(0.5), *[F.abs((F.col(f"{c}_c") - F.col(f"{c}_s")) / s) for c, s in steps.items()])
    factor = F.greatest(F.lit(0.0), 3 - 4 * gap)
    return g.select("y", "x", *[F.when(F.col("n") == 9, (F.col(f"{c}_s") - F.col(f"{c}_c")) * factor + F.col(f"{c}_c")).otherwise(F.col(f"{c}_c")).alias(c) for c in names])


#: Sixteen lines through a sample: the two steps (dx, dy) of one half; the other half mirrors it (fixed values).
LINES = (
    ((4, 0), (2, 0)), ((0, 4), (0, 2)), ((3, 3), (2, 2)), ((-3, 3), (-2, 2)), ((-1, 4), (-1, 2)), ((1, 4), (1, 2)), ((4, 1), (2, 1)), ((4, -1), (2, -1)),
    ((2, 3), (1, 2)), ((-2, 3), (-1, 2)), ((3, 2), (2, 1)), ((-3, 2), (-2, 1)), ((4, -2), (2, -1)), ((4, 2), (2, 1)), ((2, 4), (1, 2)), ((-2, 4), (-1, 2)),
)


def line_taps() -> list[tuple]:
    return [(s * dy, s * dx, k) for k, half in enumerate(LINES) for dx, dy in half for s in (1, -1)] + [(0, 0, k) for k in range(len(LINES))]


def line_energy(plane: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Sum over sixteen lines of the squared sum along the line; nothing beyond the edges."""
    sums = neighbours(plane, line_taps(), size, "drop").groupBy("y", "x", "t0").agg(F.sum("value").alias("s"))
    return sums.groupBy("y", "x").agg(F.sum(F.col("s") * F.col("s")).alias("value"))


#: Samples within two steps of a sample, and its direct neighbours.
DIAMOND = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if abs(dy) + abs(dx) <= 2]
PLUS = [(0, 0), (-1, 0), (0, -1), (1, 0), (0, 1)]
CHANNEL_SCALE, EDGE_SCALE, SIGMA_SCALE, LEAST_SIGMA = (40.0, 5.0, 3.5), 2 / 3, 1.65, -1.1715728752538099 / 0.3  # fixed values


def edge_preserving(planes: DataFrame, sigma: Column, size: tuple[int, int]) -> DataFrame:
    """Mean of a sample and its four neighbours, weighted by how alike their surroundings are.

    ``planes`` has y, x, c0, c1, c2; ``sigma`` is the (negative) inverse sigma
    of a sample's 8x8 block, an expression of by and bx.  Samples of blocks
    below the least value stay.  Edges are mirrored.
    """
    n = neighbours(planes.select("y", "x", F.struct("c0", "c1", "c2").alias("value")), [(dy, dx, i) for i, (dy, dx) in enumerate(DIAMOND)], size, "mirror")
    g = n.groupBy("y", "x").agg(*[F.max(F.when(F.col("t0") == i, F.col("value"))).alias(f"p{i}") for i in range(len(DIAMOND))])
    at = {d: f"p{i}" for i, d in enumerate(DIAMOND)}
    border = (F.col("y") % 8).isin(0, 7) | (F.col("x") % 8).isin(0, 7)
    g = g.withColumn("by", F.expr("y div 8")).withColumn("bx", F.expr("x div 8")).withColumn("raw", sigma)
    scaled = F.col("raw") * SIGMA_SCALE * F.when(border, EDGE_SCALE).otherwise(1.0)
    weights = []
    for d in PLUS[1:]:
        sad = sum((F.abs(F.col(f"{at[o]}.c{c}") - F.col(f"{at[(d[0] + o[0], d[1] + o[1])]}.c{c}")) * CHANNEL_SCALE[c] for c in range(3) for o in PLUS), F.lit(0.0))
        weights.append(F.greatest(F.lit(0.0), sad * scaled + 1.0))
    g = g.select("y", "x", "raw", *[F.col(at[d]).alias(f"n{i}") for i, d in enumerate(PLUS)], *[w.alias(f"w{i}") for i, w in enumerate(weights, 1)])
    total = 1.0 + sum((F.col(f"w{i}") for i in range(1, 5)), F.lit(0.0))
    return g.select("y", "x", *[F.when(F.col("raw") < LEAST_SIGMA, F.col(f"n0.c{c}")).otherwise((F.col(f"n0.c{c}") + sum((F.col(f"w{i}") * F.col(f"n{i}.c{c}") for i in range(1, 5)), F.lit(0.0))) / total).alias(f"c{c}") for c in range(3)])


def subsample(plane: DataFrame, by: int = 2) -> DataFrame:
    """Means of ``by`` x ``by`` cells (those that exist at the edge)."""
    return plane.groupBy(F.expr(f"y div {by}").alias("y"), F.expr(f"x div {by}").alias("x")).agg(F.avg("value").alias("value"))


def edge_maxima(plane: DataFrame, size: tuple[int, int]) -> DataFrame:
    """One row: the greatest absolute horizontal and vertical difference of neighbours."""
    n = neighbours(plane, [(0, 0, "c"), (0, -1, "l"), (-1, 0, "t")], size, "drop")
    g = n.groupBy("y", "x").agg(*[F.max(F.when(F.col("t0") == k, F.col("value"))).alias(k) for k in "clt"])
    return g.agg(F.max(F.abs(F.col("c") - F.col("l"))).alias("horizontal"), F.max(F.abs(F.col("c") - F.col("t"))).alias("vertical"))


#: Rows of a plane that are looked at together for the neighbours above.
STRIP = 256


def causal(plane: DataFrame, partition: str | None = None) -> DataFrame:
    """y, x, value and the seven causal neighbours with their edge rules.

    left falls back to top, then 0; top to left; top_left and left_left to
    left; top_right and top_top to top; top_right_right to top_right.  The plane
    is cut into strips of rows, each with the two rows above it, so a column is
    looked at by strips and a plane of any height spreads over tasks.
    """
    key = [partition] if partition else []
    own = F.expr(f"y div {STRIP}")
    seen = F.when(F.col("y") % STRIP >= STRIP - 2, F.array(own, own + 1)).otherwise(F.array(own))
    p = plane.select("*", F.explode(seen).alias("__strip"))
    column, row = Window.partitionBy(*key, "__strip", "x").orderBy("y"), Window.partitionBy(*key, "y").orderBy("x")
    p = p.withColumn("up", F.lag("value").over(column)).withColumn("up2", F.lag("value", 2).over(column)).where(F.col("__strip") == own)
    p = p.select("*", F.lag("value").over(row).alias("l"), F.lag("value", 2).over(row).alias("l2"), F.lag("up").over(row).alias("ul"), F.lead("up").over(row).alias("ur"), F.lead("up", 2).over(row).alias("ur2"))
    left = F.coalesce("l", "up", F.lit(0))
    top = F.coalesce("up", left)
    right = F.coalesce("ur", top)
    return p.select(*key, "y", "x", "value", left.alias("left"), top.alias("top"), F.coalesce("ul", left).alias("top_left"), right.alias("top_right"), F.coalesce("l2", left).alias("left_left"), F.coalesce("up2", top).alias("top_top"), F.coalesce("ur2", right).alias("top_right_right"))
