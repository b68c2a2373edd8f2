"""Tilings of a plane by transforms of mixed shapes: their costs, their choice, and the transforms over them.

A tile has TILE rows and columns and is never crossed by a shape, so a tile is
the unit that tasks work on: Spark brings its samples and its blocks together in
one shuffle, and a task works on it by matrix products.  Tiles are bounded; no
key can gather more than TILE * TILE samples.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.operators import fields

#: Rows and columns of a block, and of a tile in samples.
BLOCK, TILE = 8, 64


@dataclass(frozen=True)
class Shape:
    """A transform of ``rows`` by ``cols`` blocks; anchors of candidates lie on multiples of ``step``."""

    name: str
    rows: int
    cols: int
    multiplier: float
    step: int
    matrix: str

    @property
    def blocks(self) -> int:
        return self.rows * self.cols


# The shapes with their cost multipliers and anchor steps.
SHAPES = (
    Shape("8x8", 1, 1, 1.0, 1, "8x8"),
    Shape("16x8", 2, 1, 1.21, 1, "8x16"),
    Shape("8x16", 1, 2, 1.21, 1, "8x16"),
    Shape("16x16", 2, 2, 1.34, 1, "16x16"),
    Shape("32x16", 4, 2, 1.49, 2, "16x32"),
    Shape("16x32", 2, 4, 1.49, 2, "16x32"),
    Shape("32x32", 4, 4, 1.48, 2, "32x32"),
)
BY_NAME = {s.name: s for s in SHAPES}

# First weight and steps of the matrices' distance bands, by matrix and channel.
BANDS = {
    "8x8": fields.BANDS,
    "8x16": (
        (7240.7734393502, -0.7, -0.7, -0.2, -0.2, -0.2, -0.5),
        (1448.15468787004, -0.5, -0.5, -0.5, -0.2, -0.2, -0.2),
        (506.854140754517, -1.4, -0.2, -0.5, -0.5, -1.5, -3.6),
    ),
    "16x16": (
        (8996.8725711814115328, -1.3000777393353804, -0.49424529824571225, -0.439093774457103443, -0.6350101832695744, -0.90177264050827612, -1.6162099239887414),
        (3191.48366296844234752, -0.67424582104194355, -0.80745813428471001, -0.44925837484843441, -0.35865440981033403, -0.31322389111877305, -0.37615025315725483),
        (1157.50408145487200256, -2.0531423165804414, -1.4, -0.50687130033378396, -0.42708730624733904, -1.4856834539296244, -4.9209142884401604),
    ),
    "16x32": (
        (13844.97076442300573, -0.97113799999999995, -0.658, -0.42026, -0.22712, -0.2206, -0.226, -0.6),
        (4798.964084220744293, -0.61125308982767057, -0.83770786552491361, -0.79014862079498627, -0.2692727459704829, -0.38272769465388551, -0.22924222653091453, -0.20719098826199578),
        (1807.236946760964614, -1.2, -1.2, -0.7, -0.7, -0.7, -0.4, -0.5),
    ),
    "32x32": (
        (15718.40830982518931456, -1.025, -0.98, -0.9012, -0.4, -0.48819395464, -0.421064, -0.27),
        (7305.7636810695983104, -0.8041958212306401, -0.7633036457487539, -0.55660379990111464, -0.49785304658857626, -0.43699592683512467, -0.40180866526242109, -0.27321683125358037),
        (3803.53173721215041536, -3.060733579805728, -2.0413270132490346, -2.0235650159727417, -0.5495389509954993, -0.4, -0.4, -0.3),
    ),
}

# Fixed values of the cost: bias and powers of the target, what errors weigh by channel, and offsets of the mask.
COST_BIAS = 0.13731742964354549
LOSS, ZEROS, MAGNITUDE = (1.2, 0.33677806662454718), (9.3089059022677905, 0.50990926717963703), (10.833273317067883, 0.36702940662370243)
MASK_OFFSET, ERROR_WEIGHT = (12.0, 0.0, 4.0), (2.0441408586549744e7, 1.0, 1.266770081387616)


@lru_cache
def basis(n: int) -> np.ndarray:
    """Orthonormal DCT-II, (frequency, place)."""
    k = np.arange(n)[:, None]
    return np.sqrt(np.where(k == 0, 1, 2) / n) * np.cos(np.pi * k * (2 * np.arange(n) + 1) / (2 * n))


@lru_cache
def weights(shape: Shape, channel: int) -> np.ndarray:
    """What a level of one stands for at each frequency of a shape."""
    rows = fields.dequant_matrix(BANDS[shape.matrix][channel], BLOCK * shape.rows, BLOCK * shape.cols)
    return np.array([w for _, _, w in rows]).reshape(BLOCK * shape.rows, BLOCK * shape.cols)


def _log2_up(n: np.ndarray) -> np.ndarray:
    """The least k with 2**k >= n, for whole n from 1 on."""
    return np.frexp((n - 1).astype(np.float64))[1]


def costs_of_shape(shape: Shape, planes: np.ndarray, mask: np.ndarray, quant: np.ndarray, factors: tuple[float, float], target: float) -> tuple[np.ndarray, np.ndarray]:
    """(anchors (n, 2), costs (n,)) of one shape in a tile: planes (3, h, w), mask (h, w), quant by block.

    What the middle channel predicts of the others is taken off; the rest is
    rounded to levels.  A cost is what the levels take to tell plus what
    rounding loses, as an eighth-power norm under the mask.
    """
    h, w = BLOCK * shape.rows, BLOCK * shape.cols
    rows, cols = quant.shape
    if rows < shape.rows or cols < shape.cols:
        return np.zeros((0, 2), np.int64), np.zeros(0)
    by, bx = np.meshgrid(np.arange(0, rows - shape.rows + 1, shape.step), np.arange(0, cols - shape.cols + 1, shape.step), indexing="ij")
    at = np.stack([by.ravel(), bx.ravel()], 1)
    cells = lambda a: sliding_window_view(a, (h, w))[at[:, 0] * BLOCK, at[:, 1] * BLOCK]
    levels = sliding_window_view(quant, (shape.rows, shape.cols))[at[:, 0], at[:, 1]].reshape(len(at), -1)
    norm = levels.max(1) if shape.blocks <= 2 else (levels**16).mean(1) ** (1 / 16)
    unit = math.sqrt(h * w)  # coefficients are those of means, not of sums
    coefficients = [basis(h) @ cells(p) @ basis(w).T / unit for p in planes]
    ratio = (target + COST_BIAS) / (1 + COST_BIAS)
    loss_unit, zeros_unit, magnitude_unit = (a * ratio**b for a, b in (LOSS, ZEROS, MAGNITUDE))
    told, lost = np.zeros(len(at)), np.zeros(len(at))
    for c, factor in enumerate((factors[0], 0.0, factors[1])):
        weight = weights(shape, c)
        scaled = (coefficients[c] - factor * coefficients[1]) / weight * norm[:, None, None]
        level = np.trunc(scaled + np.copysign(0.5, scaled))
        error = unit * basis(h).T @ (weight * (scaled - level)) @ basis(w)
        lost += (((cells(mask) + MASK_OFFSET[c]) * error) ** 8).sum((1, 2)) * ERROR_WEIGHT[c]
        bits = _log2_up((level != 0).sum((1, 2)) + 1) + 1
        told += magnitude_unit * np.sqrt(np.abs(level)).sum((1, 2)) + zeros_unit * (_log2_up(bits + 17) + bits)
        if c == 0 and shape.blocks > 1:
            told, lost = told * (1 + min(3, shape.blocks / 8)), lost * (1 + min(3, shape.blocks / 8))
    return at, told * shape.multiplier + loss_unit * (lost / (h * w)) ** 0.125 * (h * w) / norm


def _tiles(rows: DataFrame, y: str, x: str, n: int) -> DataFrame:
    return rows.withColumn("ty", F.expr(f"{y} div {n}")).withColumn("tx", F.expr(f"{x} div {n}"))


def shape_costs(pixels: DataFrame, field: DataFrame, target: float) -> DataFrame:
    """(by, bx, shape, cost) of every candidate: each shape at each anchor from which it fits into its tile.

    ``pixels`` has y, x, c0, c1, c2 and mask (positive), its size a multiple of
    8 both ways.  ``field`` has by, bx, quant (positive), x_factor and b_factor
    (what c1 predicts of the others, one pair a tile).
    """

    def run(key: tuple, p: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        ty, tx = key
        rows, cols = (f["by"] % 8).max() + 1, (f["bx"] % 8).max() + 1
        p = p.sort_values(["y", "x"])
        planes = p[["c0", "c1", "c2", "mask"]].to_numpy().T.reshape(4, rows * BLOCK, cols * BLOCK)
        f = f.sort_values(["by", "bx"])
        quant = f["quant"].to_numpy().reshape(rows, cols)
        factors = f["x_factor"].iloc[0], f["b_factor"].iloc[0]
        out = []
        for s in SHAPES:
            at, cost = costs_of_shape(s, planes[:3], planes[3], quant, factors, target)
            out.append(pd.DataFrame({"by": at[:, 0] + 8 * ty, "bx": at[:, 1] + 8 * tx, "shape": s.name, "cost": cost}))
        return pd.concat(out)

    tiles = _tiles(pixels, "y", "x", TILE).groupBy("ty", "tx").cogroup(_tiles(field, "by", "bx", TILE // BLOCK).groupBy("ty", "tx"))
    return tiles.applyInPandas(run, "by long, bx long, shape string, cost double")


@lru_cache
def attempts(rows: int, cols: int) -> tuple[tuple[str, int, int], ...]:
    """What is tried in a tile of this size, in order: (shape, row, column), or a square of blocks to divide anew, named by its side.

    First merges: squares on even places where a whole one fits, single
    rectangles along the edges where none does, small ones before large ones.
    Then squares on the other places, which may cut what was placed before.
    """
    plan: list[tuple[str, int, int]] = []

    def places(step_y: int, step_x: int, h: int, w: int):
        return ((y, x) for y in range(0, rows - h + 1, step_y) for x in range(0, cols - w + 1, step_x))

    def square_fits(y: int, x: int, side: int) -> bool:
        return y + side <= rows and x + side <= cols

    for side, tall, flat in ((2, "16x8", "8x16"), (4, "32x16", "16x32")):
        # of the small pair the tall one goes first, of the large pair the flat one; squares go with the flat one
        for name in (tall, flat) if side == 2 else (flat, tall):
            s = BY_NAME[name]
            for y, x in places(s.rows, s.cols, s.rows, s.cols):
                if square_fits(y, x, side):
                    if name == flat and y % side == 0 and x % side == 0:
                        plan.append((str(side), y, x))
                elif (y if name == flat else x) % side == 0:
                    plan.append((name, y, x))
    plan += [("2", y, x) for y, x in places(1, 1, 2, 2) if y % 2 or x % 2]
    plan += [("4", y, x) for y, x in places(2, 2, 4, 4) if y % 4 or x % 4]
    return tuple(plan)


class Placement:
    """The shapes placed in a tile so far, and what each costs (held by its anchor)."""

    def __init__(self, rows: int, cols: int, costs: dict[tuple[str, int, int], float], small: float):
        """``costs`` by (shape, row, column); ``small`` is the multiplier of single blocks."""
        self.size, self.candidates = (rows, cols), costs
        y, x = np.indices(self.size)
        self.top, self.left, self.name = y.copy(), x.copy(), np.full(self.size, "8x8", object)
        self.cost = np.array([[costs["8x8", r, c] * small for c in range(cols)] for r in range(rows)])
        self.rank = np.zeros(self.size, int)

    def put(self, name: str, y: int, x: int) -> None:
        s = BY_NAME[name]
        cell = np.s_[y : y + s.rows, x : x + s.cols]
        self.top[cell], self.left[cell], self.name[cell], self.cost[cell] = y, x, name, 0.0
        self.cost[y, x] = self.candidates[name, y, x]

    def merge(self, name: str, y: int, x: int) -> None:
        """Places a rectangle if it is cheaper than what it covers, and nothing of its rank lies there."""
        s = BY_NAME[name]
        cell, rank = np.s_[y : y + s.rows, x : x + s.cols], 2 if s.blocks == 2 else 4
        if self.rank[cell].max() < rank and self.candidates[name, y, x] < sum(self.cost[cell].ravel().tolist()):
            self.put(name, y, x)
            self.rank[cell] = rank

    def _row_cut(self, y: int, x: int, side: int) -> bool:
        """Whether a shape lies across the line above row ``y``."""
        return y < self.size[0] and bool((self.top[y, x : x + side] < y).any())

    def _column_cut(self, y: int, x: int, side: int) -> bool:
        return x < self.size[1] and bool((self.left[y : y + side, x] < x).any())

    def divide(self, side: int, y: int, x: int) -> None:
        """Covers a square as one, as two tall or two flat halves, or leaves halves as they are, whichever is cheapest.

        Nothing happens where a shape lies across the square's edges.  The square
        has to be cheaper than both divisions, tall halves than flat ones.
        """
        if self._row_cut(y, x, side) or self._row_cut(y + side, x, side) or self._column_cut(y, x, side) or self._column_cut(y, x + side, side):
            return
        half = side // 2
        tall, flat, square = ("16x8", "8x16", "16x16") if side == 2 else ("32x16", "16x32", "32x32")
        held = self.cost[y : y + side, x : x + side].reshape(2, half, 2, half).sum((1, 3))

        def half_costs(name: str, free: bool, places: tuple, now: tuple) -> list[tuple]:
            """(what it would cost, what it costs now, place) of both halves."""
            return [(self.candidates[name, *p] if free and self.name[p] != name else math.inf, c, p) for p, c in zip(places, now, strict=True)]

        upright = half_costs(tall, not self._column_cut(y, x + half, side), ((y, x), (y, x + half)), held.sum(0))
        lying = half_costs(flat, not self._row_cut(y + half, x, side), ((y, x), (y + half, x)), held.sum(1))
        by_tall, by_flat = (sum(min(new, now) for new, now, _ in halves) for halves in (upright, lying))
        whole = self.candidates[square, y, x]
        if whole < by_tall and whole < by_flat:
            self.put(square, y, x)
            return
        name, halves = (tall, upright) if by_tall < by_flat else (flat, lying)
        for new, now, place in halves:
            if new < now:
                self.put(name, *place)

    def run(self) -> None:
        for what, y, x in attempts(*self.size):
            if what in BY_NAME:
                self.merge(what, y, x)
            else:
                self.divide(int(what), y, x)


def place_shapes(costs: DataFrame, target: float) -> DataFrame:
    """(by, bx, shape, ay, ax): for each block the shape that covers it and the block of its anchor.

    ``costs`` are those of :func:`shape_costs`.  A tile's shapes are tried one
    after another (:func:`attempts`), each over what is there; a tile is 64
    blocks and some 350 costs, and tiles know nothing of each other.
    """
    small = 1 - 0.4 / (target + 1.4)

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        ty, tx = key
        known = {(s, y, x): c for s, y, x, c in zip(f["shape"], (f["by"] % 8).tolist(), (f["bx"] % 8).tolist(), f["cost"].tolist(), strict=True)}
        rows, cols = (max(k[i] for k in known if k[0] == "8x8") + 1 for i in (1, 2))
        tile = Placement(rows, cols, known, small)
        tile.run()
        y, x = np.indices(tile.size)
        return pd.DataFrame({"by": y.ravel() + 8 * ty, "bx": x.ravel() + 8 * tx, "shape": tile.name.ravel(), "ay": tile.top.ravel() + 8 * ty, "ax": tile.left.ravel() + 8 * tx})

    return _tiles(costs, "by", "bx", TILE // BLOCK).groupBy("ty", "tx").applyInPandas(run, "by long, bx long, shape string, ay long, ax long")


def _over_tiling(forward: bool):
    """A tile's values through the transform of each of its shapes, many of one shape at a time."""

    def run(key: tuple, p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        height, width = (int(t[c].max() % 8 + 1) * BLOCK for c in ("by", "bx"))
        plane = np.zeros((height, width))
        plane[p["y"].to_numpy() % TILE, p["x"].to_numpy() % TILE] = p["value"].to_numpy()
        anchors = t[(t["by"] == t["ay"]) & (t["bx"] == t["ax"])]
        out = np.zeros_like(plane)
        y, x = np.indices(plane.shape)
        shape, ay, ax = np.full(plane.shape, "", object), np.zeros(plane.shape, np.int64), np.zeros(plane.shape, np.int64)
        for name, of in anchors.groupby("shape"):
            s = BY_NAME[name]
            h, w = BLOCK * s.rows, BLOCK * s.cols
            at = (of["ay"].to_numpy() % 8 * BLOCK)[:, None, None] + np.arange(h)[None, :, None], (of["ax"].to_numpy() % 8 * BLOCK)[:, None, None] + np.arange(w)[None, None, :]
            out[at] = basis(h) @ plane[at] @ basis(w).T if forward else basis(h).T @ plane[at] @ basis(w)
            shape[at], ay[at], ax[at] = name, of["ay"].to_numpy()[:, None, None], of["ax"].to_numpy()[:, None, None]
        y0, x0 = key[0] * TILE, key[1] * TILE
        if not forward:
            return pd.DataFrame({"y": y.ravel() + y0, "x": x.ravel() + x0, "value": out.ravel()})
        v, u = y + y0 - ay * BLOCK, x + x0 - ax * BLOCK
        return pd.DataFrame({"ay": ay.ravel(), "ax": ax.ravel(), "shape": shape.ravel(), "v": v.ravel(), "u": u.ravel(), "value": out.ravel()})

    return run


def tiled_dct(plane: DataFrame, tiling: DataFrame) -> DataFrame:
    """Coefficients (ay, ax, shape, v, u, value) of a plane under a tiling: an orthonormal DCT for each shape.

    ``plane`` has y, x, value and whole blocks; ``tiling`` is that of
    :func:`place_shapes`, or any in which no shape leaves its tile.  Samples and
    blocks meet by tile, in one shuffle of each.
    """
    tiles = _tiles(plane, "y", "x", TILE).groupBy("ty", "tx").cogroup(_tiles(tiling, "by", "bx", TILE // BLOCK).groupBy("ty", "tx"))
    return tiles.applyInPandas(_over_tiling(True), "ay long, ax long, shape string, v long, u long, value double")


def tiled_idct(coefficients: DataFrame, tiling: DataFrame) -> DataFrame:
    """The plane (y, x, value) of coefficients under a tiling: :func:`tiled_dct` undone, each value scattered back to its place."""
    at = coefficients.select((F.col("ay") * BLOCK + F.col("v")).alias("y"), (F.col("ax") * BLOCK + F.col("u")).alias("x"), "value")
    tiles = _tiles(at, "y", "x", TILE).groupBy("ty", "tx").cogroup(_tiles(tiling, "by", "bx", TILE // BLOCK).groupBy("ty", "tx"))
    return tiles.applyInPandas(_over_tiling(False), "y long, x long, value double")


def quantize_tiled(coefficients: DataFrame, field: DataFrame, channel: int, step: float = 1.0) -> DataFrame:
    """Levels and restored values of coefficients under each shape's own matrix and its anchor's quant.

    The matrices are one fixed table of the shapes' samples (3,392 rows), joined
    by shape and place.  Adds quant, level and restored.
    """
    rows = [(s.name, v, u, float(w)) for s in SHAPES for (v, u), w in np.ndenumerate(weights(s, channel))]
    matrix = F.broadcast(coefficients.sparkSession.createDataFrame(rows, "shape string, v long, u long, weight double"))
    level = field.select(F.col("by").alias("ay"), F.col("bx").alias("ax"), "quant")
    unit = F.col("weight") * step / F.col("quant")
    found = coefficients.join(matrix, ["shape", "v", "u"]).join(level, ["ay", "ax"]).withColumn("level", F.rint(F.col("value") / unit).cast("long"))
    return found.withColumn("restored", F.col("level") * unit).drop("weight")
