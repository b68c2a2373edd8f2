"""Block fields, trees and contexts against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tesselark.operators import fields


def plane(spark, rows):
    return spark.createDataFrame([(y, x, *map(float, v)) for (y, x), v in rows.items()], "y long, x long, c0 double, c1 double, c2 double")


def test_modulations_of_full_and_cut_blocks(spark):
    r = random.Random(5)
    px = {(y, x): (r.uniform(-0.02, 0.02), r.uniform(0, 0.3), r.uniform(0, 0.3)) for y in range(11) for x in range(13)}
    got = {(m["by"], m["bx"]): m for m in fields.modulations(plane(spark, px)).collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 0), (1, 1)}
    for (by, bx), m in got.items():
        cell = {k: v for k, v in px.items() if (k[0] // 8, k[1] // 8) == (by, bx)}
        high = sum(min(fields.HIGH_LIMIT, abs(v[1] - cell[n][1])) for (y, x), v in cell.items() for n in ((y, x + 1), (y + 1, x)) if n in cell)
        blue = sum(min(max(v[2] - v[1] - fields.BLUE_OFFSET - abs(v[0]), 0), fields.BLUE_LIMIT) for v in cell.values())
        blue = 64 * fields.BLUE_LIMIT - blue if blue >= 32 * fields.BLUE_LIMIT else blue
        assert m["high"] == pytest.approx(high * fields.HIGH_SLOPE + fields.HIGH_OFFSET)
        assert m["blue"] == pytest.approx(min(blue, fields.BLUE_MOST * fields.BLUE_LIMIT) * fields.BLUE_SLOPE)
        assert math.isfinite(m["gamma"])


@pytest.mark.parametrize(
    ("stats", "target", "want"),
    [((0.0, 0.0, 0.0), 1.0, (3, 2)), ((0.026, 0.29, 0.13), 1.0, (5, 3)), ((0.015, 0.39, 0.0), 6.0, (5, 4)), ((0.0, 0.39, 0.2), 10.0, (6, 5)), ((0.022, 0.28, 0.2), 2.6, (4, 2)), ((0.0, 0.34, 0.2), 2.5, (3, 4))],
)
def test_matrix_scales(spark, stats, target, want):
    row = fields.matrix_scales(spark.createDataFrame([stats], "x_edge double, b_edge double, exposed_blue double"), target).first()
    assert (row["x_scale"], row["b_scale"]) == want


def test_edge_statistics_leave_out_the_first_row_and_column(spark):
    px = {(y, x): (0.0, 0.1, 0.1) for y in range(4) for x in range(4)}
    px[0, 0] = (9.0, 9.0, 9.0)
    assert tuple(fields.edge_statistics(plane(spark, px), (4, 4)).first()) == (0.0, 0.0, 0.0)
    px[2, 2] = (0.5, 0.1, 0.5)
    row = fields.edge_statistics(plane(spark, px), (4, 4)).first()
    assert tuple(row) == pytest.approx((0.5, 0.4, 0.38 * 0.8))


def test_an_empty_plane_has_no_edges(spark):
    assert tuple(fields.edge_statistics(plane(spark, {}).limit(0), (0, 0)).first()) == (0.0, 0.0, 0.0)


def test_tree_leads_to_the_leaf_that_the_questions_name(spark):
    rows = spark.createDataFrame([(a, b) for a in range(-2, 3) for b in range(-2, 3)], "a long, b long").withColumn("p", F.struct("a", "b"))
    tree = ("a", 0, (F.lit(0),), ("b", -1, (F.lit(1),), (F.lit(2),)))
    for r in rows.withColumn("leaf", fields.leaf(tree, F.col("p"))).collect():
        assert r["leaf"] == (0 if r["a"] > 0 else 1 if r["b"] > -1 else 2)


def test_tree_tokens_are_the_residuals_of_their_leaf(spark):
    r = random.Random(3)
    px = {(y, x): r.randrange(100) for y in range(7) for x in range(9)}
    p = spark.createDataFrame([(y, x, v) for (y, x), v in px.items()], "y long, x long, value long")
    tree = ("y", 2, ((7, "zero"),), ((8, "left"),))
    for t in fields.leaf_tokens(p, tree).collect():
        y, x = t["y"], t["x"]
        left = px.get((y, x - 1), px.get((y - 1, x), 0))
        gap = px[y, x] - (0 if y > 2 else left)
        assert (t["context"], t["token"]) == (7 if y > 2 else 8, 2 * gap if gap >= 0 else -2 * gap - 1)


def test_block_context_swaps_the_first_two_channels(spark):
    rows = spark.createDataFrame([(s, c, q) for s in (0, 7, 26) for c in range(3) for q in (1, 10, 11)], "s int, c int, q int")
    for r in rows.withColumn("k", fields.block_context(F.col("s"), F.col("c"), F.col("q"), [10], list(range(78)))).collect():
        assert r["k"] == ((1, 0, 2)[r["c"]] * 13 + fields.ORDER_OF[r["s"]]) * 2 + (r["q"] > 10)


def test_dequantised_values_lie_near_their_coefficients(spark):
    m = fields.dequant_matrix(fields.BANDS[0])
    assert len(m) == 64 and all(w > 0 for _, _, w in m) and m[0][2] == pytest.approx(1 / 3150)
    rows = spark.createDataFrame([(v, u, math.sin(5 * v + u)) for v in range(8) for u in range(8)], "v int, u int, value double")
    back = fields.dequantize(fields.quantize_by_matrix(rows.withColumn("was", F.col("value")), m, 20.0), 20.0, 0.93, 0.145)
    assert back.count() == 64
    assert all(abs(r["was"] - r["value"]) <= 0.75 * r["weight"] * 20 for r in back.collect())


def test_expand_fills_an_odd_plane(spark):
    p = spark.createDataFrame([(y, x, float(2 * y + x)) for y in range(2) for x in range(2)], "y long, x long, value double")
    got = {(r["y"], r["x"]): r["value"] for r in fields.expand(p, (3, 3)).collect()}
    assert got == {(y, x): float(2 * (y // 2) + x // 2) for y in range(3) for x in range(3)}


def test_a_block_field_shuffles_once(spark):
    px = {(y, x): (0.0, 0.1, 0.2) for y in range(9) for x in range(9)}
    plan = fields.modulations(plane(spark, px))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
