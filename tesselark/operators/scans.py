"""Tokens of shapes' levels in scan order, with the contexts that what is known so far gives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselark.functions.pointwise import pack_signed
from tesselark.operators.fields import block_context
from tesselark.operators.orderstats import natural_order
from tesselark.operators.tilings import SHAPES, Shape

#: Rows and columns of a group in blocks; buckets of counts and contexts of levels, for each context of blocks.
GROUP, COUNT_BUCKETS, LEVEL_CONTEXTS = 32, 37, 458
#: Number of each shape among all transforms (fixed values).
STRATEGY = {"8x8": 0, "16x16": 4, "32x32": 5, "16x8": 6, "8x16": 7, "32x16": 10, "16x32": 11}
# Context of a place in the scan (from 1 on, for one block), and of how many non-zeros are left.
PLACE_CONTEXT = (
    0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 15, 16, 16, 17, 17, 18, 18, 19, 19, 20, 20, 21, 21, 22, 22,
    23, 23, 23, 23, 24, 24, 24, 24, 25, 25, 25, 25, 26, 26, 26, 26, 27, 27, 27, 27, 28, 28, 28, 28, 29, 29, 29, 29, 30, 30, 30, 30,
)
LEFT_CONTEXT = (
    0, 0, 31, 62, 62, 93, 93, 93, 93, 123, 123, 123, 123, *[152] * 8, *[180] * 12, *[206] * 31,
)


def turned(s: Shape) -> bool:
    """Whether a shape's scan swaps rows and columns: those that are not wider than high do."""
    return s.rows >= s.cols


def scan_orders(spark: SparkSession) -> DataFrame:
    """(shape, v, u, scan) of all shapes: 3,392 rows."""
    parts = []
    for s in SHAPES:
        order = natural_order(spark, max(s.rows, s.cols), min(s.rows, s.cols))
        v, u = ("x", "y") if turned(s) else ("y", "x")
        parts.append(order.select(F.lit(s.name).alias("shape"), F.col(v).alias("v"), F.col(u).alias("u"), F.col("rank").alias("scan")))
    return reduce(DataFrame.unionByName, parts)


def _of_shape(value) -> Column:
    out = F.lit(None).cast("long")
    for s in SHAPES:
        out = F.when(F.col("shape") == s.name, F.lit(value(s)).cast("long")).otherwise(out)
    return out


def _entry(values: tuple[int, ...], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def scan_tokens(levels: DataFrame, tiling: DataFrame, field: DataFrame, thresholds: list[int], contexts: list[int]) -> DataFrame:
    """(channel, ay, ax, scan, context, token): for each shape the count of its non-zeros (scan -1), then its levels up to the last of them.

    ``levels`` has channel, ay, ax, shape, v, u and level; ``tiling`` by, bx,
    ay, ax; ``field`` the quant of anchors (ay, ax, raw), which with channel and
    shape tells the context of a block (see :func:`block_context`).  The lowest
    frequencies, one for each block, are told elsewhere.  A count's context is
    that of the counts of the blocks above and to the left, in groups of 32 by
    32 blocks; a level's that of how many are left, its place and whether the
    one before was zero.  All windows are bounded by a shape or a group's line.
    """
    kinds = len(set(contexts))
    shape = ["channel", "ay", "ax"]
    blocks, shift = _of_shape(lambda s: s.blocks), _of_shape(lambda s: s.blocks.bit_length() - 1)
    placed = levels.join(F.broadcast(scan_orders(levels.sparkSession)), ["shape", "v", "u"]).join(field, ["ay", "ax"])
    placed = placed.select(*shape, "shape", "raw", "scan", "level", blocks.alias("blocks"), shift.alias("shift")).where("scan >= blocks")
    some = (F.col("level") != 0).cast("long")
    counts = placed.groupBy(*shape).agg(F.first("shape").alias("shape"), F.first("raw").alias("raw"), F.first("blocks").alias("blocks"), F.sum(some).alias("count"))
    strategy = _of_shape(lambda s: STRATEGY[s.name])
    counts = counts.withColumn("block", block_context(strategy, F.col("channel"), F.col("raw"), thresholds, contexts))

    # counts a block, and what lies left of and above each anchor
    known = tiling.select("by", "bx", "ay", "ax").join(counts, ["ay", "ax"])
    known = known.withColumn("share", F.ceil(F.col("count") / F.col("blocks"))).withColumn("gy", F.expr(f"by div {GROUP}")).withColumn("gx", F.expr(f"bx div {GROUP}"))
    left = F.lag("share").over(Window.partitionBy("channel", "gy", "gx", "by").orderBy("bx"))
    above = F.lag("share").over(Window.partitionBy("channel", "gy", "gx", "bx").orderBy("by"))
    known = known.withColumn("left", left).withColumn("above", above).where("by = ay and bx = ax")
    guess = F.coalesce(F.floor((F.col("left") + F.col("above") + 1) / 2), "left", "above", F.lit(32))
    bucket = F.when(guess < 8, guess).when(guess >= 64, COUNT_BUCKETS - 1).otherwise(4 + F.floor(guess / 2))
    heads = known.select(*shape, F.lit(-1).cast("long").alias("scan"), (bucket * kinds + F.col("block")).cast("long").alias("context"), F.col("count").alias("token"))

    rows = placed.join(counts.select(*shape, "count", "block"), shape)
    w = Window.partitionBy(*shape).orderBy("scan")
    before = F.coalesce(F.sum(some).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = (F.col("count") <= F.col("blocks") * 4).cast("long")  # a sixteenth of the shape's samples
    rows = rows.withColumn("remaining", F.col("count") - before).withColumn("previous", F.coalesce(F.lag(some).over(w), first)).where("remaining > 0")
    held = F.expr("shiftright(remaining + blocks - 1, cast(shift as int))")
    local = (_entry(LEFT_CONTEXT, held) + _entry(PLACE_CONTEXT, F.expr("shiftright(scan, cast(shift as int))"))) * 2 + F.col("previous")
    context = kinds * COUNT_BUCKETS + LEVEL_CONTEXTS * F.col("block") + local
    return heads.unionByName(rows.select(*shape, "scan", context.cast("long").alias("context"), pack_signed(F.col("level")).alias("token")))
