"""Quant and dead zones of blocks, chosen from statistics of their coefficients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselark.operators.tilings import SHAPES, weights

#: Greatest raw quant (fixed value).
MOST_RAW = 256
# Dead zones of the quadrants (low-low, high u, high v, both), what larger shapes take off, and their floor.
ZONES, LESS_A_BLOCK, LESS_MOST, ZONE_LEAST = (0.58, 0.64, 0.64, 0.64), 0.003, 0.08, 0.54
# What counts as nearly kept, what the border counts by channel, and few non-zeros of a single block.
NEARLY, KEEP, BORDER, FEW = 0.46, 0.9999, (70.0, 30.0, 60.0), 11.0
# Fixed values, by class of shape (the flat ones count as the tall ones) and channel: error allowed for each sample, and for each level.
ERROR_SHARE = {"16x16": (0.22080615753848404, 0.45797479824262011, 0.29859235095977965), "32x16": (0.70109486510286834, 0.16185281305512639, 0.14387691730035473), "32x32": (0.114985964456218638, 0.44656840441027695, 0.10587658215149048), "16x8": (0.46849665264409396, 0.41239077937781954, 0.088667407767185444)}
LEVEL_SHARE = {"16x16": (0.27450281941822197, 1.1255766549984996, 0.98950459134128388), "32x16": (0.4652168675598285, 0.40945807983455818, 0.36581899811751367), "32x32": (0.28034972424715715, 0.9182653201929738, 1.5581531543057416), "16x8": (0.26873118114033728, 0.68863712390392484, 1.2082085408666786)}
FLAT = {"16x32": "32x16", "8x16": "16x8"}
NORMALIZER = 2.2942708343284721


def _by_shape(value) -> Column:
    """What ``value`` is for a row's shape."""
    out = F.lit(None)
    for s in SHAPES:
        out = F.when(F.col("shape") == s.name, F.lit(value(s))).otherwise(out)
    return out


def _by_channel(values: tuple) -> Column:
    return F.when(F.col("channel") == 0, values[0]).when(F.col("channel") == 1, values[1]).otherwise(values[2])


def statistics(coefficients: DataFrame, field: DataFrame, scale: float) -> DataFrame:
    """One row a shape and channel: raw, shape and what its coefficients hold, in one grouped pass.

    ``coefficients`` has channel, ay, ax, shape, v, u and value, scaled as means
    are; ``field`` the raw quant of anchors (ay, ax, raw).  The matrices are one
    fixed table, joined by shape and place.
    """
    table = [(s.name, c, v, u, float(weights(s, c)[v, u])) for s in SHAPES for c in range(3) for v in range(8 * s.rows) for u in range(8 * s.cols)]
    matrix = F.broadcast(coefficients.sparkSession.createDataFrame(table, "shape string, channel long, v long, u long, weight double"))
    rows, cols, blocks = _by_shape(lambda s: s.rows), _by_shape(lambda s: s.cols), _by_shape(lambda s: s.blocks)
    c = coefficients.join(matrix, ["shape", "channel", "v", "u"]).join(field, ["ay", "ax"]).withColumn("rows", rows).withColumn("cols", cols)
    c = c.where(~((F.col("v") < F.col("rows")) & (F.col("u") < F.col("cols"))))
    v, u = F.col("v") / F.col("rows"), F.col("u") / F.col("cols")  # in eighths of the shape
    high_v, high_u = v >= 4, u >= 4
    less = F.when(blocks > 1, F.least(blocks * LESS_A_BLOCK, F.lit(LESS_MOST))).otherwise(0.0)
    floor = F.when(blocks > 1, ZONE_LEAST).otherwise(0.0)
    quadrant = F.when(high_v & high_u, 3).when(high_v, 2).when(high_u, 1).otherwise(0)
    zone = F.greatest(F.when(quadrant == 0, ZONES[0]).otherwise(ZONES[1]) - less, floor)
    value = F.col("value") / F.col("weight") * scale * F.col("raw")
    c = c.withColumn("value", value).withColumn("q", quadrant)
    c = c.withColumn("level", F.abs(F.when(F.abs("value") < zone, 0.0).otherwise(F.rint("value")))).withColumn("error", F.abs(F.abs("value") - F.col("level")))
    border = ((v >= 7) & (u >= 7)) | (((F.col("v") + 1 == 8 * F.col("rows")) | (F.col("u") + 1 == 8 * F.col("cols"))) & high_v & high_u)
    held = [F.sum(F.when(F.col("q") == k, F.col("level")).otherwise(0.0)).alias(f"held{k}") for k in range(4)]
    lost = [F.coalesce(F.max(F.when((F.col("q") == k) & (F.col("level") == 0), F.col("error"))), F.lit(0.0)).alias(f"lost{k}") for k in range(4)]
    sums = [F.sum("error").alias("error"), F.sum("level").alias("level"), F.sum(F.when(border & (F.col("level") > 0), F.abs("value")).otherwise(0.0)).alias("border")]
    return c.groupBy("ay", "ax", "shape", "channel").agg(F.first("raw").alias("raw"), *held, *lost, *sums)


def choose(stats: DataFrame) -> DataFrame:
    """(ay, ax, shape, raw, zone0 to zone3): the greatest quant that a channel asks for, and the middle channel's dead zones.

    A middle channel with hardly a level left gets a finer quant, or smaller
    dead zones, where a coefficient was nearly kept.  Strong coefficients at the
    far border, single blocks with few non-zeros and shapes with a great error
    ask for more; even activity in all quadrants allows less.
    """
    blocks = _by_shape(lambda s: s.blocks)
    col = F.col
    middle = col("channel") == 1
    less = F.when(blocks > 1, F.least(blocks * LESS_A_BLOCK, F.lit(LESS_MOST))).otherwise(0.0)
    zones = [F.greatest(F.lit(z) - less, F.when(blocks > 1, ZONE_LEAST).otherwise(0.0)) for z in ZONES]
    near = [(col(f"held{k}") == 0) & (col(f"lost{k}") > NEARLY) for k in range(4)]
    empty = middle & (col("level") * 8 < blocks)
    raised = col("raw") + F.when(empty & (near[1] | near[2] | near[3]), 1).otherwise(0)
    widened = lambda lost: KEEP * lost * raised / col("raw")
    zones[3] = F.when(empty & near[3], widened(col("lost3"))).otherwise(zones[3])
    side = empty & ~near[3] & (near[1] | near[2])
    for k in (1, 2):
        zones[k] = F.when(side, widened(F.greatest("lost1", "lost2"))).otherwise(zones[k])
    zones[0] = F.when(empty & ~near[3] & ~near[1] & ~near[2] & near[0], widened(col("lost0"))).otherwise(zones[0])
    s = stats.select("*", raised.cast("double").alias("r"), *[z.alias(f"zone{k}") for k, z in enumerate(zones)])

    held = col("held0") + col("held1") + col("held2") + col("held3")
    far = _by_channel(BORDER) * col("border")
    capped = lambda r: F.when(r >= MOST_RAW, MOST_RAW - 1).otherwise(r).cast("double")
    s = s.withColumn("r", F.when(far >= held + 1, capped(F.floor(col("r") + far / (held + 1)))).otherwise(col("r")))
    s = s.withColumn("r", F.when((col("shape") == "8x8") & (held < FEW), capped(col("r") + 1)).otherwise(col("r")))
    share = [_by_shape(lambda s, t=t, c=c: t.get(FLAT.get(s.name, s.name), (None,) * 3)[c]) for t in (ERROR_SHARE, LEVEL_SHARE) for c in range(3)]
    allowed = _by_channel(tuple(share[:3])) * blocks * 64 + _by_channel(tuple(share[3:])) * col("level") * NORMALIZER
    over = col("error") * NORMALIZER
    s = s.withColumn("r", F.when(over > allowed, capped(col("r") + F.least(F.floor(over / allowed), F.lit(2)))).otherwise(col("r")))
    least = F.least(*[f"held{k}" for k in range(4)])
    active = F.when(least < 15 * blocks, F.floor((F.floor(least) + F.floor(blocks / 2)) / blocks)).otherwise(15)
    s = s.withColumn("active", active).withColumn("r", F.greatest(col("r") - col("active"), F.lit(4.0), F.floor(col("r") / 2)))
    own = F.struct(col("zone0"), *[(col(f"zone{k}") + 0.01 * col("active")).alias(f"zone{k}") for k in (1, 2, 3)])
    best = s.groupBy("ay", "ax", "shape").agg(F.max("r").cast("long").alias("raw"), F.first(F.when(middle, own), ignorenulls=True).alias("z"))
    return best.select("ay", "ax", "shape", "raw", "z.*")
