"""Predictors, residual tokens, runs and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselark.functions.pointwise import bit_width, pack_signed
from tesselark.operators.running import ranks, running
from tesselark.operators.stencils import causal


def _div(a: Column, n: int) -> Column:
    """Integer quotient that drops the fraction."""
    return F.when(a < 0, -F.floor(-a / F.lit(n))).otherwise(F.floor(a / F.lit(n))).cast("long")


#: The predictors that need no adaptive state, by name.
PREDICTORS = ("zero", "left", "top", "average0", "select", "gradient", "top_right", "top_left", "left_left", "average1", "average2", "average3", "average4")


def predictor(name: str) -> Column:
    """A prediction from the neighbour columns that ``causal`` adds."""
    left, top, tl, tr, ll, tt, trr = (F.col(c) for c in ("left", "top", "top_left", "top_right", "left_left", "top_top", "top_right_right"))
    return {
        "zero": lambda: F.lit(0).cast("long"),
        "left": lambda: left,
        "top": lambda: top,
        "average0": lambda: _div(left + top, 2),
        "select": lambda: F.when(F.abs(top - tl) < F.abs(left - tl), left).otherwise(top),
        "gradient": lambda: F.least(F.greatest(left + top - tl, F.least(left, top)), F.greatest(left, top)),
        "top_right": lambda: tr,
        "top_left": lambda: tl,
        "left_left": lambda: ll,
        "average1": lambda: _div(left + tl, 2),
        "average2": lambda: _div(tl + top, 2),
        "average3": lambda: _div(top + tr, 2),
        "average4": lambda: _div(6 * top - 2 * tt + 7 * left + ll + trr + 3 * tr + 8, 16),
    }[name]()


def residuals(plane: DataFrame, name: str = "gradient") -> DataFrame:
    """(y, x, prediction, token): the residual of each sample, packed to an unsigned token."""
    p = predictor(name)
    return causal(plane).select("y", "x", p.alias("prediction"), pack_signed(F.col("value") - p).alias("token"))


def predictor_costs(plane: DataFrame, stride: int = 1, width: int = 100) -> DataFrame:
    """Total cost, 1 + bits of the packed residual, of every predictor over each ``stride``-th sample."""
    c = causal(plane).where((F.col("y") * width + F.col("x")) % stride == 0)
    costs = [F.sum(1 + bit_width(pack_signed(F.col("value") - predictor(n)))).alias(n) for n in PREDICTORS]
    wide = c.agg(*costs)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("predictor"), F.col(n).alias("cost")) for i, n in enumerate(PREDICTORS)])).alias("r")).select("r.*")


def best_predictor(costs: DataFrame) -> DataFrame:
    """The cheapest predictor; gradient wins ties, then the first."""
    key = F.struct("cost", F.when(F.col("predictor") == "gradient", -1).otherwise(F.col("ordinal")))
    return costs.agg(F.min_by("predictor", key).alias("predictor"), F.min("cost").alias("cost"))


def run_lengths(rows: DataFrame, order: str, value: str, keys: list[str]) -> DataFrame:
    """Runs of equal values in order: (keys, start, value, length)."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = (F.lag(value).over(w).isNull() | (F.lag(value).over(w) != F.col(value))).cast("int")
    marked = rows.withColumn("run", F.sum(new).over(w))
    return marked.groupBy(*keys, "run").agg(F.min(order).alias("start"), F.first(value).alias("value"), F.count("*").alias("length")).drop("run")


def offsets(counts: DataFrame, keys: list[str], order: str, n: str) -> DataFrame:
    """Exclusive running sums of ``n`` within each group: where each item's output starts."""
    return running(counts, keys, [order], n).select(*counts.columns, F.col("__before").alias("offset"))


def stable_rank(rows: DataFrame, family: str, order: str) -> DataFrame:
    """Position of each row among its family, in raster order (a stable counting sort's scatter)."""
    return ranks(rows, [family], [order], "rank")


def coefficient_tokens(blocks: DataFrame) -> DataFrame:
    """Tokens of blocks (block, pos, value): how many non-zeros remain, and whether the one before was one.

    Emission stops where no non-zero remains.
    """
    w = Window.partitionBy("block").orderBy("pos")
    nz = (F.col("value") != 0).cast("int")
    total = F.sum(nz).over(Window.partitionBy("block"))
    before = F.coalesce(F.sum(nz).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = blocks.withColumn("remaining", (total - before).cast("long")).withColumn("previous", F.coalesce(F.lag(nz).over(w), F.lit(0)))
    return t.where("remaining > 0").select("block", "pos", "remaining", "previous", pack_signed(F.col("value")).alias("token"))


def segment(level: Column, thresholds: list[int]) -> Column:
    """How many thresholds a level is above."""
    return sum((F.when(level > t, 1).otherwise(0) for t in thresholds), F.lit(0)).cast("long")
