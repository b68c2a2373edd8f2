"""Joins of values with intervals, as joins by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _width(lo: Column, hi: Column) -> Column:
    """The least whole k with 2**k >= hi - lo, from -60 to 60; 61 for what has no end."""
    size = (hi - lo).cast("double")
    k = F.ceil(F.log2(F.greatest(size, F.lit(2.0**-60))))
    return F.when(lo.isNull() | hi.isNull() | ~(size < 2.0**60), 61).otherwise(F.least(k, F.lit(60))).cast("int")


def range_join(values: DataFrame, ranges: DataFrame, value: str, lo: str = "lo", hi: str = "hi", keys: list[str] | None = None) -> DataFrame:
    """Each row of ``values`` with each of ``ranges`` whose lo <= value < hi (null: no bound), within equal ``keys``.

    An interval is put on the grid whose cells are as wide as itself or up to
    twice that, a power of two, where it lies in at most two of them, however
    wide it is.  A value is put on the grids that some interval uses, at most
    122, in one cell of each.  So the join is one by cell, which Spark can
    spread, split where it is skewed, or broadcast where a side is small; the
    bounds are compared after.  A null value, or one that is no number, is in no
    interval.  Column names of the two sides other than keys must differ.
    """
    keys = keys or []
    grid = ranges.withColumn("__k", _width(F.col(lo), F.col(hi))).where(F.col(lo).isNull() | F.col(hi).isNull() | (F.col(lo) < F.col(hi)))
    used = [r[0] for r in grid.select("__k").distinct().collect()]  # at most 122
    if not used:
        used = [61]
    cell = lambda at, k: F.when(k == 61, F.lit(0.0)).otherwise(F.floor(at.cast("double") / F.pow(F.lit(2.0), k.cast("double"))).cast("double"))
    first, last = cell(F.col(lo), F.col("__k")), cell(F.col(hi), F.col("__k"))
    # of cells as wide as the interval at least the first and the one of its end are all
    cells = F.array_distinct(F.array(first, F.when(F.col("__k") == 61, first).otherwise(F.least(last, first + 1))))
    right = grid.withColumn("__cell", F.explode(cells))
    levels = F.array(*[F.struct(F.lit(k).alias("k"), cell(F.col(value), F.lit(k)).alias("cell")) for k in used])
    left = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn("__at", F.explode(levels))
    left = left.withColumn("__k", F.col("__at.k")).withColumn("__cell", F.col("__at.cell")).drop("__at")
    both = left.join(right, [*keys, "__k", "__cell"])
    inside = (F.col(lo).isNull() | (F.col(value) >= F.col(lo))) & (F.col(hi).isNull() | (F.col(value) < F.col(hi)))
    return both.where(inside).drop("__k", "__cell")
