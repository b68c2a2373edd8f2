"""Block transforms, quantisation, squeeze and palettes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dct_basis(n: int = 8) -> np.ndarray:
    """Orthonormal DCT-II basis (frequency, place)."""
    return np.array([[math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * k * (2 * i + 1) / (2 * n)) for i in range(n)] for k in range(n)])


def blocks(plane: DataFrame, n: int = 8, wide: int | None = None) -> DataFrame:
    """Samples by block: ``n`` rows high and ``wide`` columns (``n`` if not told) wide."""
    m = wide or n
    return plane.select(F.expr(f"y div {n}").alias("by"), F.expr(f"x div {m}").alias("bx"), (F.col("y") % n).cast("int").alias("v"), (F.col("x") % m).cast("int").alias("u"), "value")


def dct(rows: DataFrame, n: int = 8, forward: bool = True, wide: int | None = None) -> DataFrame:
    """Two-dimensional DCT of whole blocks (by, bx, v, u, value) of ``n`` rows and ``wide`` columns, or its inverse.

    Blocks come together in one shuffle; a task takes as many as a batch holds
    through two matrix products.  A block that lacks samples is an error.
    """
    m = wide or n
    tall, flat = dct_basis(n), dct_basis(m)
    if not forward:
        tall, flat = tall.T, flat.T
    place_v, place_u = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []
        for batch in batches:
            held = pa.Table.from_batches([*left, batch])
            count = held.num_rows // (n * m)
            left = held.slice(count * n * m).to_batches()
            if not count:
                continue
            whole = held.slice(0, count * n * m).combine_chunks()
            columns = {c: whole.column(c).to_numpy().reshape(count, n * m) for c in whole.column_names}
            if (columns["v"] != place_v).any() or (columns["u"] != place_u).any():
                raise ValueError("a block lacks samples")
            value = tall @ columns["value"].reshape(count, n, m) @ flat.T
            out = whole.set_column(whole.column_names.index("value"), "value", pa.array(value.ravel()))
            yield from out.to_batches()
        if left:
            raise ValueError("a block lacks samples")

    names = ["by", "bx", "v", "u", "value"]
    kinds = dict(rows.dtypes)
    whole = rows.select(*names[:4], F.col("value").cast("double").alias("value")).repartition("by", "bx").sortWithinPartitions(*names[:4])
    return whole.mapInArrow(run, ", ".join(f"{c} {kinds[c] if c != 'value' else 'double'}" for c in names))


def quantize(value: Column, step: Column | float, dead_zone: float = 0.58) -> Column:
    """Scales by the step, rounds halves to even, and drops what lies inside the dead zone."""
    scaled = value / step
    return F.when(F.abs(scaled) < dead_zone, 0).otherwise(F.rint(scaled)).cast("long")


def quadrant_quantize(value: Column, step: float, thresholds: tuple[float, float, float, float], n: int = 8) -> Column:
    """:func:`quantize` with a dead zone for each quadrant of the block (low-low, high u, high v, both)."""
    scaled = value / F.lit(step)
    half = n // 2
    t = F.when((F.col("v") < half) & (F.col("u") < half), thresholds[0]).when(F.col("v") < half, thresholds[1]).when(F.col("u") < half, thresholds[2]).otherwise(thresholds[3])
    return F.when(F.abs(scaled) < t, 0).otherwise(F.rint(scaled)).cast("long")


def average(a: Column, b: Column) -> Column:
    """Mean of two integers, rounded towards the greater first one."""
    return F.shiftright(a + b + F.when(a > b, 1).otherwise(0), 1)


def tendency(b: Column, a: Column, n: Column) -> Column:
    """What the slope through b, a, n lets one expect of a difference, kept monotone."""

    def bounded(d: Column, sign: int) -> Column:
        odd = d.bitwiseAND(F.lit(1).cast("long"))
        one, two = 2 * (b - a), 2 * (a - n)
        if sign > 0:
            d = F.when(d - odd > one, one + 1).otherwise(d)
            return F.when(d + d.bitwiseAND(F.lit(1).cast("long")) > two, two).otherwise(d)
        d = F.when(d + odd < one, one - 1).otherwise(d)
        return F.when(d - d.bitwiseAND(F.lit(1).cast("long")) < two, two).otherwise(d)

    def slope(sign: int) -> Column:
        return _div(4 * b - 3 * n - a + 6 * sign, 12)

    return F.when((b >= a) & (a >= n), bounded(slope(1), 1)).when((b <= a) & (a <= n), bounded(slope(-1), -1)).otherwise(0).cast("long")


def _div(a: Column, n: int) -> Column:
    """Integer quotient that drops the fraction."""
    return (F.signum(a.cast("double")).cast("long")) * F.floor(F.abs(a) / F.lit(n)).cast("long")


def squeeze(lines: DataFrame) -> DataFrame:
    """Splits integer lines (line, pos, value) into (line, pos, average, residual).

    The last sample of an odd line is an average without residual.  The forward
    step reads source samples only, so a line needs no recurrence.
    """
    pair = lines.groupBy("line", F.expr("pos div 2").alias("pos")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("pos") % 2 == 1, F.col("value"))).alias("b"))
    w = Window.partitionBy("line").orderBy("pos")
    pair = pair.withColumn("average", F.when(F.col("b").isNull(), F.col("a")).otherwise(average(F.col("a"), F.col("b"))))
    pair = pair.withColumn("before", F.coalesce(F.lag("b").over(w), F.col("average"))).withColumn("after", F.coalesce(F.lead("average").over(w), F.col("average")))
    residual = F.col("a") - F.col("b") - tendency(F.col("before"), F.col("average"), F.col("after"))
    return pair.select("line", "pos", "average", residual.alias("residual"))


def _tendency(b: int, a: int, n: int) -> int:
    if b >= a >= n:
        d = abs(4 * b - 3 * n - a + 6) // 12
        if d - (d & 1) > 2 * (b - a):
            d = 2 * (b - a) + 1
        return min(d, 2 * (a - n)) if d + (d & 1) > 2 * (a - n) else d
    if b <= a <= n:
        d = -(abs(4 * b - 3 * n - a - 6) // 12)
        if d + (d & 1) < 2 * (b - a):
            d = 2 * (b - a) - 1
        return max(d, 2 * (a - n)) if d - (d & 1) < 2 * (a - n) else d
    return 0


def unsqueeze(pairs: DataFrame) -> DataFrame:
    """The lines that :func:`squeeze` split.  A line is undone in order: each sample needs the one before."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        average, residual = frame["average"].tolist(), frame["residual"].tolist()
        out: list[int] = []
        for p, (avg, r) in enumerate(zip(average, residual, strict=True)):
            if r is None or (isinstance(r, float) and math.isnan(r)):
                out.append(int(avg))
                break
            after = int(average[p + 1]) if p + 1 < len(average) else int(avg)
            diff = int(r) + _tendency(out[-1] if out else int(avg), int(avg), after)
            a = int(avg) + (abs(diff) // 2) * (1 if diff >= 0 else -1)
            out += [a, a - diff]
        return pd.DataFrame({"line": frame["line"].iloc[0], "pos": np.arange(len(out)), "value": np.array(out, np.int64)})

    return pairs.groupBy("line").applyInPandas(run, "line long, pos long, value long")


def palette(rows: DataFrame, columns: list[str], most: int = 256) -> DataFrame:
    """Distinct tuples in order with their index; none if there are more than ``most``."""
    few = rows.select(*columns).distinct().limit(most + 1)
    w = Window.partitionBy(F.lit(0))
    ranked = few.withColumn("index", F.row_number().over(w.orderBy(*columns)).cast("long") - 1).withColumn("kinds", F.count("*").over(w))
    return ranked.where(F.col("kinds") <= most).drop("kinds")


def to_indices(rows: DataFrame, columns: list[str], most: int = 256) -> DataFrame:
    """``rows`` with the palette index of each; the palette (at most ``most`` rows) is broadcast."""
    return rows.join(F.broadcast(palette(rows, columns, most)), columns)

