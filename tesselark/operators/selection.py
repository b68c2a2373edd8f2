"""Regression, argmin selection and search loops."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselark.functions.pointwise import error_multiplier, hybrid_uint, quantize_multiplier

COLOR_FACTOR, RIDGE = 84.0, 1e-9  # fixed values


def ridge(rows: DataFrame, keys: list[str], luma: str, chroma: str, base: float, distance: float = RIDGE) -> DataFrame:
    """Multiplier of each tile by ridge least squares, and its 8-bit value.

    One grouped pass of sums; tiles of any size aggregate partially.
    """
    a = F.col(luma) / COLOR_FACTOR
    b = F.lit(base) * F.col(luma) - F.col(chroma)
    g = rows.groupBy(*keys).agg(F.sum(a * b).alias("ab"), F.sum(a * a).alias("aa"), F.count("*").alias("n"))
    x = -F.col("ab") / (F.col("aa") + F.col("n") * distance * 0.5)
    return g.select(*keys, x.alias("factor"), quantize_multiplier(x).alias("quantized"))


def newton(rows: DataFrame, keys: list[str], luma: str, chroma: str, base: float, steps: int = 20) -> DataFrame:
    """Multiplier of each tile that minimises a bounded residual, by damped Newton steps.

    A tile is one group, of at most tile-size rows.
    """

    def slope(a: np.ndarray, b: np.ndarray, x: float, limit: float = 100.0) -> float:
        r = a * x + b
        return float((np.where(np.abs(r) < limit, 2 * r, 0) * a).sum() + 2e-9 * x * len(a))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        luma_v, chroma_v = frame[luma].to_numpy(float), frame[chroma].to_numpy(float)
        a, b, x, eps = luma_v / COLOR_FACTOR, base * luma_v - chroma_v, 0.0, 100.0
        for _ in range(steps):
            second = (slope(a, b, x + eps) - slope(a, b, x - eps)) / (2 * eps)
            step = slope(a, b, x) / (second + 0.85)
            x -= min(20.0, max(-20.0, step))
            if abs(step) < 3e-3:
                break
        return pd.DataFrame({**{k: [frame[k].iloc[0]] for k in keys}, "factor": [x]})

    kinds = dict(rows.dtypes)
    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", factor double")


def argmin(candidates: DataFrame, keys: list[str], bias: float = 1.0) -> DataFrame:
    """Of each block the candidate with the least error; the first wins ties; candidate 0's error is biased."""
    e = F.when(F.col("candidate") == 0, F.col("error") * bias).otherwise(F.col("error"))
    return candidates.groupBy(*keys).agg(F.min_by("candidate", F.struct(e, F.col("candidate"))).alias("candidate"))


def error_feedback(values: DataFrame, keys: list[str], limit: float, start: float, rounds: int = 5) -> DataFrame:
    """Quantiser step of each block after a fixed number of updates, and its greatest feasible one.

    In each round a block's step is divided by a multiplier of its greatest
    error (in units of ``limit``): below a half of the limit the step grows, at
    most twofold, above it shrinks.  All rounds are windows over the same keys:
    one shuffle, and no driver action between them.
    """
    w = Window.partitionBy(*keys)
    s = values.select(*keys, "value", F.lit(float(start)).alias("step"), F.lit(None).cast("double").alias("best"))
    for _ in range(rounds):
        error = F.max(F.abs(F.col("value") - F.rint(F.col("value") / F.col("step")) * F.col("step")) / F.lit(limit)).over(w)
        s = s.withColumn("e", error).withColumn("best", F.when(F.col("e") <= 1, F.greatest(F.coalesce("best", F.lit(0.0)), F.col("step"))).otherwise(F.col("best")))
        s = s.withColumn("step", F.col("step") / F.greatest(error_multiplier(F.col("e")), F.lit(0.5))).drop("e")
    return s.groupBy(*keys).agg(F.max("step").alias("step"), F.max("best").alias("best"))


def division(square: Column, vertical: Column, horizontal: Column) -> Column:
    """Square only if strictly cheapest; else vertical if strictly cheaper than horizontal."""
    return F.when((square < vertical) & (square < horizontal), "square").when(vertical < horizontal, "vertical").otherwise("horizontal")


def coding_mode(tokens: DataFrame) -> DataFrame:
    """One row: prefix for under 100 tokens or where every context has one symbol, else ans.

    ``tokens`` has context, value and n (how often).
    """
    s = tokens.withColumn("symbol", hybrid_uint(F.col("value"))["symbol"])
    by = s.groupBy("context").agg(F.min("symbol").alias("lo"), F.max("symbol").alias("hi"), F.sum("n").alias("n"))
    total, single = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.bool_and(F.col("lo") == F.col("hi")), F.lit(True))
    return by.agg(total.alias("tokens"), F.when((total < 100) | single, "prefix").otherwise("ans").alias("mode"))


def best_split(samples: DataFrame, properties: list[str], costs: list[str], penalty: int = 32) -> DataFrame:
    """One row: the single split (property > threshold) that lowers the total cost most, or none.

    Thresholds are 0 and the property's mean; each side takes its cheapest cost
    column (ties: the first named).  All candidates are conditional sums of one
    pass over the samples.
    """
    means = samples.agg(*[F.expr(f"sum({p}) div count(*)").alias(p) for p in properties]).first()
    tries = [(p, t) for p in properties for t in dict.fromkeys((0, means[p])) if t is not None]
    sums = [F.sum(c).alias(f"all_{c}") for c in costs]
    for i, (p, t) in enumerate(tries):
        up = F.col(p) > t
        sums += [F.count_if(up).alias(f"n{i}"), *[F.sum(F.when(up, F.col(c)).otherwise(0)).alias(f"s{i}_{c}") for c in costs]]
    r = samples.agg(F.count("*").alias("n"), *sums).first()
    best, found = min((r[f"all_{c}"] for c in costs), default=0) if r["n"] else 0, None
    for i, (p, t) in enumerate(tries if r["n"] else []):
        if 0 < r[f"n{i}"] < r["n"]:
            cost = min(r[f"s{i}_{c}"] for c in costs) + min(r[f"all_{c}"] - r[f"s{i}_{c}"] for c in costs) + penalty
            if cost < best:
                best, found = cost, (p, t)
    return samples.sparkSession.createDataFrame([(*(found or (None, None)), best)], "property string, threshold long, cost long")


def probe_sizes(probe: Callable[[list[float]], list[int]], low: float, high: float, attempts: int = 12) -> dict[float, int]:
    """The size at both ends and at the middles of the widest intervals, until ``attempts`` settings are known.

    Which settings are tried does not hang on the sizes, so these need not be
    monotone and ``probe`` gets all settings at once.
    """
    settings = [low, high]
    while len(settings) < attempts:
        known = sorted(settings)
        settings.append(max(((b - a, -a, (a + b) / 2) for a, b in zip(known, known[1:], strict=False)))[2])
    return dict(zip(settings, probe(settings), strict=True))


def nearest_below(sizes: dict[float, int], target: int) -> float:
    """The setting whose size is the nearest that fits; if none does, the nearest of all; then the smaller setting."""
    return min(sizes, key=lambda x: (sizes[x] > target, abs(sizes[x] - target), x))
