"""Aggregations over blocks, tiles and whole planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(size: int) -> list[Column]:
    return [F.expr(f"y div {size}").alias("by"), F.expr(f"x div {size}").alias("bx")]


def power_mean(value: Column, power: int = 16) -> Column:
    return F.pow(F.avg(F.pow(value, F.lit(power))), F.lit(1.0 / power))


def block_norm(plane: DataFrame, size: int = 8, scale: float = 1.2) -> DataFrame:
    """Scaled 16-norm of each block (edge blocks over what they have)."""
    return plane.groupBy(*cell(size)).agg((scale * power_mean(F.col("value"))).alias("norm"))


def extrema(plane: DataFrame) -> DataFrame:
    return plane.agg(F.min("value").alias("least"), F.max("value").alias("greatest"), F.max(F.abs("value")).alias("magnitude"))


def quant_norm(field: DataFrame, key: str) -> DataFrame:
    """Of each transform: its one value, the greater of two, else the 16-norm."""
    n = F.count("*")
    return field.groupBy(key).agg(n.alias("blocks"), F.when(n <= 2, F.max("value")).otherwise(power_mean(F.col("value"))).alias("norm"))


def mean_max_mix(field: DataFrame, key: str, target: float) -> DataFrame:
    """Of each transform: its maximum, or with four blocks or more a mix with the mean."""
    limit, slope = 1.54138, 0.56391  # fixed values
    mix = max(0.0, 1 - (target - limit) * slope) if target > limit else 1.0
    n = F.count("*")
    return field.groupBy(key).agg(n.alias("blocks"), F.when(n >= 4, F.max("value") * mix + F.avg("value") * (1 - mix)).otherwise(F.max("value")).alias("value"))


def maximum_error(pairs: DataFrame, limits: dict[int, float], size: int = 8) -> DataFrame:
    """Greatest |a - b| / limit of each block and channel, and (by, bx null) of each channel."""
    limit = F.create_map(*[F.lit(v) for kv in limits.items() for v in kv])[F.col("channel")]
    e = pairs.select("channel", *cell(size), (F.abs(F.col("a") - F.col("b")) / limit).alias("e"))
    return e.groupingSets([["channel", "by", "bx"], ["channel"]], "channel", "by", "bx").agg(F.max("e").alias("error"))


def masked_error(pairs: DataFrame, weights: dict[int, float], size: int = 8) -> DataFrame:
    """Sum of mask^2 (a - b)^2 of each block, channels weighted."""
    weight = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])[F.col("channel")]
    d = F.col("a") - F.col("b")
    return pairs.groupBy(*cell(size)).agg(F.sum(weight * F.col("mask") * F.col("mask") * d * d).alias("error"))


def zero_counts(values: DataFrame, keys: list[str]) -> DataFrame:
    return values.groupBy(*keys).agg(F.count_if(F.col("value") == 0).alias("zeros"), F.count("*").alias("n"))


def cube_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Joint counts and both margins."""
    return rows.groupingSets([[a, b], [a], [b]], a, b).agg(F.count("*").alias("n"))


def distinct_tuples(rows: DataFrame, columns: list[str], most: int = 256) -> DataFrame:
    """How many distinct tuples there are, 0 if more than ``most``; looks at no more than it must."""
    few = rows.select(*columns).distinct().limit(most + 1)
    n = F.count("*")
    return few.agg(F.when(n > most, 0).otherwise(n).cast("long").alias("tuples"))


def sparse(rows: DataFrame) -> DataFrame:
    """Rows other than zero: a zero is known by its absence."""
    return rows.where(F.col("value") != 0)
