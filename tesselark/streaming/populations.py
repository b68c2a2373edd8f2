"""Running histograms of token streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(tokens: DataFrame) -> DataFrame:
    """Counts of (context, value) over all that a stream of tokens has brought so far.

    The state is one row for each context and value; each micro-batch is
    counted before it is merged, as shards of a population are.  Write it in
    update or complete mode, with a checkpoint location.
    """
    return tokens.groupBy("context", "value").agg(F.count("*").alias("n"))


def windowed_counts(tokens: DataFrame, time: str, length: str, late: str) -> DataFrame:
    """Counts for each time window; rows later than ``late`` are too late and the window's state goes."""
    return tokens.withWatermark(time, late).groupBy(F.window(time, length), "context", "value").agg(F.count("*").alias("n"))
