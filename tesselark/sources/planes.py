"""Planes: long-form tables (y, x, value) of dense grids, and where they come from."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a plane: a vector is a row, its components the columns."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "value"))
    return rows.select("y", F.col("x").cast("long").alias("x"), F.col("value").cast("double").alias("value"))


def event_plane(spark: SparkSession, sf_dir: str, width: int = 100) -> DataFrame:
    """The events' values in order of their ids, ``width`` to a row."""
    e = table(spark, sf_dir, "events")
    return e.select(F.expr(f"event_id div {width}").alias("y"), (F.col("event_id") % width).alias("x"), F.col("value").cast("double").alias("value"))


def integer_plane(plane: DataFrame, scale: int = 100) -> DataFrame:
    return plane.withColumn("value", F.round(F.col("value") * scale).cast("long"))


def extent(plane: DataFrame) -> tuple[int, int]:
    """(height, width): one row of two maxima reaches the driver."""
    h, w = plane.agg(F.max("y") + 1, F.max("x") + 1).first()
    return (h or 0, w or 0)


def padded(plane: DataFrame, size: tuple[int, int], n: int = 8) -> DataFrame:
    """The plane with its last row and column repeated up to multiples of ``n``."""

    def more(at: str, have: int) -> DataFrame:
        spare = F.sequence(F.lit(have - 1).cast("long"), F.lit(-(-have // n) * n - 1).cast("long"))
        return F.explode(F.when(F.col(at) == have - 1, spare).otherwise(F.array(at)))

    return plane.select(more("y", size[0]).alias("y"), "x", "value").select("y", more("x", size[1]).alias("x"), "value")


def synthetic_texture(spark: SparkSession, width: int, height: int) -> DataFrame:
    """A closed-form linear RGB test image: y, x, c0, c1, c2, between 0 and 1.

    A slow wave along each diagonal, a ramp, and a chequered grain that a hash
    of the place gives.
    """
    i = F.col("id")
    y, x = F.expr(f"id div {width}"), i % width
    rising, falling = F.sin((x + y) / 9.0), F.sin((x - y) / 23.0)
    ramp = (x + 1) / F.lit(float(width + 1))
    grain = (F.pmod(F.hash(y, x), F.lit(64)) + 8 * ((x + y) % 2)) / 720.0
    each = {"c0": 0.4 + 0.2 * rising + 0.1 * ramp, "c1": 0.45 + 0.2 * falling + 0.1 * ramp, "c2": 0.5 + 0.15 * rising * falling}
    return spark.range(width * height).select(y.alias("y"), x.alias("x"), *[(v + grain).alias(c) for c, v in each.items()])


def parse_pfm(data: bytes) -> np.ndarray:
    """(height, width, channels) of a portable float map; bottom row first in the file, as the format has it."""
    parts, at = [], 0
    for _ in range(3):
        end = data.index(b"\n", at)
        parts.append(data[at:end].split())
        at = end + 1
    kind, (w, h), scale = parts[0][0], map(int, parts[1]), float(parts[2][0])
    channels = {b"PF": 3, b"Pf": 1}[kind]
    values = np.frombuffer(data, "<f4" if scale < 0 else ">f4", offset=at)
    if len(values) != w * h * channels or not np.isfinite(values).all():
        raise ValueError("the size doesn't fit the header, or a sample is not finite")
    return values.reshape(h, w, channels)[::-1] * np.float32(abs(scale))


def parse_pnm(data: bytes) -> np.ndarray:
    """(height, width, channels) of a binary P5, P6 or P7 file of 8 or 16 bits; nothing may follow the samples."""
    if data[:2] == b"P7":
        head, _, body = data.partition(b"ENDHDR\n")
        field = dict(line.split(None, 1) for line in head.splitlines()[1:] if line and not line.startswith(b"#"))
        w, h, channels, most = (int(field[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
    else:
        channels, numbers, at = {b"P5": 1, b"P6": 3}[data[:2]], [], 2
        while len(numbers) < 3:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
                continue
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            numbers.append(int(data[at:end]))
            at = end
        (w, h, most), body = numbers, data[at + 1 :]
    values = np.frombuffer(body, ">u2" if most > 255 else "u1")
    if len(values) != w * h * channels:
        raise ValueError("the size doesn't fit the header")
    return values.reshape(h, w, channels)


def read_images(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Images of a folder as (path, channel, y, x, value); ``kind`` is pfm or pnm.

    Files are read by Spark's binary source and parsed where they are read, one
    image at a time.
    """
    parse = {"pfm": parse_pfm, "pnm": parse_pnm}[kind]

    def run(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                image = parse(bytes(content))
                h, w, c = image.shape
                y, x, k = np.indices(image.shape)
                yield pd.DataFrame({"path": np.repeat(name, h * w * c), "channel": k.ravel().astype(np.int32), "y": y.ravel(), "x": x.ravel(), "value": image.ravel().astype(np.float64)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfm" if kind == "pfm" else "*.p[agpn]m").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, channel int, y long, x long, value double")
