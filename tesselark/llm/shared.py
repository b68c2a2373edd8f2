"""Small helpers shared by the operators: written tables and bounded samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, which all executors share.

    It is the one the session names; only where it names none and runs on a
    single machine, as in tests, a temporary one is set.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tesselark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in ``spark.checkpoint.dir``."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Intermediate results, written once as Parquet under ``spark.checkpoint.dir`` and deleted when told."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4()}", 0

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        """The written rows, read back, and where they are."""
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def delete(self, *paths: str) -> None:
        jvm, hadoop = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in map(jvm.org.apache.hadoop.fs.Path, paths):
            p.getFileSystem(hadoop).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``."""
    return F.crc32(column.cast("string").cast("binary")) % n


#: Characters of a text that a model is fitted on, and pieces that a longer one is told by.
TEXT_CHARS, TEXT_PIECES = 32768, 16


def bounded_text(text: Column) -> Column:
    """A text for a training sample: itself, or where it is longer than TEXT_CHARS, pieces spread evenly over all of it.

    So a sample of so many texts is bounded in bytes too, before it leaves the
    tasks.  Scoring reads whole texts.
    """
    size = TEXT_CHARS // TEXT_PIECES
    at = lambda k: F.floor((F.length(text) - size) * k / (TEXT_PIECES - 1)).cast("int") + 1
    pieces = F.concat_ws(" ", *[F.substring(text, at(k), F.lit(size)) for k in range(TEXT_PIECES)])
    return F.when(F.length(text) > TEXT_CHARS, pieces).otherwise(text)
