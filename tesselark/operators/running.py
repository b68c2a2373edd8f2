"""Running sums and ranks of groups of any size, spread over tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one the session names, or in a local session without one a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tesselark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` in ``spark.checkpoint.dir``: a range partitioning computed twice need not cut at the same rows."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def running(rows: DataFrame, keys: list[str], order: list[str], n: str) -> DataFrame:
    """Adds __before, the sum of ``n`` over the rows before in the group's order, and __total, the group's.

    Rows are cut into ranges of keys and order.  A window runs inside each range
    only; what the ranges before hold of a group is a sum of their totals.
    """
    spread = checkpointed(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    at = ["__part", *keys]
    totals = spread.groupBy(*at).agg(F.sum(n).alias("__held"))
    w = Window.partitionBy(*keys)
    parts = totals.select(*[F.col(c).alias(f"__of_{c}") for c in at], (F.sum("__held").over(w.orderBy("__part")) - F.col("__held")).alias("__start"), F.sum("__held").over(w).alias("__total"))
    inside = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = spread.withColumn("__local", F.sum(n).over(inside) - F.col(n))
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in at]
    out = local.join(parts, same)
    return out.select(*rows.columns, (F.col("__start") + F.col("__local")).alias("__before"), "__total")


def ranks(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the position of each row, from 0, in its group's order."""
    r = running(rows.withColumn("__one", F.lit(1).cast("long")), keys, order, "__one")
    return r.select(*rows.columns, F.col("__before").alias(name))


class Written:
    """Tables written as Parquet to the shared folder, read back, and deleted when told."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, f"{checkpoint_folder(spark)}/written-{uuid.uuid4()}", 0

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def delete(self, path: str) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
