"""Explicit row order: dense positions without gathering rows in one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of an ordered block, about, and the least number of blocks.
BLOCK_ROWS = 500_000
MIN_BLOCKS = 8


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where all run in one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and cut from its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def grown(df: DataFrame) -> DataFrame:
    """The frame as a side of a join that grows with the tables: joins sort both sides.

    Spark broadcasts what is small as it is shuffled, compressed, and has to build it in the driver as a hash
    table many times as large; with its default of 10 MB that takes more than the driver has.
    """
    return df.hint("merge")


def dense_positions(df: DataFrame, order: list[Column], name: str = "pos", blocks: int | None = None) -> DataFrame:
    """Add 0, 1, 2, … in the given order.

    Rows are range-partitioned, numbered inside their block, and shifted by the sizes of the
    earlier blocks; only those sizes, one a block, meet in one task. The number of blocks
    grows with the rows.
    """
    if blocks is None:
        df = checkpoint(df)
        blocks = max(MIN_BLOCKS, df.count() // BLOCK_ROWS + 1)
    cut = checkpoint(df.repartitionByRange(blocks, *order).withColumn("_block", F.spark_partition_id()))
    sizes = cut.groupBy("_block").agg(F.count(F.lit(1)).alias("_size"))
    shifts = sizes.withColumn("_shift", F.coalesce(F.sum("_size").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    nth = F.row_number().over(Window.partitionBy("_block").orderBy(*order)) - 1
    return cut.join(F.broadcast(shifts), "_block").withColumn(name, (F.col("_shift") + nth).cast("long")).drop("_block", "_shift")
