"""Materialised steps of iterative plans, in the folder all executors share, and global numbering."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shared_folder(spark) -> None:
    """The folder that the cluster names for checkpoints; one of our own only where none is set and all runs on one machine."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster must name a folder that all its machines share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "pairlens-checkpoints"))


def settled(frame: DataFrame) -> DataFrame:
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def numbered(frame: DataFrame, number: str, *by: str) -> DataFrame:
    """The rows with their ``number`` from 0 in the order of ``by``: sorted by range, numbered in each part, and the parts' sizes added up."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = settled(frame.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__p", F.spark_partition_id()).withColumn("__m", inside))
    # One row a part, however many rows there are.
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    return parts.join(F.broadcast(before), "__p").withColumn(number, F.col("__before") + F.col("__m")).drop("__p", "__m", "__before")
