"""What the text operators share: reading tables, words, shared storage and connected classes."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII blanks that part words.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: Column | str) -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """The runs of characters that are not ASCII blanks, in order; an empty array for none."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def picked(frame: DataFrame, test: Column) -> DataFrame:
    """The rows for which ``test`` holds. A plain filter would be pushed through the projections below, each of
    their steps written out again in it; the test of a generated column stays above and is evaluated once."""
    return frame.select("*", F.explode_outer(F.array(test)).alias("__picked")).where("__picked").drop("__picked")


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches], keep: bool = False) -> Callable[[Batches], Batches]:
    """A batch function after whose partition the worker gives its free memory back: workers outlive their tasks. With ``keep`` the worker
    holds freed memory until then, so that arrays of a few MB are not asked of the system again and again."""

    def whole(parts: Batches) -> Batches:
        system = ctypes.CDLL(None)
        if keep:
            for name, size in ((-3, 32 << 20), (-1, 256 << 20)):  # from where on arrays are mapped alone, and a free end is given back
                getattr(system, "mallopt", max)(name, size)
        yield from run(parts)
        gc.collect()
        pa.default_memory_pool().release_unused()
        getattr(system, "malloc_trim", int)(0)

    return whole


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only where none is set and all runs on one machine."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster must name a folder that all its machines share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "pairlens-checkpoints"))
    return spark.sparkContext.getCheckpointDir()


def written(frame: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: its lineage is cut and its size known, so that a join broadcasts it only if it is small."""
    at = f"{shared_folder(frame.sparkSession)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(at)
    return frame.sparkSession.read.parquet(at)


def even(frame: DataFrame) -> DataFrame:
    """A side that grows with the texts: its joins shuffle at every size, so that a row costs the same however many there are."""
    return frame.hint("merge")


def settled(frame: DataFrame) -> DataFrame:
    """The frame written to the shared folder, its lineage cut: a lost executor costs no recomputation."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node in ``edges(a, b)`` of ids that have an order; root is the least id of its class.

    Each round hooks every node to its least neighbour, follows the hooks to their tops and contracts the
    edges; only nodes that are least among their neighbours stay, half of them at most. Hubs are met by aggregation (combined before the
    shuffle) and by plain joins, which adaptive execution can split.
    """
    edges = settled(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    roots = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("to")))
        hook = settled(both.groupBy("node").agg(F.min("to").alias("up")))
        # To the top of every chain of hooks, by doubling.
        while True:
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            doubled = settled(hook.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), (F.coalesce("top", "up") != F.col("up")).alias("moved")))
            hook = doubled.select("node", "up")
            if doubled.where("moved").isEmpty():
                break
        named = lambda x: hook.select(F.col("node").alias(x), F.col("up").alias(f"{x}_up"))
        if roots is None:
            roots = hook.select("node", F.col("up").alias("root"))
        else:
            roots = roots.join(hook.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        roots = settled(roots)
        edges = edges.join(named("a"), "a").join(named("b"), "b").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).where("a <> b").distinct()
        edges = settled(edges)
    else:
        raise RuntimeError("classes did not settle")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
