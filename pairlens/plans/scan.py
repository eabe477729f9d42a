"""Running values in a global order, without a window over a table.

The rows are sorted by range of (keys, order) and stay in their parts. Inside a part a value runs over each segment (the rows of one key) alone; one row a part and
segment says what the part adds, and what the parts before have added is joined back. A segment may lie across any number of parts, and none has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.plans.storage import settled


class Run(NamedTuple):
    """A value that runs: count, sum, max, min or last (the last that is not null) of ``column``; ``past``: of the rows before alone."""

    kind: str
    column: str | None = None
    past: bool = False


_OVER: dict[str, Callable[[Column], Column]] = {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
#: How two stretches of rows add up.
_BOTH: dict[str, Callable[[Column, Column], Column]] = {
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
    "max": F.greatest,
    "min": F.least,
    "last": lambda a, b: F.coalesce(b, a),
}


def scan(frame: DataFrame, keys: list[str], order: list[str | Column], running: dict[str, Run], whole: dict[str, Run] | None = None) -> DataFrame:
    """``frame`` with every ``running`` value, taken in the order of ``order`` inside each group of ``keys``, and the ``whole`` values of the group. Keys may be null; rows
    that tie in the order come in any."""
    whole = whole or {}
    sort = [*keys, *order]
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = settled(frame.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__p", F.spark_partition_id()).withColumn("__m", inside))
    of = lambda r: F.lit(1) if r.column is None else F.col(r.column)

    def added(r: Run) -> Column:
        return F.max_by(of(r), F.when(of(r).isNotNull(), F.col("__m"))) if r.kind == "last" else _OVER[r.kind](of(r))

    steps = {**running, **whole}
    tails = parts.groupBy("__p", *keys).agg(*(added(r).alias(f"__t_{n}") for n, r in steps.items()))
    # One row a part and segment.
    earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    all_ = earlier.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = lambda r: _OVER["sum" if r.kind == "count" else r.kind]
    led = tails.select(F.col("__p").alias("__q"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(over(r)(F.col(f"__t_{n}")).over(earlier).alias(f"__b_{n}") for n, r in running.items()), *(over(r)(F.col(f"__t_{n}")).over(all_).alias(n) for n, r in whole.items()))
    own = Window.partitionBy("__p", *keys).orderBy("__m")
    local = lambda r: _OVER[r.kind](of(r)).over(own.rowsBetween(Window.unboundedPreceding, -1 if r.past else 0))
    ran = parts.select("*", *(local(r).alias(f"__r_{n}") for n, r in running.items()))
    same = F.col("__p") == F.col("__q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return ran.join(led, same).select(*frame.columns, *(_BOTH[r.kind](F.col(f"__b_{n}"), F.col(f"__r_{n}")).alias(n) for n, r in running.items()), *whole)
