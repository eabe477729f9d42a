"""Order statistics the built-ins do not have in the needed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.plans.scan import Run, scan


def lower_weighted_median(frame: DataFrame, keys: list[str], value: str, weight: str, out: str = "median") -> DataFrame:
    """First value whose cumulative weight reaches half of the total, per group."""
    # Equal values are one: the sort then meets a value once.
    each = frame.where(F.col(weight) > 0).groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    run = scan(each, keys, [value], {"__c": Run("sum", "__w")}, {"__t": Run("sum", "__w")})
    return run.where(F.col("__c") >= F.col("__t") / 2).groupBy(*keys).agg(F.min(value).alias(out))


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation; null, not an error, where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def average_ranks(frame: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """``frame`` with the average rank of ``value`` in its group; groups of any size."""
    ties = frame.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    run = scan(ties, keys, [value], {"__c": Run("sum", "__n")})
    named = run.select(*(F.col(k).alias(f"__o{i}") for i, k in enumerate([*keys, value])), (F.col("__c") - (F.col("__n") - 1) / 2).alias(out))
    same = F.lit(True)
    for i, k in enumerate([*keys, value]):
        same = same & F.col(k).eqNullSafe(F.col(f"__o{i}"))
    return frame.join(named, same).select(*frame.columns, out)


def average_rank(value: str, keys: list[str]) -> Column:
    """The same as an expression, for groups that fit in a task (the relations of a few labels)."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def holm(frame: DataFrame, keys: list[str], p: str, tie: str) -> DataFrame:
    """``adjusted``: step-down p values, running maximum, at most 1; ties in the order of ``tie``."""
    placed = scan(frame, keys, [p, tie], {"__i": Run("count")}, {"__n": Run("count")}).withColumn("__raw", F.col(p) * (F.col("__n") - F.col("__i") + 1))
    return scan(placed, keys, ["__i"], {"__top": Run("max", "__raw")}).withColumn("adjusted", F.least(F.lit(1.0), "__top")).drop("__raw", "__i", "__n", "__top")


def pareto(frame: DataFrame, low: str, high: str, out: str = "efficient") -> DataFrame:
    """Flags rows that no other row beats: none has ``low`` no larger and ``high`` no smaller, one of them strictly."""
    points = frame.groupBy(low).agg(F.max(high).alias("__top"))
    fronts = scan(points, [], [low], {"__before": Run("max", "__top", past=True)})
    return frame.join(fronts, low).withColumn(out, (F.col(high) == F.col("__top")) & (F.col("__before").isNull() | (F.col("__before") < F.col(high)))).drop("__top", "__before")
