"""Vector expressions: dot products that stay in generated code, the four zero-vector rules of cosine distance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many dimensions a dot product is written out term by term, which generated code evaluates.
UNROLLED = 256


#: Terms of a sum that generated code holds in one method: the JVM compiles no method of more than 8,000 bytes of code, and interprets it, many times slower.
_TERMS = 16


def _terms(a: Column, b: Column, places: range) -> Column:
    return reduce(lambda s, i: s + F.get(a, F.lit(i)) * F.get(b, F.lit(i)), places, F.lit(0.0))


def _shared(c: Column) -> Column:
    """The same value, named twice: an expression that occurs twice is evaluated once, in a method of its own."""
    return F.greatest(c, c)


def dot(a: Column | str, b: Column | str, dim: int | None = None) -> Column:
    if dim is not None and dim <= UNROLLED:
        a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
        return reduce(lambda s, lo: s + _shared(_terms(a, b, range(lo, min(dim, lo + _TERMS)))), range(0, dim, _TERMS), F.lit(0.0))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str, dim: int | None = None) -> Column:
    return F.sqrt(dot(a, a, dim))


def cosine_from(dots: Column, left: Column, right: Column, zero: str = "null") -> Column:
    """Cosine distance from a dot product and two norms, clamped to 0..2.

    ``zero``: what a zero vector gives. "null"; "distinct" (two zeros 0, one zero 1); "orthogonal" (1);
    "epsilon" (norm product floored, not clamped).
    """
    if zero == "epsilon":
        return 1 - dots / F.greatest(left * right, F.lit(1e-8))
    plain = F.least(F.greatest(1 - dots / (left * right), F.lit(0.0)), F.lit(2.0))
    missing = {"null": F.lit(None).cast("double"), "distinct": F.when((left == 0) & (right == 0), 0.0).otherwise(1.0), "orthogonal": F.lit(1.0)}[zero]
    empty = (left == 0) | (right == 0)
    # The first test is what every row evaluates: an expression that stands in a branch alone is not shared.
    return F.when(dots.isNull(), F.when(empty, missing).otherwise(0.0)).when(empty, missing).otherwise(plain)


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def plus(a: Column, b: Column, times: Column | float = 1.0) -> Column:
    times = F.lit(times) if isinstance(times, (int, float)) else times
    return F.zip_with(a, b, lambda x, y: x + times * y)


def l2_normalised(a: Column, dim: int | None = None) -> Column:
    n = norm(a, dim)
    return F.transform(a, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def mean_vectors(items: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """(keys, n, sums, mean): per group the count, the sum and the mean vector, combined before the shuffle."""
    long = items.select(*keys, F.posexplode(vec).alias("pos", "x"))
    by = long.groupBy(*keys, "pos").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    ordered = by.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("ps"))
    return ordered.select(*keys, "n", F.transform("ps", lambda p: p["s"]).alias("sums")).withColumn("mean", F.transform("sums", lambda x: x / F.col("n")))
