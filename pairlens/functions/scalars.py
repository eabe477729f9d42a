"""Scalar rules used by several operators, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def overlap_weight(a: Column, b: Column) -> Column:
    """ab/(a+b): the weight of a stratum with so many pairs in either arm."""
    return a * b / (a + b)


def effective_size(total: Column, squares: Column) -> Column:
    return total * total / squares


def multiplicity(left: Column, right: Column, same: Column) -> Column:
    """A pair's weight in a replicate: the product of its endpoints' draws, a self pair counted once."""
    return F.when(same, left).otherwise(left * right)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def smooth_l1(error: Column) -> Column:
    size = F.abs(error)
    return F.when(size < 1, 0.5 * error * error).otherwise(size - 0.5)


def improvement(baseline: Column, method: Column, guard: str = "positive") -> Column:
    """Relative gain under one of four guards: positive, tiny, floor, none."""
    gain = baseline - method
    if guard == "positive":
        return F.when(baseline <= 0, 0.0).otherwise(gain / baseline)
    if guard == "tiny":
        return F.when(baseline <= 1e-12, 0.0).otherwise(gain / baseline)
    if guard == "floor":
        return gain / F.greatest(F.abs(baseline), F.lit(1e-12))
    return F.try_divide(gain, baseline)


def corrected(distance: Column, strength: Column, other: Column) -> Column:
    return F.greatest(F.lit(0.0), distance - strength * other)


def relation(a: Column, b: Column) -> list[Column]:
    """The unordered key of two labels."""
    return [F.least(a, b).alias("rel_l"), F.greatest(a, b).alias("rel_r")]


def group_seed(seed: int, *keys: Column | str) -> Column:
    """A seed of the group's own, so that groups of one size draw apart: the seed plus 28 bits of the digest of the group's keys."""
    return F.lit(seed) + F.conv(F.substring(F.md5(F.concat_ws("|", *keys).cast("binary")), 1, 7), 16, 10).cast("long")


def draw(seed: int | Column, replicate: Column, k: Column, n: Column) -> Column:
    """The k-th unit drawn in a replicate, 0..n-1, from integers alone: no state, no order, portable.

    Fixed values: the modulus and the multipliers of the counter-based generator.
    """
    p = 2147483647
    x = ((seed if isinstance(seed, Column) else F.lit(seed)) + replicate.cast("long") * 1000003 + k.cast("long") * 7919) % p
    y = (x * x) % p
    return ((y * 48271 + x) % p) % n


def sign(seed: int, replicate: Column, unit: Column) -> Column:
    return 1 - 2 * draw(seed, replicate, unit, F.lit(2))
