"""Pairs with distances, reference values and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.vectors import cosine_from, dot
from pairlens.sources.items import DIM


def distances(pairs: DataFrame, vectors: DataFrame, zero: str = "null", dim: int | None = DIM) -> DataFrame:
    """``pairs`` (item_l, item_r, ...) with ``distance``. Vectors (item, vec, norm) meet the pairs in two joins."""
    side = lambda s: vectors.select(F.col("item").alias(f"item_{s}"), F.col("vec").alias(f"v{s}"), F.col("norm").alias(f"n{s}"))
    joined = pairs.join(side("l"), "item_l").join(side("r"), "item_r")
    return joined.withColumn("distance", cosine_from(dot("vl", "vr", dim), F.col("nl"), F.col("nr"), zero)).drop("vl", "vr", "nl", "nr")


def distances_within(items: DataFrame, keys: tuple[str, ...] = ("split", "category", "condition"), zero: str = "null", dim: int | None = DIM) -> DataFrame:
    """The matched pairs inside the strata of ``keys`` with ``distance``. The items meet with their vectors, so that what is shuffled are items and no row of a pair ever carries a vector."""
    from pairlens.operators.pairs import matched_pairs

    both = matched_pairs(items, keys, ("vec", "norm"))
    return both.withColumn("distance", cosine_from(dot("vec_l", "vec_r", dim), F.col("norm_l"), F.col("norm_r"), zero)).drop("vec_l", "vec_r", "norm_l", "norm_r")


def missing_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Endpoints without a vector: there must be none before an inner join."""
    ends = pairs.select(F.explode(F.array("item_l", "item_r")).alias("item")).distinct()
    return ends.join(vectors.select("item"), "item", "left_anti")


def available(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs both of whose ends have a vector."""
    known = vectors.select("item").distinct()
    for side in ("item_l", "item_r"):
        pairs = pairs.join(known.withColumnRenamed("item", side), side, "left_semi")
    return pairs


def binary_reference(l: Column, r: Column) -> Column:  # noqa: E741
    return F.when(F.floor(l / 2) == F.floor(r / 2), 0.0).otherwise(1.0)


def continuous_reference(l: Column, r: Column) -> Column:  # noqa: E741
    return F.abs(l - r).cast("double")


def targets(pairs: DataFrame, matrix: DataFrame) -> DataFrame:
    """``target`` from a label matrix (l, r, value): 0 within a label; pairs of unknown labels go. The matrix has labels squared rows."""
    m = matrix.select(F.col("l").alias("category_l"), F.col("r").alias("category_r"), F.col("value").alias("__v"))
    return pairs.join(m, ["category_l", "category_r"]).withColumn("target", F.when(F.col("category_l") == F.col("category_r"), 0.0).otherwise(F.col("__v"))).drop("__v")


def affine(frame: DataFrame, x: str, y: str, keys: list[str] | None = None, clamped: bool = False) -> DataFrame:
    """(keys, slope, intercept) of y on x. ``clamped``: slope at least 0, constant x gives (0, mean). Else least
    squares, the least-norm one for a constant x, (1, 0) for no rows."""
    keys = keys or []
    s = frame.groupBy(*keys).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.regr_slope(F.col(y), F.col(x)).alias("b"), F.regr_sxx(F.col(y), F.col(x)).alias("sxx"))
    flat = F.col("sxx") <= 1e-30
    if clamped:
        slope = F.when(flat | F.col("b").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), "b"))
        return s.select(*keys, slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))
    least = F.col("mx") * F.col("my") / (F.col("mx") * F.col("mx") + 1)
    slope = F.when(F.col("mx").isNull(), 1.0).when(flat | F.col("b").isNull(), least).otherwise(F.col("b"))
    const = F.when(F.col("mx").isNull(), 0.0).when(flat | F.col("b").isNull(), F.col("my") / (F.col("mx") * F.col("mx") + 1)).otherwise(F.col("my") - slope * F.col("mx"))
    return s.select(*keys, slope.alias("slope"), const.alias("intercept"))


def scored(pairs: DataFrame, fit: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``pairs`` (distance, target) with ``predicted`` and ``error`` under a fit of one row per key."""
    joined = pairs.join(F.broadcast(fit), keys) if keys else pairs.crossJoin(F.broadcast(fit))
    return joined.withColumn("predicted", F.col("slope") * F.col("distance") + F.col("intercept")).withColumn("error", F.abs(F.col("predicted") - F.col("target"))).drop("slope", "intercept")


def with_identity(rows: DataFrame, manifest: DataFrame, key: str = "pair_id", ends: tuple[str, ...] = ("item_l", "item_r"), extra: tuple[str, ...] = ("stratum",)) -> DataFrame:
    """``rows`` with the manifest's ``extra`` columns. Raises unless every row's key is in the manifest once, with the same ends; rows are neither lost nor made."""
    from pairlens.operators.validate import require

    require(manifest.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "manifest keys repeat")
    told = manifest.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in (*ends, *extra)))
    both = rows.drop(*extra).join(told, F.col(key) == F.col("__k"), "left")
    agree = F.col("__k").isNotNull()
    for c in ends:
        agree = agree & F.col(c).eqNullSafe(F.col(f"__{c}"))
    require(both.where(~agree).select(key), "rows the manifest does not have so")
    return both.select(*[c for c in rows.columns if c not in extra], *(F.col(f"__{c}").alias(c) for c in extra))


def paired(first: DataFrame, second: DataFrame, value: str = "error", key: str = "pair_id") -> DataFrame:
    """(key, first, second, delta) of two scored tables. Raises unless both hold the same keys, each once."""
    from pairlens.operators.validate import require, unmatched

    for f in (first, second):
        require(f.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "keys repeat")
    require(unmatched(first, second, [key]), "keys of one side alone")
    both = first.select(key, F.col(value).alias("first")).join(second.select(key, F.col(value).alias("second")), key)
    return both.withColumn("delta", F.col("first") - F.col("second"))


def aligned(method: DataFrame, baseline: DataFrame, key: str = "pair_id", same: tuple[str, ...] = ("item_l", "item_r", "stratum")) -> tuple[DataFrame, DataFrame]:
    """(paired rows, rows that do not agree): a pair's identity is its id and its endpoints, never its id alone."""
    b = baseline.select(key, *(F.col(c).alias(f"__{c}") for c in same), F.col("error").alias("base_error"))
    both = method.join(b, key, "full_outer")
    agree = F.lit(True)
    for c in same:
        agree = agree & F.coalesce(F.col(c) == F.col(f"__{c}"), F.lit(False))
    clean = [f"__{c}" for c in same]
    return both.where(agree).drop(*clean), both.where(~agree).drop(*clean)
