"""Training pools: masks, prevalence, allocation, permutations, diversity. Random order is a hash of (seed, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.scalars import draw
from pairlens.plans.scan import Run, scan
from pairlens.plans.storage import settled

Q_GRID = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)


def order_of(seed: int, unit: str) -> Column:
    """A portable pseudo-random order of integer ids."""
    return draw(seed, F.pmod(F.col(unit).cast("long"), F.lit(1_000_003)), F.lit(1), F.lit(2147483647))


def entropy(frame: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Shannon entropy in nats of a categorical column."""
    keys = keys or []
    n = frame.groupBy(*keys, column).agg(F.count("*").alias("n"))
    total = n.groupBy(*keys).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("s"), F.count("*").alias("values"))
    return total.select(*keys, "values", (F.ln("t") - F.col("s") / F.col("t")).alias("entropy"))


def covariates(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pairs, distinct subjects and relations, the share of reused ends, mean and population deviation of the target."""
    keys = keys or []
    ends = pairs.select(*keys, F.explode(F.array(F.struct(F.col("item_l").alias("i"), F.col("subject_l").alias("s")), F.struct(F.col("item_r").alias("i"), F.col("subject_r").alias("s")))).alias("e"))
    e = ends.groupBy(*keys).agg(F.count_distinct("e.s").alias("subjects"), (1 - F.count_distinct("e.i") / F.count("*")).alias("reuse"))
    p = pairs.groupBy(*keys).agg(F.count("*").alias("pairs"), F.count_distinct(F.least("category_l", "category_r"), F.greatest("category_l", "category_r")).alias("relations"), F.avg("target").alias("mean_target"), F.stddev_pop("target").alias("sd_target"))
    return p.join(e, keys) if keys else p.crossJoin(e)


def histogram(pairs: DataFrame, column: str = "target", digits: int = 6) -> DataFrame:
    return pairs.groupBy(F.round(column, digits).alias("bin")).agg(F.count("*").alias("n"))


def prevalence_capacity(pairs: DataFrame, grid: tuple[float, ...] = Q_GRID, step: int = 20) -> DataFrame:
    """One row: the pool size that every prevalence q allows, rounded down to a multiple of ``step``."""
    counts = pairs.agg(F.sum(F.when(F.col("target") != 0, 1).otherwise(0)).alias("nz"), F.sum(F.when(F.col("target") == 0, 1).otherwise(0)).alias("z"))
    q = counts.withColumn("q", F.explode(F.array(*map(F.lit, grid))))
    most = F.least(F.when(F.col("q") > 0, F.floor(F.col("nz") / F.col("q"))), F.when(F.col("q") < 1, F.floor(F.col("z") / (1 - F.col("q")))))
    return q.agg(F.max("nz").alias("nonzero"), F.max("z").alias("zero"), F.min(most).alias("m")).select("nonzero", "zero", (F.floor(F.col("m") / step) * step).cast("long").alias("capacity"))


def nested_masks(pool: DataFrame, unit: str, seed: int, grid: tuple[float, ...] = Q_GRID) -> DataFrame:
    """(unit, q, active): one random rank, the first round(q*n) active for every q (half to even), so masks nest."""
    ranked = scan(pool.select(unit), [], [order_of(seed, unit), unit], {"rank": Run("count")}, {"n": Run("count")})
    return ranked.withColumn("q", F.explode(F.array(*map(F.lit, grid)))).select(unit, "q", (F.col("rank") <= F.bround(F.col("q") * F.col("n"))).alias("active"))


def natural_pools(pool: DataFrame, unit: str, size: int, seed: int, grid: tuple[float, ...] = Q_GRID) -> DataFrame:
    """(q, unit): without replacement, round(q*size) of the non-zero targets and the rest of the zero ones."""
    kind = F.col("target") != 0
    ranked = scan(pool.select(unit, kind.alias("nz")), ["nz"], [order_of(seed, unit), unit], {"rank": Run("count")})
    q = ranked.withColumn("q", F.explode(F.array(*map(F.lit, grid))))
    want = F.bround(F.col("q") * size)
    return q.where(F.col("rank") <= F.when(F.col("nz"), want).otherwise(size - want)).select("q", unit)


def allocation(pool: DataFrame, stratum: str, size: int) -> DataFrame:
    """(stratum, n, share): largest-remainder allocation of ``size`` places; ties to the least stratum."""
    total = pool.agg(F.count("*").alias("__n"))
    g = pool.groupBy(stratum).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).withColumn("exact", F.col("n") * size / F.col("__n")).withColumn("base", F.floor("exact"))
    placed = scan(g, [], [F.round(F.col("base") - F.col("exact"), 9), stratum], {"place": Run("count")}, {"given": Run("sum", "base")})
    return placed.select(stratum, "n", (F.col("base") + F.when(F.col("place") <= size - F.col("given"), 1).otherwise(0)).cast("long").alias("share"))


def allocated_sample(pool: DataFrame, stratum: str, unit: str, size: int, seed: int) -> DataFrame:
    places = allocation(pool, stratum, size).select(stratum, "share")
    ranked = scan(pool, [stratum], [order_of(seed, unit), unit], {"__r": Run("count")})
    return ranked.join(places, stratum).where("__r <= share").drop("__r", "share")


def rotated(frame: DataFrame, unit: str, value: str, seed: int) -> DataFrame:
    """``shuffled``: each unit gets the next one's value in a random circle: no unit keeps its place, the histogram stays."""
    placed = settled(scan(frame, [], [order_of(seed, unit), unit], {"__i": Run("count")}, {"__n": Run("count")}))
    before = F.when(F.col("__i") == 1, F.col("__n")).otherwise(F.col("__i") - 1)
    return placed.join(placed.select(before.alias("__i"), F.col(value).alias("shuffled")), "__i").drop("__i", "__n")


def folds(frame: DataFrame, subject: str, k: int, seed: int) -> DataFrame:
    """(subject, fold): whole subjects dealt out in random order."""
    s = scan(frame.select(subject).distinct(), [], [order_of(seed, subject), subject], {"__i": Run("count")})
    return s.select(subject, F.pmod(F.col("__i") - 1, F.lit(k)).alias("fold"))


def folds_without_cross(frame: DataFrame, assigned: DataFrame, subject: str) -> DataFrame:
    """Folds that hold no subject of two categories: there must be none."""
    many = frame.groupBy(subject).agg(F.count_distinct("category").alias("c")).join(assigned, subject)
    return many.groupBy("fold").agg(F.max("c").alias("c")).where("c < 2").select("fold")


def shuffled_partners(examples: DataFrame, items: DataFrame, seed: int) -> DataFrame:
    """(pair_id, partner): each cross example gets an item of the same second category and of another subject than its first; null where that category has none.
    examples(pair_id, subject_l, category_r); items(item, subject, category).

    A category's items lie in a random line. An example looks at a place of its own in it; if the item there is its subject's, the next run of another subject has the partner. Three
    look-ups by unique place, whatever a category's size or a subject's share of it."""
    line = scan(items.select("category", "subject", "item"), ["category"], [order_of(seed, "item"), "item"], {"i": Run("count"), "before": Run("last", "subject", past=True)}, {"n": Run("count")})
    line = line.withColumn("start", F.when(F.col("before").isNull() | (F.col("before") != F.col("subject")), F.col("i")))
    look = settled(scan(line.drop("before"), ["category"], [F.col("i").desc()], {"next": Run("min", "start", past=True)}))
    sizes = look.groupBy("category").agg(F.max("n").alias("n"))
    at = lambda k: look.select(F.col("category").alias("category_r"), F.col("i").alias(f"p{k}"), F.col("item").alias(f"item{k}"), F.col("subject").alias(f"s{k}"), F.col("next").alias(f"next{k}"))
    first = examples.select("pair_id", "subject_l", "category_r").join(sizes.withColumnRenamed("category", "category_r"), "category_r", "left")
    first = first.withColumn("p0", 1 + F.pmod(F.xxhash64(F.lit(seed), "pair_id"), F.col("n"))).join(at(0), ["category_r", "p0"], "left")
    second = first.withColumn("p1", F.coalesce("next0", F.lit(1))).join(at(1), ["category_r", "p1"], "left")
    third = second.withColumn("p2", F.col("next1")).join(at(2), ["category_r", "p2"], "left")
    other = lambda k: F.when(F.col(f"s{k}") != F.col("subject_l"), F.col(f"item{k}"))
    return third.select("pair_id", F.coalesce(other(0), other(1), other(2)).alias("partner"))


def budget(counts: DataFrame, ratios: tuple[float, ...], strengths: tuple[float, ...]) -> DataFrame:
    """(ratio, strength, pair, cross_drawn, eta_separate, eta_mixed) of counts(pair, cross[, pair_norm, cross_norm]): draws an epoch, and the cross loss's share of the gradient when the two means are added,
    and when one mean is taken over all. Norms are those of the two gradients, 1 where they are not given; nothing to share is a share of 0."""
    grid = counts.withColumn("ratio", F.explode(F.array(*map(F.lit, ratios)))).withColumn("strength", F.explode(F.array(*map(F.lit, strengths))))
    k = grid.withColumn("cross_drawn", F.least("cross", F.bround(F.col("pair") * F.col("ratio")).cast("long")))
    norm = lambda c: F.col(c) if c in counts.columns else F.lit(1.0)
    share = lambda own, other: F.when(own + other > 0, other / (own + other)).otherwise(0.0)
    far = F.col("strength") * norm("cross_norm")
    return k.select("ratio", "strength", "pair", "cross_drawn", share(norm("pair_norm"), far).alias("eta_separate"), share(F.col("pair") * norm("pair_norm"), F.col("cross_drawn") * far).alias("eta_mixed"))


def slope_contrast(gains: DataFrame) -> DataFrame:
    """(ordinary, balanced, contrast): slopes of the mean gain on q by mode."""
    means = gains.groupBy("mode", "q").agg(F.avg("gain").alias("g"))
    s = means.groupBy("mode").agg(F.regr_slope("g", "q").alias("s"))
    pick = lambda m: F.max(F.when(F.col("mode") == m, F.col("s")))
    return s.agg(pick("ordinary").alias("ordinary"), pick("balanced").alias("balanced")).withColumn("contrast", F.col("ordinary") - F.col("balanced"))


def interaction_regression(gains: DataFrame) -> DataFrame:
    """(term, coefficient) of gain on 1, ln ratio, strength and their product. Sums of products come from one pass; four equations are solved."""
    import numpy as np

    x = [F.lit(1.0), F.ln("ratio"), F.col("strength"), F.col("strength") * F.ln("ratio")]
    sums = gains.agg(*(F.sum(x[i] * x[j]).alias(f"x{i}{j}") for i in range(4) for j in range(i, 4)), *(F.sum(x[i] * F.col("gain")).alias(f"y{i}") for i in range(4))).first()
    a = np.array([[float(sums[f"x{min(i, j)}{max(i, j)}"]) for j in range(4)] for i in range(4)])
    b = np.array([float(sums[f"y{i}"]) for i in range(4)])
    got = np.linalg.lstsq(a, b, rcond=None)[0]
    return gains.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(("one", "ln_ratio", "strength", "product"), got, strict=True)], "term string, coefficient double")
