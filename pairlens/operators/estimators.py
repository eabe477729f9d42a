"""Stratified and weighted estimates over distance rows (stratum, arm, subject_l, subject_r, distance) and scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.ordering import average_rank, correlation
from pairlens.functions.scalars import effective_size, overlap_weight, relation
from pairlens.plans.storage import settled


def _arm(arm: str, c: str = "distance") -> Column:
    return F.when(F.col("arm") == arm, F.col(c))


def stratum_effects(rows: DataFrame, keys: tuple[str, ...] = ("stratum",), one_armed: str = "drop") -> DataFrame:
    """Per stratum: pairs per arm, medians, effect B - A, overlap weight and contribution. ``one_armed``: "drop" or "keep" (null effect)."""
    g = rows.groupBy(*keys).agg(F.count(_arm("A")).alias("n_a"), F.count(_arm("B")).alias("n_b"), F.median(_arm("A")).alias("median_a"), F.median(_arm("B")).alias("median_b"))
    if one_armed == "drop":
        g = g.where("n_a > 0 AND n_b > 0")
    weight = F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), overlap_weight(F.col("n_a"), F.col("n_b"))).otherwise(0.0)
    return g.withColumn("effect", F.col("median_b") - F.col("median_a")).withColumn("weight", weight).withColumn("contribution", F.col("weight") * F.col("effect"))


def one_armed(rows: DataFrame) -> DataFrame:
    """Strata that lack an arm: an error to some estimators, dropped by others."""
    return rows.groupBy("stratum").agg(F.count(_arm("A")).alias("n_a"), F.count(_arm("B")).alias("n_b")).where("n_a = 0 OR n_b = 0")


def overlap_effect(effects: DataFrame) -> DataFrame:
    return effects.agg(F.try_divide(F.sum("contribution"), F.sum("weight")).alias("estimate"), F.count("*").alias("strata"))


def median_of_medians(effects: DataFrame) -> DataFrame:
    return effects.agg(F.median("effect").alias("estimate"), F.count("*").alias("strata"))


def leave_one_out(effects: DataFrame) -> DataFrame:
    """The overlap-weighted effect without each stratum, from totals less the stratum."""
    totals = effects.agg(F.sum("weight").alias("__w"), F.sum("contribution").alias("__c"))
    return effects.crossJoin(F.broadcast(totals)).select("stratum", F.try_divide(F.col("__c") - F.col("contribution"), F.col("__w") - F.col("weight")).alias("estimate"))


def subject_support(rows: DataFrame) -> DataFrame:
    """Per stratum and arm: pairs, distinct subjects and the effective number of subjects (sum k)^2 / sum k^2."""
    ends = rows.select("stratum", "arm", F.explode(F.array_distinct(F.array("subject_l", "subject_r"))).alias("subject"))
    per = ends.groupBy("stratum", "arm", "subject").agg(F.count("*").alias("k"))
    sup = per.groupBy("stratum", "arm").agg(F.count("*").alias("subjects"), effective_size(F.sum("k"), F.sum(F.col("k") * F.col("k"))).alias("ess"))
    return rows.groupBy("stratum", "arm").agg(F.count("*").alias("pairs")).join(sup, ["stratum", "arm"])


def support_weights(rows: DataFrame) -> DataFrame:
    """Per stratum: the pair, subject and effective-size weights next to the effect."""
    sup = subject_support(rows)
    pick = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c))).cast("double")
    wide = sup.groupBy("stratum").agg(*(pick(a, c).alias(f"{c}_{a.lower()}") for c in ("pairs", "subjects", "ess") for a in "AB"))
    both = wide.join(stratum_effects(rows).select("stratum", "effect"), "stratum")
    return both.select("stratum", "effect", "subjects_a", "subjects_b", "ess_a", "ess_b", *(overlap_weight(F.col(f"{c}_a"), F.col(f"{c}_b")).alias(f"w_{c}") for c in ("pairs", "subjects", "ess")))


def support_estimates(weights: DataFrame) -> DataFrame:
    return weights.agg(*(F.try_divide(F.sum(F.col(w) * F.col("effect")), F.sum(w)).alias(w.replace("w_", "by_")) for w in ("w_pairs", "w_subjects", "w_ess")))


def qualified(rows: DataFrame, least: int = 2) -> DataFrame:
    """Strata with so many subjects in either arm, with their effects."""
    enough = subject_support(rows).groupBy("stratum").agg(F.min("subjects").alias("least"), F.count("*").alias("arms")).where((F.col("least") >= least) & (F.col("arms") == 2))
    return stratum_effects(rows).join(enough.select("stratum"), "stratum", "left_semi")


def pooled(rows: DataFrame) -> DataFrame:
    return rows.agg(F.median(_arm("A")).alias("median_a"), F.median(_arm("B")).alias("median_b")).withColumn("estimate", F.col("median_b") - F.col("median_a"))


def endpoints(rows: DataFrame) -> DataFrame:
    """Each pair once for each distinct subject."""
    return rows.withColumn("subject", F.explode(F.array_distinct(F.array("subject_l", "subject_r"))))


def weighted_mae(rows: DataFrame) -> DataFrame:
    """One row: the mean error by pair, endpoint subject, category relation and stratum (mean of group means)."""
    def grouped(frame: DataFrame, keys: list, name: str) -> DataFrame:
        return frame.groupBy(*keys).agg(F.avg("error").alias("m")).agg(F.avg("m").alias("value")).select(F.lit(name).alias("weighting"), "value")

    return (
        rows.agg(F.avg("error").alias("value")).select(F.lit("pair").alias("weighting"), "value")
        .unionByName(grouped(endpoints(rows), ["subject"], "endpoint_subject"))
        .unionByName(grouped(rows, relation(F.col("category_l"), F.col("category_r")), "category_relation"))
        .unionByName(grouped(rows, ["stratum"], "stratum"))
    )


def weighted_gains(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, weighting, base_mae, mae, gain): the four weightings of error and base error in every group, from sums by subject pair,
    relation and stratum."""
    from pairlens.functions.scalars import improvement

    cells = rows.groupBy(*keys, "subject_l", "subject_r", *relation(F.col("category_l"), F.col("category_r")), "stratum").agg(F.sum("base_error").alias("b"), F.sum("error").alias("e"), F.count("*").alias("n"))
    mean = (F.sum("b") / F.sum("n")).alias("b"), (F.sum("e") / F.sum("n")).alias("e")

    def grouped(frame: DataFrame, by: list[str], name: str) -> DataFrame:
        per = frame.groupBy(*keys, *by).agg(*mean)
        return per.groupBy(*keys).agg(F.avg("b").alias("b"), F.avg("e").alias("e")).withColumn("weighting", F.lit(name))

    got = cells.groupBy(*keys).agg(*mean).withColumn("weighting", F.lit("pair"))
    for frame, by, name in ((endpoints(cells), ["subject"], "endpoint_subject"), (cells, ["rel_l", "rel_r"], "category_relation"), (cells, ["stratum"], "stratum")):
        got = got.unionByName(grouped(frame, by, name))
    return got.select(*keys, "weighting", F.col("b").alias("base_mae"), F.col("e").alias("mae"), improvement(F.col("b"), F.col("e")).alias("gain"))


def relation_means(rows: DataFrame, value: str = "predicted", keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(keys, rel_l, rel_r, mean, n) over pairs of two categories; ``weight`` gives the replicate form, groups without weight left out."""
    keys = keys or []
    off = rows.where("category_l <> category_r")
    if weight:
        g = off.groupBy(*keys, *relation(F.col("category_l"), F.col("category_r"))).agg(F.sum(F.col(weight) * F.col(value)).alias("t"), F.sum(weight).alias("w")).where("w > 0")
        return g.select(*keys, "rel_l", "rel_r", (F.col("t") / F.col("w")).alias("mean"), "w")
    return off.groupBy(*keys, *relation(F.col("category_l"), F.col("category_r"))).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def group_report(rows: DataFrame, group: str = "group") -> DataFrame:
    from pairlens.functions.scalars import improvement

    g = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg("base_error").alias("base_mae"), F.avg("error").alias("mae"))
    return g.withColumn("gain", improvement(F.col("base_mae"), F.col("mae")))


def distribution(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), q.alias("q"), F.min(value).alias("least"), F.max(value).alias("most"))
    return g.select(*keys, "n", "mean", "median", (F.col("q")[1] - F.col("q")[0]).alias("iqr"), "least", "most")


def ranking_metrics(relations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, spearman, kendall, order_accuracy, reversals, tied_reference, tied_predicted) of ``reference`` and ``predicted``
    over relations (keys, relation). Kendall is tau-b; accuracy leaves reference ties out and gives predicted ties a half.
    Constant sides give null. Relations of a method are few (labels squared), so their pairs are, too."""
    keys, relations = keys or [], settled(relations)
    ranked = relations.withColumn("rx", average_rank("reference", keys)).withColumn("ry", average_rank("predicted", keys))
    rho = ranked.groupBy(*keys).agg(F.count("*").alias("n"), correlation("rx", "ry").alias("spearman"))
    a = relations.select(*keys, F.col("relation").alias("i"), F.col("reference").alias("xi"), F.col("predicted").alias("yi"))
    b = relations.select(*keys, F.col("relation").alias("j"), F.col("reference").alias("xj"), F.col("predicted").alias("yj"))
    one = F.lit(1)
    a, b = (a, b) if keys else (a.withColumn("__k", one), b.withColumn("__k", one))
    on = keys or ["__k"]
    pairs = a.join(b, on).where("i < j").withColumn("sx", F.signum(F.col("xi") - F.col("xj"))).withColumn("sy", F.signum(F.col("yi") - F.col("yj")))
    count = lambda test: F.sum(F.when(test, 1).otherwise(0))
    x, y = F.col("sx"), F.col("sy")
    s = pairs.groupBy(*on).agg(count(x * y > 0).alias("p"), count(x * y < 0).alias("q"), count((x == 0) & (y != 0)).alias("tx"), count((x != 0) & (y == 0)).alias("ty"), count(x == 0).alias("tied_reference"), count(y == 0).alias("tied_predicted"))
    p, q, tx, ty = (F.col(c).cast("double") for c in ("p", "q", "tx", "ty"))
    tau = F.try_divide(p - q, F.sqrt((p + q + tx) * (p + q + ty)))
    out = s.select(*on, tau.alias("kendall"), F.try_divide(p + ty / 2, p + q + ty).alias("order_accuracy"), F.col("q").alias("reversals"), "tied_reference", "tied_predicted")
    if not keys:
        return rho.withColumn("__k", one).join(out, "__k").drop("__k")
    return rho.join(out, keys)


def order_reversals(relations: DataFrame) -> DataFrame:
    """Relation pairs that ``baseline`` and ``predicted`` order oppositely; any tie is skipped. One row."""
    relations = settled(relations)
    a = relations.select(F.lit(1).alias("k"), F.col("relation").alias("i"), F.col("baseline").alias("xi"), F.col("predicted").alias("yi"))
    b = relations.select(F.lit(1).alias("k"), F.col("relation").alias("j"), F.col("baseline").alias("xj"), F.col("predicted").alias("yj"))
    m = (F.col("xi") - F.col("xj")) * (F.col("yi") - F.col("yj"))
    return a.join(b, "k").where("i < j").agg(F.coalesce(F.sum(F.when(m < 0, 1).otherwise(0)), F.lit(0)).alias("reversals"), F.coalesce(F.sum(F.when(m != 0, 1).otherwise(0)), F.lit(0)).alias("compared"))


def did(cells: DataFrame) -> DataFrame:
    """Per pair_id the interaction (m1 - m0) - (l1 - l0) of errors by head (linear, mlp) and strength (off, on): a pivot, not four joins."""
    cell = lambda h, s: F.max(F.when((F.col("head") == h) & (F.col("strength") == s), F.col("error")))
    g = cells.groupBy("pair_id").agg(cell("linear", "off").alias("l0"), cell("linear", "on").alias("l1"), cell("mlp", "off").alias("m0"), cell("mlp", "on").alias("m1"))
    return g.where("l0 IS NOT NULL AND l1 IS NOT NULL AND m0 IS NOT NULL AND m1 IS NOT NULL").withColumn("interaction", (F.col("m1") - F.col("m0")) - (F.col("l1") - F.col("l0")))
