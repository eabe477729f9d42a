"""Gates: one row of named booleans and whether all hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(evidence: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row of evidence -> one boolean per check (unknown is false), and ``passed``."""
    flags = {n: F.coalesce(c, F.lit(False)) for n, c in checks.items()}
    return evidence.select(*(c.alias(n) for n, c in flags.items()), reduce(lambda a, b: a & b, flags.values()).alias("passed"))


def report(frame: DataFrame, schema: str) -> DataFrame:
    """The rows as one JSON document each, tagged with a schema."""
    return frame.select(F.to_json(F.struct(F.lit(schema).alias("schema"), F.struct(*frame.columns).alias("checks"))).alias("json"))


def mechanism(evidence: DataFrame, flags: list[str]) -> DataFrame:
    """unique, multiple or unresolved: how many of the explanations hold."""
    n = reduce(lambda a, b: a + b, (F.when(F.coalesce(F.col(f), F.lit(False)), 1).otherwise(0) for f in flags))
    name = F.concat_ws(",", *(F.when(F.col(f), F.lit(f)) for f in flags))
    return evidence.select(F.when(n == 1, "unique").when(n > 1, "multiple").otherwise("unresolved").alias("status"), name.alias("mechanisms"))


def consolidated(gates: DataFrame) -> DataFrame:
    """gates(name, passed) -> (gates, failed, passed)."""
    return gates.agg(F.count("*").alias("gates"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name")))).alias("failed"), F.bool_and("passed").alias("passed"))


#: The four error weightings and the three ordering metrics that gates ask for.
WEIGHTINGS = ("pair", "endpoint_subject", "category_relation", "stratum")
ORDERING = ("spearman", "kendall", "order_accuracy")


def _all(test: Column) -> Column:
    """Whether a test holds in every row of a group; unknown rows and empty groups fail."""
    return F.coalesce(F.bool_and(F.coalesce(test, F.lit(False))), F.lit(False))


def dependency(audit: DataFrame, within: DataFrame, models: DataFrame, shared: int | None = None) -> DataFrame:
    """Whether effects survive that arms share items. audit: ``audits.cross_arm``; within(arm, reused); models(model, estimate, lower).
    A design whose items do not nest or recur inside an arm is invalid, and fails whatever the effects are."""
    reuse = within.agg(F.coalesce(F.sum("reused"), F.lit(0)).alias("reused"))
    seen = models.agg(_all(F.col("estimate") > 0).alias("direction"), _all(F.col("lower") > 0).alias("positive"))
    nested = (F.col("not_nested_subject") == 0) & (F.col("not_nested_category") == 0)
    declared = F.lit(True) if shared is None else F.col("shared") == shared
    valid = nested & (F.col("reused") == 0)
    return audit.crossJoin(reuse).crossJoin(seen).select(
        F.coalesce(nested, F.lit(False)).alias("nested"),
        (F.col("reused") == 0).alias("no_reuse_within_arm"),
        F.coalesce(declared, F.lit(False)).alias("shared_as_declared"),
        F.col("direction").alias("direction_preserved"),
        F.col("positive").alias("lower_bounds_positive"),
        F.coalesce(valid & F.col("direction"), F.lit(False)).alias("passed"),
    )


def manifest(groups: DataFrame, expected: DataFrame, shared: DataFrame, clashes: DataFrame) -> DataFrame:
    """Whether a pair manifest is the declared one. groups(group, pairs, reused), expected(group, pairs), shared: ``audits.leakage`` with
    the calibration pairs, clashes: ``audits.collisions`` with another manifest."""
    both = groups.select("group", "pairs", "reused").join(expected.select("group", F.col("pairs").alias("declared")), "group", "full_outer")
    counts = both.agg(_all(F.col("pairs") == F.col("declared")).alias("counts_as_declared"), (F.coalesce(F.sum("reused"), F.lit(0)) == 0).alias("no_reuse_within_group"))
    apart = shared.agg((F.coalesce(F.sum(F.when(F.col("kind") == "subject", F.col("shared"))), F.lit(0)) == 0).alias("subjects_disjoint"))
    unique = clashes.agg((F.count("*") == 0).alias("ids_unique"))
    names = ("counts_as_declared", "no_reuse_within_group", "subjects_disjoint", "ids_unique")
    return gate(counts.crossJoin(apart).crossJoin(unique), {n: F.col(n) for n in names})


def weighting(intervals: DataFrame, references: int) -> DataFrame:
    """intervals(reference, weighting, lower), one row for each of the four weightings of every reference: passed if all lower bounds are
    positive, narrowed if some are not, incomplete if a row is missing, repeated or undefined."""
    g = intervals.where(F.col("weighting").isin(*WEIGHTINGS)).agg(F.count("*").alias("n"), F.count_distinct("reference", "weighting").alias("k"), F.count("lower").alias("known"), _all(F.col("lower") > 0).alias("positive"))
    complete = (F.col("n") == references * len(WEIGHTINGS)) & (F.col("k") == F.col("n")) & (F.col("known") == F.col("n"))
    status = F.when(~complete, "incomplete").when(F.col("positive"), "passed").otherwise("narrowed")
    return g.select(complete.alias("all_rows_complete"), F.col("positive").alias("lower_bounds_positive"), status.alias("status"))


def practical(contrasts: DataFrame) -> DataFrame:
    """contrasts(reference, metric, lower, upper), as of ``resample.ranking_contrasts``: per reference whether better ordering and a lower error
    of the other method are supported by intervals."""
    m = F.col("metric")
    ordering, error = m.isin(*ORDERING), m == "mae"
    complete = F.count_distinct(F.when(ordering, m)) == len(ORDERING)
    better = _all(~ordering | (F.col("lower") > 0)) & complete
    lower = F.coalesce(F.bool_or(error & (F.col("upper") < 0)), F.lit(False))
    return contrasts.groupBy("reference").agg(better.alias("better_ordering"), lower.alias("lower_error_of_other"))


def ordering(support: DataFrame) -> DataFrame:
    """The status over the rows of ``practical``."""
    g = support.agg(_all(F.col("better_ordering")).alias("better_ordering_allowed"), _all(F.col("lower_error_of_other")).alias("lower_error_of_other"))
    return g.withColumn("status", F.when(F.col("better_ordering_allowed"), "passed").otherwise("narrowed"))


def variants(gains: DataFrame, seeds: int = 4) -> DataFrame:
    """gains(variant, seed, weighting, gain) -> per variant of the reference: positive medians over seeds, enough seeds with a positive pair
    gain, whether the stratum weighting exists, and ``stable``: all but the last."""
    med = lambda w: F.median(F.when(F.col("weighting") == w, F.col("gain")))
    positive = F.sum(F.when((F.col("weighting") == "pair") & (F.col("gain") > 0), 1).otherwise(0))
    checks = {"pair_median_positive": med("pair") > 0, "enough_pair_seeds_positive": positive >= seeds, "subject_median_positive": med("endpoint_subject") > 0, "relation_median_positive": med("category_relation") > 0}
    flags = {n: F.coalesce(c, F.lit(False)) for n, c in checks.items()}
    available = F.count(F.when(F.col("weighting") == "stratum", F.col("gain"))) > 0
    return gains.groupBy("variant").agg(*(c.alias(n) for n, c in flags.items()), available.alias("stratum_available"), reduce(lambda a, b: a & b, flags.values()).alias("stable"))


def stability(checked: DataFrame) -> DataFrame:
    """The status over the rows of ``variants``: reference_stable, or construction_specific."""
    return checked.agg(F.count("*").alias("variants"), _all(F.col("stable")).alias("passed")).withColumn("status", F.when(F.col("passed"), "reference_stable").otherwise("construction_specific"))


def boundary(results: DataFrame, gains: list[str], controls: list[str]) -> DataFrame:
    """Adds to results(reference, gain, controls, gains, increment, linear_increment): whether the gain is above every control, which head
    gains most (the first of equals), and whether the increment of the cross loss holds with either head."""
    most = F.greatest(*gains)
    best = F.coalesce(*(F.when(F.col(g) == most, F.lit(g)) for g in gains))
    above = F.col("gain") > (F.greatest(*controls) if len(controls) > 1 else F.col(controls[0]))
    return results.withColumn("specific", F.coalesce(above, F.lit(False))).withColumn("strongest", best).withColumn("robust", F.coalesce(F.col("increment") & F.col("linear_increment"), F.lit(False)))


def references(results: DataFrame, least: float = 0.05, expected: str = "linear_alone") -> DataFrame:
    """One row over the references of ``boundary`` (with lower and seeds_passed): efficacy, specificity, robustness, one strongest head."""
    efficacy = (F.col("gain") >= least) & (F.col("lower") > 0) & F.col("seeds_passed")
    return results.agg(_all(efficacy).alias("efficacy"), _all(F.col("specific")).alias("specificity"), _all(F.col("robust")).alias("architecture_robust"), _all(F.col("strongest") == expected).alias("linear_alone_strongest"))


def prevalence(conditions: DataFrame) -> DataFrame:
    """conditions(condition, slope_lower, mean_lower, seeds_positive) -> its three checks, and whether the association with prevalence holds."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    slope, mean, seeds = flag(F.col("slope_lower") > 0), flag(F.col("mean_lower") > 0), flag(F.col("seeds_positive"))
    return conditions.select("condition", slope.alias("sensitivity_reduced"), mean.alias("mean_gain_improved"), seeds.alias("seeds_positive"), (slope & seeds).alias("associated"))


def transfer(checked: DataFrame) -> DataFrame:
    """One row: the balancing rule transfers if every check of every condition of ``prevalence`` holds."""
    return checked.agg(F.count("*").alias("conditions"), _all(F.col("sensitivity_reduced") & F.col("mean_gain_improved") & F.col("seeds_positive")).alias("transfer_supported"))


def diversity(conditions: DataFrame, base: str, broad: str, lower: Column, same_direction: Column, seeds: int = 4) -> DataFrame:
    """conditions(condition, pairs, relations): pools of one size, the broad one with more category relations, a positive lower bound of the paired
    contrast, and enough seeds in its direction (the last two as aggregates over the rows)."""
    of = lambda c, name: F.max(F.when(F.col("condition") == name, F.col(c)))
    g = conditions.agg((F.min("pairs") == F.max("pairs")).alias("a"), (of("relations", broad) > of("relations", base)).alias("b"), (lower > 0).alias("c"), (same_direction >= seeds).alias("d"))
    return gate(g, {"equal_pairs": F.col("a"), "more_relations": F.col("b"), "lower_bound_positive": F.col("c"), "enough_seeds": F.col("d")})


def correction(report: DataFrame, threshold: float = 0.05, tolerance: float = 0.02, controls: tuple[str, ...] = ("shuffled", "wrong", "bias_swap"), swapped: str | None = None, rival: str | None = None) -> DataFrame:
    """report(gain, lower, harm, harm_upper, controls...): a correction passes if it gains enough with a positive lower bound, does not harm
    matched pairs, and no control gains as much; ``swapped`` must gain less than half as much, ``rival`` less than it."""
    checks = {"gains_enough": F.col("gain") >= threshold, "lower_bound_positive": F.col("lower") > 0, "harmless": (F.col("harm") <= tolerance) & (F.col("harm_upper") <= tolerance)}
    checks |= {f"{c}_gains_less": F.col(c) < threshold for c in controls}
    if swapped:
        checks["swap_gains_less"] = F.col(swapped) < F.greatest(F.col("gain") * 0.5, F.lit(0.0))
    if rival:
        checks["beats_rival"] = F.col(rival).isNull() | (F.col("gain") > F.col(rival))
    return gate(report, checks)
