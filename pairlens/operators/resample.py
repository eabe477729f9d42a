"""Bootstraps as tables of replicate weights.

``draws`` holds how often each unit was drawn in each replicate; units join their pairs, a pair's weight is the product of its
endpoints' draws, and one aggregation by replicate gives all estimates. Sums that need no single pair are made by subject pair before any
replicate, and medians of pairs from vectors of all replicates (``replicates``). Draws are functions of (seed, group, replicate, k) and need no
state; every group (stratum, arm, category, q) has a seed of its own, so that groups draw apart, and so has every draw of a cluster inside a cluster.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.functions.scalars import draw, group_seed, improvement, multiplicity, overlap_weight, sign
from pairlens.operators import replicates as vectors
from pairlens.plans.scan import Run, scan
from pairlens.plans.storage import numbered

SEED, LEAST_PERMUTATIONS = 20260829, 1000


def draws(units: DataFrame, unit: str, replicates: int, seed: int = SEED, within: list[str] | None = None) -> DataFrame:
    """(replicate, within, unit, m): multiplicities of n draws from the n units (of each group of ``within``)."""
    within = within or []
    distinct = units.select(*within, unit).distinct()
    indexed = _indexed(distinct, "idx", within, unit)
    sizes = indexed.groupBy(*within).agg(F.count("*").alias("n")).withColumn("__s", group_seed(seed, *within) if within else F.lit(seed))
    grid = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    drawn = grid.withColumn("idx", draw(F.col("__s"), F.col("replicate"), F.col("k"), F.col("n")).cast("long")).groupBy("replicate", *within, "idx").agg(F.count("*").alias("m"))
    # The planner takes exploded rows for as few as they came from, and would send them to all.
    return drawn.hint("merge").join(indexed, [*within, "idx"]).select("replicate", *within, unit, "m")


def redrawn(frame: DataFrame, n: str, k: str, idx: str, seed: int, *place: str) -> DataFrame:
    """Each row ``n`` times, with the number ``k`` of the draw and the unit ``idx`` drawn, both from 0; ``place`` names the cluster's own draw, so that a cluster drawn twice is resampled apart."""
    each = frame.withColumn("__s", group_seed(seed, *place) if place else F.lit(seed)).withColumn(k, F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))))
    return each.withColumn(idx, draw(F.col("__s"), F.col("replicate"), F.col(k), F.col(n)).cast("long")).drop("__s")


def _indexed(frame: DataFrame, idx: str, keys: list[str], *order: str) -> DataFrame:
    """Rows numbered from 0 in each group; a group may spread over tasks."""
    return scan(frame, keys, list(order), {idx: Run("count")}).withColumn(idx, F.col(idx) - 1)


def _replicated(frame: DataFrame, replicates: int) -> DataFrame:
    return frame.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))


def pair_weights(rows: DataFrame, drawn: DataFrame, unit: str = "subject", on: list[str] | None = None) -> DataFrame:
    """``rows`` for each replicate with ``m``; pairs of an endpoint that was not drawn drop out of the join."""
    on = on or []
    side = lambda s: drawn.select("replicate", *on, F.col(unit).alias(f"{unit}_{s}"), F.col("m").alias(f"m_{s}"))
    both = rows.join(side("l"), [*on, f"{unit}_l"]).join(side("r"), ["replicate", *on, f"{unit}_r"])
    return both.withColumn("m", multiplicity(F.col("m_l"), F.col("m_r"), F.col(f"{unit}_l") == F.col(f"{unit}_r"))).drop("m_l", "m_r")


def _arms(medians: DataFrame) -> DataFrame:
    """(replicate, stratum, median_a, median_b) of medians by arm; strata that lost an arm are left out."""
    pick = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("median")))
    return medians.groupBy("replicate", "stratum").agg(pick("A").alias("median_a"), pick("B").alias("median_b")).where("median_a IS NOT NULL AND median_b IS NOT NULL")


def dyadic_weights(rows: DataFrame, drawn: DataFrame, replicates: int, unit: str = "subject", on: list[str] | None = None) -> DataFrame:
    """``rows`` cut by (stratum, arm, distance), each with its ends' draws in all replicates."""
    ends = [f"{unit}_l", f"{unit}_r"]
    narrow = rows.select("stratum", "arm", "distance", *dict.fromkeys([*ends, "subject_l", "subject_r"]))
    return vectors.weighed(vectors.cut(narrow, ["stratum", "arm"], "distance", *ends), drawn, unit, on or [], replicates)


def global_dyadic(rows: DataFrame, replicates: int, seed: int = SEED, unit: str = "subject") -> DataFrame:
    """(replicate, estimate, strata): one draw of subjects shared by all arms and strata; observed overlap weights, renormalised over
    the strata that kept both arms."""
    fixed = rows.groupBy("stratum").agg(F.count(F.when(F.col("arm") == "A", 1)).alias("a"), F.count(F.when(F.col("arm") == "B", 1)).alias("b")).where("a > 0 AND b > 0").select("stratum", overlap_weight(F.col("a"), F.col("b")).alias("w"))
    ends = rows.select(F.explode(F.array(f"{unit}_l", f"{unit}_r")).alias(unit)).distinct()
    weighed = dyadic_weights(rows, vectors.drawn_vectors(numbered(ends, "idx", unit), unit, replicates, seed), replicates, unit)
    got = _arms(vectors.medians(weighed, ["stratum", "arm"], "distance")).join(fixed, "stratum")
    return got.groupBy("replicate").agg((F.sum(F.col("w") * (F.col("median_b") - F.col("median_a"))) / F.sum("w")).alias("estimate"), F.count("*").alias("strata"))


def stratum_dyadic(rows: DataFrame, replicates: int, seed: int = SEED) -> DataFrame:
    """(replicate, estimate, strata): subjects drawn in each stratum, the median of stratum effects. A stratum of up to TOGETHER rows is drawn where it lies."""
    small, large = _apart(rows.select("stratum", "arm", "subject_l", "subject_r", "distance"), ["stratum"])

    def effects(pdf: pd.DataFrame) -> pd.DataFrame:
        subjects, ends = np.unique(pdf[["subject_l", "subject_r"]].to_numpy().ravel(), return_inverse=True)
        ends, n = ends.reshape(-1, 2), len(subjects)
        own, at = vectors.own_seed(seed, pdf["stratum"].iloc[0]), np.arange(n, dtype=np.int64)
        arms = [a.index.to_numpy() for a in (pdf.reset_index(drop=True).sort_values("distance").loc[lambda x, a=a: x["arm"] == a] for a in "AB")]
        values, out = pdf["distance"].to_numpy(float), []
        if not all(map(len, arms)):
            return pd.DataFrame({"replicate": [], "e": []})
        for r in np.array_split(np.arange(replicates), -(-replicates * max(len(pdf), n) // _AT_ONCE)):
            idx = vectors.drawn(own, r[:, None], at[None, :], n)
            m = np.bincount((np.arange(len(r))[:, None] * n + idx).ravel(), minlength=len(r) * n).reshape(len(r), n)
            med = []
            for rows_ in arms:
                left, right = ends[rows_].T
                upto = np.cumsum(np.where(left == right, m[:, left], m[:, left] * m[:, right]), axis=1)
                med.append(np.where(upto[:, -1] > 0, values[rows_][(2 * upto >= upto[:, -1:]).argmax(1)], np.nan))
            out.append(pd.DataFrame({"replicate": r, "e": med[1] - med[0]}).dropna())
        return pd.concat(out)

    got = small.groupBy("stratum").applyInPandas(effects, "replicate int, e double")
    if large is not None:
        ends = large.select("stratum", F.explode(F.array("subject_l", "subject_r")).alias("subject"))
        weighed = dyadic_weights(large, draws(ends, "subject", replicates, seed, ["stratum"]), replicates, "subject", ["stratum"])
        got = got.unionByName(_arms(vectors.medians(weighed, ["stratum", "arm"], "distance")).select("replicate", (F.col("median_b") - F.col("median_a")).alias("e")))
    return got.groupBy("replicate").agg(F.median("e").alias("estimate"), F.count("*").alias("strata"))


def arm_items(rows: DataFrame, replicates: int, seed: int = SEED, independent: bool = False) -> DataFrame:
    """The global form with items as units; ``independent``: the arms draw alone (the arm is part of the item's name)."""
    named = rows
    if independent:
        tag = lambda c: F.concat_ws("#", "arm", c)
        named = rows.withColumn("item_l", tag("item_l")).withColumn("item_r", tag("item_r"))
    return global_dyadic(named, replicates, seed, "item")


def _clusters(each: DataFrame, outer: list[str], unit: str, inner: list[str], *order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows(outer, unit, inner, ...): (outer, S) how many units a group has; (outer, unit index s); rows numbered ``i`` in (outer, unit, inner)."""
    units = _indexed(each.select(*outer, unit).distinct(), "s", outer, unit)
    sizes = units.groupBy(*outer).agg(F.count("*").alias("S"))
    return sizes, units, _indexed(each, "i", [*outer, unit, *inner], *order)


#: Rows of a cluster that are drawn from where they lie together; larger ones are drawn as rows that are joined.
TOGETHER = 200_000
#: Drawn rows that a task holds at once.
_AT_ONCE = 1_000_000
#: Replicates of a cluster that a task makes at once.
_TURN = 100


def _apart(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups that a task can hold, and those of larger groups, if there are any."""
    from pairlens.plans.storage import settled

    rows = settled(rows)
    large = settled(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER).select(*keys))
    return (rows, None) if large.isEmpty() else (rows.join(large, keys, "left_anti"), rows.join(large, keys, "left_semi"))


def _redrawn(pdf: pd.DataFrame, seed: int, keys: tuple, replicates: int):
    """For some replicates at a time of rows(subject, ...) sorted by subject: the replicates, how many rows each drawn subject has, and the places of the rows drawn of it; subjects are drawn by the
    seed of ``keys``, rows by the next seed of ``keys`` and of the draw."""
    _, starts, sizes = np.unique(pdf["subject"].to_numpy(), return_index=True, return_counts=True)
    n, outer = len(sizes), vectors.own_seed(seed, *keys)
    inner = np.array([vectors.own_seed(seed + 1, *keys, j) for j in range(n)], np.int64)
    for r in np.array_split(np.arange(replicates), min(replicates, -(-replicates * len(pdf) // _AT_ONCE))):
        s = vectors.drawn(outer, r[:, None], np.arange(n)[None, :], n).ravel()
        many = sizes[s]
        owner, before = np.repeat(np.arange(len(s)), many), np.cumsum(many) - many
        k = np.arange(len(owner)) - before[owner]
        yield r, before, owner // n, vectors.drawn(inner[owner % n], r[owner // n], k, many[owner]) + starts[s][owner]


def _ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each pair once for each distinct subject, in order."""
    other = pdf[pdf["subject_l"] != pdf["subject_r"]]
    both = pd.concat([pdf.assign(subject=pdf["subject_l"]), other.assign(subject=other["subject_r"])])
    return both.sort_values(["subject", "item_l", "item_r"]).reset_index(drop=True)


def drawn_means(instances: DataFrame, rows: DataFrame, keys: list[str], place: list[str], value: str, seed: int) -> DataFrame:
    """(replicate, place, keys, mean): for every drawn instance(replicate, place, keys) of a cluster the mean of as many of its rows(keys, i, value) as it has, drawn with replacement; ``place`` names the
    instance's own draw. No row is made for a drawn row of a cluster of up to TOGETHER rows: its values and the instances of some replicates meet as two lists."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    lists = rows.join(sizes.where(F.col("n") <= TOGETHER), keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", F.col(value).cast("double").alias("v")))).alias("vs")).withColumn("vs", F.transform("vs", lambda v: v["v"]))
    names = list(dict.fromkeys(["replicate", *place]))
    asked = instances.withColumn("__s", group_seed(seed, *place)).withColumn("__t", F.floor(F.col("replicate") / _TURN))
    asked = asked.groupBy(*keys, "__t").agg(F.collect_list(F.struct("__s", *(F.col(c).alias(f"p_{c}") for c in names))).alias("asked"))
    met = asked.hint("merge").join(lists, keys).select(*keys, F.col("asked"), F.transform("asked", lambda a: a["__s"]).alias("seeds"), F.transform("asked", lambda a: a["p_replicate"]).alias("replicates"), "vs")

    def means(seeds: pd.Series, reps: pd.Series, vs: pd.Series) -> pd.Series:
        out, p = [], 2147483647  # the rule of ``draw``
        for ss, rs, v in zip(seeds, reps, vs, strict=True):
            k = np.arange(len(v), dtype=np.int64) * 7919
            x = ((s + r * 1000003 + k) % p for s, r in zip(ss.astype(np.int64), rs.astype(np.int64), strict=True))
            out.append([float(v[((y * y % p) * 48271 + y) % p % len(v)].mean()) for y in x])
        return pd.Series(out)

    draw_means = F.pandas_udf(means, "array<double>")
    got = met.withColumn("means", draw_means("seeds", "replicates", "vs"))
    small = got.select(*keys, F.explode(F.arrays_zip("asked", "means")).alias("e")).select(*(F.col(f"e.asked.p_{c}").alias(c) for c in names), *(k for k in keys if k not in names), F.col("e.means").alias("mean"))
    large = redrawn(instances.hint("merge").join(sizes.where(F.col("n") > TOGETHER), keys), "n", "k", "i", seed, *place).hint("merge").join(rows.select(*keys, "i", value), [*keys, "i"])
    return small.unionByName(large.groupBy(*names, *(k for k in keys if k not in names)).agg(F.avg(value).alias("mean")))


def nested_cluster(rows: DataFrame, replicates: int, seed: int = SEED) -> DataFrame:
    """(replicate, estimate): in each stratum and arm subjects are drawn, then rows of each drawn subject; the median of the drawn rows, then of stratum effects. A stratum of up to TOGETHER rows is
    drawn where it lies, larger ones as rows that are joined."""
    from pairlens.operators.estimators import endpoints

    group = ["stratum", "arm"]
    small, large = _apart(rows.select(*group, "item_l", "item_r", "subject_l", "subject_r", "distance"), ["stratum"])

    def medians(pdf: pd.DataFrame, keys: tuple) -> np.ndarray:
        pdf, out = _ends(pdf), []
        values = pdf["distance"].to_numpy(float)
        order = np.argsort(values, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        known = int((~np.isnan(values)).sum())
        for r, _, owner, at in _redrawn(pdf, seed, keys, replicates):
            # How often each value is drawn, in order: the median is where half of them is reached.
            times = np.bincount(owner * len(pdf) + rank[at], minlength=len(r) * len(pdf)).reshape(len(r), -1)[:, :known]
            upto = np.cumsum(times, axis=1) if known else np.zeros((len(r), 1), np.int64)
            total = upto[:, -1]
            pick = lambda k: values[order][(upto > k[:, None]).argmax(1)]  # noqa: B023, E731
            out.append(np.where(total > 0, (pick((total - 1) // 2) + pick(total // 2)) / 2, np.nan))
        return np.concatenate(out)

    def effects(pdf: pd.DataFrame) -> pd.DataFrame:
        arms = [pdf[pdf["arm"] == a] for a in "AB"]
        if not all(map(len, arms)):
            return pd.DataFrame({"replicate": [], "e": []})
        a, b = (medians(g, (pdf["stratum"].iloc[0], x)) for g, x in zip(arms, "AB", strict=True))
        return pd.DataFrame({"replicate": np.arange(replicates), "e": b - a}).dropna()

    got = small.groupBy("stratum").applyInPandas(effects, "replicate int, e double")
    if large is not None:
        sizes, units, each = _clusters(endpoints(large), group, "subject", [], "item_l", "item_r")
        outer = redrawn(_replicated(sizes, replicates), "S", "j", "s", seed, *group).hint("merge").join(units, [*group, "s"])
        counts = each.groupBy(*group, "subject").agg(F.count("*").alias("n"))
        inner = redrawn(outer.hint("merge").join(counts, [*group, "subject"]), "n", "k", "i", seed + 1, *group, "j")
        seen = inner.hint("merge").join(each.select(*group, "subject", "i", "distance"), [*group, "subject", "i"])
        med = seen.groupBy("replicate", *group).agg(F.median("distance").alias("median"))
        got = got.unionByName(_arms(med).select("replicate", (F.col("median_b") - F.col("median_a")).alias("e")))
    return got.groupBy("replicate").agg(F.median("e").alias("estimate"))


def stratified_mean(rows: DataFrame, replicates: int, seed: int = SEED) -> DataFrame:
    """(replicate, estimate): categories drawn, then rows of both arms in each drawn one; the mean of their mean differences. Categories without both arms are left out."""
    both = rows.groupBy("category").agg(F.count_distinct("arm").alias("arms")).where("arms = 2").select("category")
    used = rows.join(both, "category", "left_semi")
    cats = _indexed(both, "c", [], "category")
    size = cats.agg(F.count("*").alias("C"))
    each = _indexed(used, "i", ["category", "arm"], "item_l", "item_r")
    outer = redrawn(_replicated(size, replicates), "C", "j", "c", seed).join(cats, "c").withColumn("arm", F.explode(F.array(F.lit("A"), F.lit("B"))))
    seen = drawn_means(outer.select("replicate", "j", "category", "arm"), each, ["category", "arm"], ["j", "arm"], "distance", seed + 1)
    mean = lambda a: F.max(F.when(F.col("arm") == a, F.col("mean")))
    return seen.groupBy("replicate", "j").agg((mean("B") - mean("A")).alias("e")).groupBy("replicate").agg(F.avg("e").alias("estimate"))


def hierarchical(rows: DataFrame, replicates: int, seed: int = SEED) -> DataFrame:
    """(replicate, estimate): categories, subjects in each drawn one, and rows of both arms of each drawn subject, all with replacement; the mean over drawn subjects of mean between
    less mean within. A between pair belongs to both its subjects; subjects without both arms are left out."""
    from pairlens.operators.estimators import endpoints

    ends = endpoints(rows)
    both = ends.groupBy("category", "subject").agg(F.count_distinct("arm").alias("arms")).where("arms = 2").select("category", "subject")
    sizes, units, each = _clusters(ends.join(both, ["category", "subject"], "left_semi"), ["category"], "subject", ["arm"], "item_l", "item_r")
    cats = _indexed(sizes, "c", [], "category")
    size = cats.agg(F.count("*").alias("C"))
    outer = redrawn(_replicated(size, replicates), "C", "a", "c", seed).join(cats, "c")
    middle = redrawn(outer, "S", "b", "s", seed + 1, "a").join(units, ["category", "s"]).withColumn("arm", F.explode(F.array(F.lit("A"), F.lit("B"))))
    seen = drawn_means(middle.select("replicate", "a", "b", "category", "subject", "arm"), each, ["category", "subject", "arm"], ["a", "b", "arm"], "distance", seed + 2)
    mean = lambda a: F.max(F.when(F.col("arm") == a, F.col("mean")))
    return seen.groupBy("replicate", "a", "b").agg((mean("B") - mean("A")).alias("e")).groupBy("replicate").agg(F.avg("e").alias("estimate"))


def support_bootstrap(rows: DataFrame, replicates: int, seed: int = SEED) -> DataFrame:
    """(replicate, by_pairs, by_subjects, by_ess): support weights recomputed on the rows each draw leaves. The reported value is the replicates' median."""
    from pairlens.functions.scalars import effective_size
    from pairlens.operators.estimators import endpoints

    group = ["stratum", "arm"]
    w = dyadic_weights(rows, draws(rows.select(F.explode(F.array("subject_l", "subject_r")).alias("subject")), "subject", replicates, seed), replicates)
    pairs = vectors.summed(w, group, {"pairs": vectors.products})
    met = vectors.summed(endpoints(w).select(*group, "subject", "ms_l", "ms_r", "one"), [*group, "subject"], {"k": vectors.products})
    k = lambda pdf: vectors.matrix(pdf["k"])
    met = vectors.summed(met, group, {"subjects": lambda p: (k(p) > 0).astype("<i8"), "total": k, "squares": lambda p: k(p) ** 2})
    sup = vectors.unpacked(pairs.join(met, group), group, ["pairs", "subjects", "total", "squares"]).where("pairs > 0")
    sup = sup.withColumn("ess", effective_size(F.col("total").cast("double"), F.col("squares")))
    pick = lambda a, c: F.max(F.when(F.col("arm") == a, F.col(c).cast("double")))
    wide = sup.groupBy("replicate", "stratum").agg(*(pick(a, c).alias(f"{c}_{a}") for a in "AB" for c in ("pairs", "subjects", "ess")))
    got = wide.join(_arms(vectors.medians(w, group, "distance")), ["replicate", "stratum"])
    est = lambda c: F.sum(overlap_weight(F.col(f"{c}_A"), F.col(f"{c}_B")) * (F.col("median_b") - F.col("median_a"))) / F.sum(overlap_weight(F.col(f"{c}_A"), F.col(f"{c}_B")))
    return got.groupBy("replicate").agg(*(est(c).alias(f"by_{c}") for c in ("pairs", "subjects", "ess")))


def weighted_gains(rows: DataFrame, replicates: int, seed: int = SEED) -> DataFrame:
    """(replicate, weighting, gain): the four mean-error gains (base - method)/base under one draw of subjects. ``rows`` have error and
    base_error; a group without weight is left out; subjects are weighted by their draws."""
    from pairlens.operators.estimators import endpoints
    from pairlens.plans.storage import settled

    drawn = settled(draws(rows.select(F.explode(F.array("subject_l", "subject_r")).alias("subject")), "subject", replicates, seed))
    # Sums by subject pair, relation and stratum, before any replicate. A pair's weight is the same either way round.
    ends = [F.least("subject_l", "subject_r").alias("subject_l"), F.greatest("subject_l", "subject_r").alias("subject_r")]
    named = rows.select(*ends, "stratum", F.least("category_l", "category_r").alias("rel_l"), F.greatest("category_l", "category_r").alias("rel_r"), "base_error", "error")
    cells = settled(named.groupBy("subject_l", "subject_r", "rel_l", "rel_r", "stratum").agg(F.sum("base_error").alias("b"), F.sum("error").alias("e"), F.count("*").alias("n")))
    packed = vectors.vectors(drawn, ["subject"], replicates)
    times = lambda c: lambda pdf: vectors.products(pdf) * pdf[c].to_numpy(float)[:, None]
    sums = {c: times(c) for c in "ben"}

    def weighed(frame: DataFrame, *keys: str) -> DataFrame:
        """Sums by keys in all replicates: cells are added up by keys and subject pair first, and lie by keys, so that a task adds up few keys."""
        few = frame.groupBy(*keys, "subject_l", "subject_r").agg(*(F.sum(c).alias(c) for c in "ben"))
        near = few.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else few.withColumn("all", F.lit(1))
        return vectors.summed(vectors.weighed(near, packed, "subject", [], replicates), list(keys) or ["all"], sums, "<f8")

    held = lambda pdf, c: vectors.matrix(pdf[c], "<f8")
    over = lambda c: lambda pdf: np.divide(held(pdf, c), held(pdf, "n"), out=np.zeros_like(held(pdf, c)), where=held(pdf, "n") > 0)
    alive = lambda pdf: (held(pdf, "n") > 0).astype(float)
    one = lambda f, name: f.withColumn("weighting", F.lit(name))
    got = one(weighed(cells).drop("all"), "pair").select("weighting", "b", "e", "n")
    for keys, name in ((["rel_l", "rel_r"], "category_relation"), (["stratum"], "stratum")):
        got = got.unionByName(vectors.summed(one(weighed(cells, *keys), name), ["weighting"], {"b": over("b"), "e": over("e"), "n": alive}, "<f8"))
    # Subjects count as often as they were drawn.
    by = weighed(endpoints(cells), "subject").join(packed, "subject")
    own = lambda f: lambda pdf: f(pdf) * vectors.matrix(pdf["ms"], "<i4")
    got = got.unionByName(vectors.summed(one(by, "endpoint_subject"), ["weighting"], {"b": own(over("b")), "e": own(over("e")), "n": own(alive)}, "<f8"))
    per = vectors.unpacked(got, ["weighting"], ["b", "e", "n"], "<f8").where("n > 0")
    return per.select("replicate", "weighting", improvement(F.col("b") / F.col("n"), F.col("e") / F.col("n"), "none").alias("gain"))


def ranking(rows: DataFrame, references: DataFrame, replicates: int, seed: int = SEED) -> DataFrame:
    """(reference, method, replicate, mae, spearman, kendall, order_accuracy): one draw of subjects shared by all methods and references;
    replicate -1 is the observed one. rows(method, subject_l, subject_r, category_l, category_r, predicted); references(reference, rel_l,
    rel_r, value), every relation of labels with itself and others. Sums by subject pair and relation are made before any replicate."""
    from pairlens.functions.scalars import relation
    from pairlens.operators.estimators import ranking_metrics
    from pairlens.plans.storage import settled

    named = rows.select("method", "subject_l", "subject_r", *relation(F.col("category_l"), F.col("category_r")), "predicted").join(references, ["rel_l", "rel_r"])
    cells = named.groupBy("reference", "method", "subject_l", "subject_r", "rel_l", "rel_r").agg(F.max("value").alias("value"), F.sum("predicted").alias("p"), F.sum(F.abs(F.col("predicted") - F.col("value"))).alias("e"), F.count("*").alias("n"))
    cells, group = settled(cells), ["reference", "method", "rel_l", "rel_r"]
    drawn = draws(rows.select(F.explode(F.array("subject_l", "subject_r")).alias("subject")), "subject", replicates, seed)
    times = lambda c: lambda pdf: vectors.products(pdf) * pdf[c].to_numpy(float)[:, None]
    sums = vectors.unpacked(vectors.summed(vectors.weighed(cells, drawn, "subject", [], replicates), group, {c: times(c) for c in "pen"}, "<f8"), group, ["p", "e", "n"], "<f8").where("n > 0")
    seen = cells.groupBy(*group).agg(F.max("value").alias("value"), *(F.sum(c).cast("double").alias(c) for c in "pen"))
    # Replicates x relations of labels: read by both measures.
    columns = [*group, "replicate", "value", "p", "e", "n"]
    per = settled(sums.join(seen.select(*group, "value"), group).select(*columns).unionByName(seen.withColumn("replicate", F.lit(-1)).select(*columns)))
    keys = ["standard", "method", "replicate"]
    per = per.withColumnRenamed("reference", "standard")
    mae = per.groupBy(*keys).agg((F.sum("e") / F.sum("n")).alias("mae"))
    rel = per.where("rel_l <> rel_r").select(*keys, F.concat_ws("::", "rel_l", "rel_r").alias("relation"), F.col("value").alias("reference"), F.round(F.col("p") / F.col("n"), 9).alias("predicted"))
    got = mae.join(ranking_metrics(rel, keys), keys, "left")
    return got.select(F.col("standard").alias("reference"), "method", "replicate", "mae", "spearman", "kendall", "order_accuracy")


def relation_means(rows: DataFrame, value: str, replicates: int, seed: int = SEED) -> DataFrame:
    """(replicate, rel_l, rel_r, mean) of pairs of two categories under one draw of subjects, from sums by subject pair and relation made before any replicate; relations without weight are left out."""
    from pairlens.functions.scalars import relation
    from pairlens.plans.storage import settled

    cells = settled(rows.groupBy("subject_l", "subject_r", *relation(F.col("category_l"), F.col("category_r"))).agg(F.sum(value).alias("t"), F.count("*").alias("n")))
    drawn = draws(cells.select(F.explode(F.array("subject_l", "subject_r")).alias("subject")), "subject", replicates, seed)
    times = lambda c: lambda pdf: vectors.products(pdf) * pdf[c].to_numpy(float)[:, None]
    keys = ["rel_l", "rel_r"]
    w = vectors.weighed(cells.where("rel_l <> rel_r"), drawn, "subject", [], replicates)
    sums = vectors.unpacked(vectors.summed(w, keys, {c: times(c) for c in "tn"}, "<f8"), keys, ["t", "n"], "<f8")
    return sums.where("n > 0").select("replicate", *keys, (F.col("t") / F.col("n")).alias("mean"))


def ranking_contrasts(measured: DataFrame, first: str, second: str) -> DataFrame:
    """(reference, metric, observed, lower, upper) of ``ranking``: ordering metrics of first less second, and the error of second less first, paired
    by replicate; undefined replicates are left out."""
    metrics = ("mae", "spearman", "kendall", "order_accuracy")
    long = measured.select("reference", "method", "replicate", F.explode(F.array(*(F.struct(F.lit(x).alias("metric"), F.col(x).alias("x")) for x in metrics))).alias("e")).select("reference", "method", "replicate", "e.*")
    of = lambda name: F.max(F.when(F.col("method") == name, F.col("x")))
    gap = long.groupBy("reference", "metric", "replicate").agg((of(first) - of(second)).alias("d")).withColumn("d", F.when(F.col("metric") == "mae", -F.col("d")).otherwise(F.col("d")))
    seen = gap.where("replicate = -1").select("reference", "metric", F.col("d").alias("observed"))
    return seen.join(interval(gap.where("replicate >= 0"), "d", keys=["reference", "metric"]), ["reference", "metric"]).select("reference", "metric", "observed", "lower", "upper")


def row_gain(rows: DataFrame, replicates: int, unit: str, seed: int = SEED) -> DataFrame:
    """(replicate, gain) of the mean error when rows of ``unit`` are drawn; fits stay frozen."""
    per = rows.groupBy(unit).agg(F.sum("base_error").alias("b"), F.sum("error").alias("e"), F.count("*").alias("n"))
    w = vectors.drawn_sums(numbered(per, "idx", unit), "idx", ["b", "e", "n"], replicates, seed)
    return w.select("replicate", improvement(F.col("b") / F.col("n"), F.col("e") / F.col("n")).alias("gain"))


def clustered_delta(rows: DataFrame, replicates: int, seed: int = SEED) -> DataFrame:
    """(replicate, delta): subjects drawn within strata, then rows of each drawn subject; equal means of drawn subjects, then equal stratum means. Replicate -1 is the observed one.
    rows(stratum, item_l, item_r, subject_l, subject_r, delta)."""
    from pairlens.operators.estimators import endpoints

    rows = rows.select("stratum", "item_l", "item_r", "subject_l", "subject_r", "delta")
    small, large = _apart(rows, ["stratum"])

    def deltas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, keys = _ends(pdf), (pdf["stratum"].iloc[0],)
        _, starts, sizes = np.unique(pdf["subject"].to_numpy(), return_index=True, return_counts=True)
        n, values = len(sizes), pdf["delta"].to_numpy(float)
        inner = np.array([vectors.own_seed(seed + 1, *keys, j) for j in range(n)], np.int64)
        s = vectors.drawn(vectors.own_seed(seed, *keys), np.arange(replicates)[:, None], np.arange(n)[None, :], n)
        mean = np.full(s.shape, np.nan)
        for c, (start, size) in enumerate(zip(starts, sizes, strict=True)):
            r, j = np.nonzero(s == c)
            own, k = values[start : start + size], np.arange(size)[None, :]
            known = ~np.isnan(own)
            # Few draws at a time stay in the cache.
            step = max(1, 65_536 // size)
            for lo in range(0, len(r), step):
                a, b = r[lo : lo + step], j[lo : lo + step]
                at = vectors.drawn(inner[b][:, None], a[:, None], k, int(size))
                times = known[at].sum(1)
                mean[a, b] = np.divide(np.nan_to_num(own)[at].sum(1), times, out=np.full(len(a), np.nan), where=times > 0)
        there = (~np.isnan(mean)).sum(1)
        return pd.DataFrame({"replicate": np.arange(replicates), "d": np.divide(np.nansum(mean, axis=1), there, out=np.full(replicates, np.nan), where=there > 0)}).dropna()

    means = endpoints(small if large is None else small.unionByName(large)).groupBy("stratum", "subject").agg(F.avg("delta").alias("d"))
    seen = means.groupBy("stratum").agg(F.avg("d").alias("d")).agg(F.lit(-1).alias("replicate"), F.avg("d").alias("delta"))
    per = small.groupBy("stratum").applyInPandas(deltas, "replicate int, d double")
    if large is not None:
        sizes, units, each = _clusters(endpoints(large), ["stratum"], "subject", [], "item_l", "item_r")
        outer = redrawn(_replicated(sizes, replicates), "S", "j", "s", seed, "stratum").hint("merge").join(units, ["stratum", "s"])
        drawn = drawn_means(outer.select("replicate", "stratum", "j", "subject"), each, ["stratum", "subject"], ["stratum", "j"], "delta", seed + 1)
        per = per.unionByName(drawn.groupBy("replicate", "stratum").agg(F.avg("mean").alias("d")).select("replicate", "d"))
    return per.groupBy("replicate").agg(F.avg("d").alias("delta")).unionByName(seen)


def subject_mean(rows: DataFrame, value: str, replicates: int, seed: int = SEED) -> DataFrame:
    """(replicate, estimate): subjects (one row each) drawn; the mean of their values."""
    return rows.join(draws(rows, "subject", replicates, seed), "subject").groupBy("replicate").agg((F.sum(F.col("m") * F.col(value)) / F.sum("m")).alias("estimate"))


def grouped_mean(rows: DataFrame, keys: list[str], value: str, replicates: int, seed: int = SEED) -> DataFrame:
    """(keys, replicate, estimate): the subjects of every group (one row each) drawn alone; the mean of their values."""
    w = rows.join(draws(rows, "subject", replicates, seed, keys), [*keys, "subject"])
    return w.groupBy(*keys, "replicate").agg((F.sum(F.col("m") * F.col(value)) / F.sum("m")).alias("estimate"))


def slope_bootstrap(rows: DataFrame, replicates: int, seed: int = SEED) -> DataFrame:
    """(replicate, contrast): at every q subjects are drawn alone; slope of mean gain on q, ordinary less balanced. rows(mode, q, subject, gain)."""
    w = rows.join(draws(rows, "subject", replicates, seed, ["q"]), ["q", "subject"])
    means = w.groupBy("replicate", "mode", "q").agg((F.sum(F.col("m") * F.col("gain")) / F.sum("m")).alias("g"))
    slopes = means.groupBy("replicate", "mode").agg(F.regr_slope("g", "q").alias("s"))
    return slopes.groupBy("replicate").agg((F.max(F.when(F.col("mode") == "ordinary", F.col("s"))) - F.max(F.when(F.col("mode") == "balanced", F.col("s")))).alias("contrast"))


def interval(frame: DataFrame, value: str, level: float = 0.95, keys: list[str] | None = None) -> DataFrame:
    """(keys, lower, upper, sd, replicates): percentile interval and the replicates' sample deviation."""
    tail = (1 - level) / 2
    g = frame.groupBy(*(keys or [])).agg(F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail))).alias("q"), F.stddev_samp(value).alias("sd"), F.count(value).alias("replicates"))
    return g.select(*(keys or []), F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"), "sd", "replicates")


def tail_p(frame: DataFrame, value: str) -> DataFrame:
    """One-sided (k + 1)/(n + 1), k replicates at 0 or below."""
    return frame.agg(((F.sum(F.when(F.col(value) <= 0, 1).otherwise(0)) + 1) / (F.count(value) + 1)).alias("p"))


def cluster_sign_flip(effects: DataFrame, permutations: int, seed: int = SEED) -> DataFrame:
    """(observed, p): effects(stratum, subject, effect) of subjects present in both arms; the median of stratum medians under random signs."""
    if permutations < LEAST_PERMUTATIONS:
        raise ValueError(f"at least {LEAST_PERMUTATIONS} permutations are needed")
    units = numbered(effects, "u", "stratum", "subject").withColumn("u", F.col("u") + 1)
    perms = units.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    null = perms.withColumn("e", F.col("effect") * sign(seed, F.col("replicate"), F.col("u"))).groupBy("replicate", "stratum").agg(F.median("e").alias("s")).groupBy("replicate").agg(F.median("s").alias("t"))
    seen = effects.groupBy("stratum").agg(F.median("effect").alias("s")).agg(F.median("s").alias("observed"))
    return null.crossJoin(F.broadcast(seen)).agg(F.max("observed").alias("observed"), ((F.sum(F.when(F.col("t") >= F.col("observed"), 1).otherwise(0)) + 1) / (F.count("*") + 1)).alias("p"))


def subject_effects(rows: DataFrame) -> DataFrame:
    """(stratum, subject, effect): B mean less A mean of subjects that have both."""
    from pairlens.operators.estimators import endpoints

    m = lambda a: F.avg(F.when(F.col("arm") == a, F.col("distance")))
    return endpoints(rows).groupBy("stratum", "subject").agg(m("A").alias("a"), m("B").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").select("stratum", "subject", (F.col("b") - F.col("a")).alias("effect"))


def exact_sign_flip(effects: DataFrame, largest: int = 20) -> DataFrame:
    """(strata, vectors, observed, extreme, p): all 2^k sign vectors over strata (stratum, effect, weight), two-sided, tolerance 1e-15."""
    k = effects.count()
    if k > largest:
        raise ValueError(f"{k} strata: more than 2^{largest} sign vectors")
    spark = effects.sparkSession
    w = Window.partitionBy(F.lit(0)).orderBy("stratum")
    indexed = effects.select((F.row_number().over(w) - 1).alias("i"), "effect", "weight")
    packed = indexed.agg(F.array_sort(F.collect_list(F.struct("i", "effect", "weight"))).alias("es"), (F.sum(F.col("effect") * F.col("weight")) / F.sum("weight")).alias("observed"), F.sum("weight").alias("total"))
    es = packed.first()
    terms = [float(e["effect"]) * float(e["weight"]) / float(es["total"]) for e in es["es"]]
    bit: Callable[[int], Column] = lambda i: F.shiftright("id", i).bitwiseAND(1)
    stat = sum((F.when(bit(i) == 1, -t).otherwise(t) for i, t in enumerate(terms)), F.lit(0.0))
    got = spark.range(1 << k).agg(F.sum(F.when(F.abs(stat) >= abs(float(es["observed"] or 0.0)) - 1e-15, 1).otherwise(0)).alias("extreme"), F.count("*").alias("vectors"))
    return got.select(F.lit(k).cast("long").alias("strata"), "vectors", F.lit(float(es["observed"] or 0.0)).alias("observed"), "extreme", (F.col("extreme") / F.col("vectors")).alias("p"))


def over_seeds(rows: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """The median over seeds within each replicate; undefined values are left out."""
    return rows.where(~F.isnan(value)).groupBy("replicate", *(keys or [])).agg(F.median(value).alias(value))


def interaction_bootstrap(rows: DataFrame, replicates: int, seed: int = SEED) -> DataFrame:
    """(replicate, product): the product coefficient of gain on 1, ln ratio, strength and their product when subjects are drawn;
    rows(subject, ratio, strength, gain). Sums of products by replicate come from one aggregation."""
    w = rows.join(draws(rows, "subject", replicates, seed), "subject")
    x = [F.lit(1.0), F.ln("ratio"), F.col("strength"), F.col("strength") * F.ln("ratio")]
    names = [(i, j) for i in range(4) for j in range(i, 4)]
    sums = w.groupBy("replicate").agg(*(F.sum(F.col("m") * x[i] * x[j]).alias(f"x{i}{j}") for i, j in names), *(F.sum(F.col("m") * x[i] * F.col("gain")).alias(f"y{i}") for i in range(4)))

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                a = np.array([[float(r[f"x{min(i, j)}{max(i, j)}"]) for j in range(4)] for i in range(4)])
                out.append(float(np.linalg.lstsq(a, np.array([float(r[f"y{i}"]) for i in range(4)]), rcond=None)[0][3]))
            yield pd.DataFrame({"replicate": pdf["replicate"], "product": out})

    return sums.mapInPandas(solve, "replicate int, product double")


def paired_mean(first: DataFrame, second: DataFrame, replicates: int, seed: int = SEED) -> DataFrame:
    """(replicate, estimate): mean of second - first over drawn subjects that have both; inputs (subject, value)."""
    both = first.select("subject", F.col("value").alias("a")).join(second.select("subject", F.col("value").alias("b")), "subject").withColumn("delta", F.col("b") - F.col("a"))
    return subject_mean(both, "delta", replicates, seed)


def subject_gains(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, subject, gain): mean of base error less error over a subject's pairs."""
    from pairlens.operators.estimators import endpoints

    return endpoints(rows).groupBy(*(keys or []), "subject").agg(F.avg(F.col("base_error") - F.col("error")).alias("gain"))


def contrast(rows: DataFrame, replicates: int, seed: int = SEED) -> DataFrame:
    """(observed, lower, upper, p, passed) of rows(stratum, item_l, item_r, subject_l, subject_r, delta): the clustered form; passed if the lower bound is positive."""
    got = clustered_delta(rows, replicates, seed)
    seen = got.where("replicate = -1").select(F.col("delta").alias("observed"))
    rest = got.where("replicate >= 0")
    out = interval(rest, "delta").select("lower", "upper").crossJoin(tail_p(rest, "delta")).crossJoin(seen)
    return out.select("observed", "lower", "upper", "p", (F.col("lower") > 0).alias("passed"))
