"""Operators on small tables with answers worked out by hand."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.functions import ordering, scalars, vectors
from pairlens.operators import audits, corrections, estimators, gates, heads, inventory, matrices, pairs, pools, resample, scoring, validate
from pairlens.sources import items as src

ROWS = "stratum string, arm string, item_l long, item_r long, subject_l long, subject_r long, distance double"


def one(frame):
    return frame.first().asDict()


def lit(spark, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, 1, "d1", "c", "train"), (2, 1, "d1", "c", "train"), (3, 1, "d2", "c", "train"), (4, 2, "d1", "c", "train")], "item long, subject long, category string, condition string, split string")


def test_capacity(spark, items):
    assert one(pairs.capacity(items)) == {"a": 1, "b": 2, "c": 2, "d": 1}
    rng = random.Random(1)
    many = spark.createDataFrame([(i, rng.randrange(9), f"d{rng.randrange(4)}", "c", rng.choice(["train", "evaluation"])) for i in range(80)], items.schema)
    want = {}
    for r in pairs.grouped_counts(many).collect():
        want.setdefault(r["split"], {})[r["group"].lower()] = r["n"]
    assert {r["split"]: {k: r[k] for k in "abcd"} for r in pairs.capacity(many, ["split"]).collect()} == want


def test_violations(spark, items):
    bad = items.unionByName(spark.createDataFrame([(1, 1, " ", "c", "evaluation"), (9, 7, "d", "c", "other")], items.schema))
    assert {r["rule"]: r["n"] for r in validate.record_violations(bad).collect()} == {"blank_field": 1, "unknown_split": 1, "duplicate_item": 1, "subject_in_two_splits": 1}
    with pytest.raises(validate.Rejected):
        validate.require(validate.record_violations(bad).where("n > 0"), "items")
    validate.require(validate.record_violations(items).where("n > 0"), "items")
    d = spark.createDataFrame([("s", "A", 1, 2, 1, 1, 0.5), ("s", "E", 1, 2, 1, 1, 0.5), ("", "A", 1, 2, 1, 1, 0.5), ("s", "B", 1, 2, 1, 1, float("nan")), ("s", "B", 1, 2, 1, 1, 2.5)], ROWS)
    assert validate.distance_violations(d).count() == 4


def rows_of(spark, spec):
    return spark.createDataFrame([(s, a, 2 * k, 2 * k + 1, l, r, float(d)) for k, (s, a, l, r, d) in enumerate(spec)], ROWS)


def test_median_of_medians(spark):
    r = rows_of(spark, [("x", "A", 1, 1, 0.10), ("x", "A", 1, 1, 0.12), ("x", "A", 2, 2, 0.11), ("x", "B", 1, 3, 0.40), ("x", "B", 1, 3, 0.42), ("x", "B", 2, 4, 0.39)])
    assert one(estimators.median_of_medians(estimators.stratum_effects(r))) == {"estimate": pytest.approx(0.29), "strata": 1}


@pytest.fixture(scope="module")
def sparse(spark):
    spec = [("s", "A", 0, 0, 0.0)] + [("s", "B", 1 + 2 * i, 2 + 2 * i, 100.0) for i in range(160)]
    return rows_of(spark, spec + [("t", "A", 1000 + i, 1000 + i, 0.0) for i in range(50)] + [("t", "B", 2000 + 2 * i, 2001 + 2 * i, 1.0) for i in range(50)])


def test_sparse_stratum(sparse):
    e = estimators.stratum_effects(sparse)
    w = 160 / 161
    assert one(estimators.overlap_effect(e))["estimate"] == pytest.approx((w * 100 + 25) / (w + 25))
    assert one(estimators.median_of_medians(e))["estimate"] == 50.5
    assert {r["stratum"]: r["estimate"] for r in estimators.leave_one_out(e).collect()} == pytest.approx({"s": 1.0, "t": 100.0})
    assert [r["stratum"] for r in estimators.qualified(sparse).collect()] == ["t"]


def test_one_armed(spark):
    r = rows_of(spark, [("x", "A", 1, 1, 0.1), ("y", "A", 1, 1, 0.1), ("y", "B", 1, 2, 0.2)])
    assert [x["stratum"] for x in estimators.one_armed(r).collect()] == ["x"]
    assert estimators.stratum_effects(r).count() == 1 and estimators.stratum_effects(r, one_armed="keep").count() == 2


def test_scalars(spark):
    f = lit(spark, a=1.0, b=160.0)
    assert f.select(scalars.overlap_weight(F.col("a"), F.col("b"))).first()[0] == pytest.approx(160 / 161)
    m = lambda l, r, s: lit(spark, l=l, r=r, s=s).select(scalars.multiplicity(F.col("l"), F.col("r"), F.col("s"))).first()[0]  # noqa: E731, E741
    assert m(3, 3, True) == 3 and m(3, 2, False) == 6
    assert f.select(scalars.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0))).first()[0] == pytest.approx(math.pi * 6371.0088)
    assert [f.select(scalars.improvement(F.lit(0.0), F.lit(1.0), g)).first()[0] for g in ("positive", "tiny", "none")] == [0.0, 0.0, None]
    assert [f.select(scalars.smooth_l1(F.lit(x))).first()[0] for x in (0.5, 2.0)] == [0.125, 1.5]


def test_zero_vectors(spark):
    c = lambda d, l, r, z: lit(spark, d=d, l=l, r=r).select(vectors.cosine_from(F.col("d"), F.col("l"), F.col("r"), z)).first()[0]  # noqa: E731, E741
    assert c(0.0, 0.0, 0.0, "null") is None and c(0.0, 0.0, 0.0, "distinct") == 0 and c(0.0, 1.0, 0.0, "distinct") == 1 and c(0.0, 0.0, 0.0, "orthogonal") == 1 and c(0.0, 0.0, 0.0, "epsilon") == 1
    assert c(4.0, 2.0, 2.0, "null") == 0 and c(-4.0001, 2.0, 2.0, "null") == 2


def test_weightings(spark):
    e = spark.createDataFrame([("s1", 1, 1, "B", "B", 0.0), ("s1", 1, 2, "B", "J", 1.0), ("s2", 3, 4, "J", "Z", 1.0)], "stratum string, subject_l long, subject_r long, category_l string, category_r string, error double")
    got = {r["weighting"]: r["value"] for r in estimators.weighted_mae(e).collect()}
    assert got == pytest.approx({"pair": 2 / 3, "endpoint_subject": 0.875, "stratum": 0.75, "category_relation": 2 / 3})


def test_support_weights(spark):
    w = spark.createDataFrame([(1.0, 1.0, 1.0, 0.0), (3.0, 1.0, 2.0, 2.0)], "w_pairs double, w_subjects double, w_ess double, effect double")
    got = one(estimators.support_estimates(w))
    assert got["by_pairs"] == 1.5 and got["by_subjects"] == 1.0
    s = lit(spark, t=6.0, q=18.0).select(scalars.effective_size(F.col("t"), F.col("q"))).first()[0]
    assert s == 2


def rel(spark, rows):
    return spark.createDataFrame(rows, "relation string, reference double, predicted double")


def test_ranking(spark):
    same = one(estimators.ranking_metrics(rel(spark, [("AB", 0.2, 0.2), ("AC", 0.8, 0.8), ("BC", 0.5, 0.5)])))
    assert (same["spearman"], same["kendall"], same["order_accuracy"]) == pytest.approx((1, 1, 1))
    back = one(estimators.ranking_metrics(rel(spark, [("AB", 0.2, 0.8), ("AC", 0.8, 0.2), ("BC", 0.5, 0.5)])))
    assert back["order_accuracy"] == 0 and back["reversals"] == 3
    ties = one(estimators.ranking_metrics(rel(spark, [("a", 0.2, 0.1), ("b", 0.2, 0.4), ("c", 0.8, 0.4)])))
    assert ties["tied_reference"] == 1 and ties["tied_predicted"] == 1 and ties["order_accuracy"] == 0.75
    flat = one(estimators.ranking_metrics(rel(spark, [("a", 1.0, 0.1), ("b", 1.0, 0.4)])))
    assert flat["spearman"] is None and flat["kendall"] is None


def test_order_statistics(spark):
    w = spark.createDataFrame([("g", 1.0, 1), ("g", 2.0, 1), ("g", 3.0, 2), ("g", 10.0, 4), ("g", 99.0, 0)], "g string, v double, w long")
    assert one(ordering.lower_weighted_median(w, ["g"], "v", "w"))["median"] == 3.0
    p = spark.createDataFrame([("a", 0.001), ("b", 0.02), ("c", 0.9)], "k string, p double")
    assert [r["adjusted"] for r in ordering.holm(p, [], "p", "k").orderBy("p").collect()] == pytest.approx([0.003, 0.04, 0.9])


def test_exact_sign_flip(spark):
    e = spark.createDataFrame([(f"s{i:02}", 0.1, 1.0) for i in range(12)], "stratum string, effect double, weight double")
    got = one(resample.exact_sign_flip(e))
    assert got["vectors"] == 4096 and got["p"] == pytest.approx(2 / 4096)
    with pytest.raises(ValueError):
        resample.exact_sign_flip(e, largest=5)


def test_draws_are_multinomial(spark):
    units = spark.createDataFrame([(i,) for i in range(17)], "subject long")
    d = resample.draws(units, "subject", 60)
    assert {r["n"] for r in d.groupBy("replicate").agg(F.sum("m").alias("n")).collect()} == {17}
    again = resample.draws(units.repartition(7), "subject", 60)
    assert d.exceptAll(again).count() == 0 and d.select("m").distinct().count() > 2


def test_clustered_delta(spark):
    rows = spark.createDataFrame([("A", i, i, 1, 1, 1.0) for i in range(3)] + [("A", 9, 9, 2, 2, -1.0)], "stratum string, item_l long, item_r long, subject_l long, subject_r long, delta double")
    got = {r["replicate"]: r["delta"] for r in resample.clustered_delta(rows, 20).collect()}
    assert got[-1] == 0.0 and len(got) == 21


def test_bootstraps_centre_on_the_data(spark, sparse):
    rows = rows_of(spark, [(s, a, l, l if a == "A" else l + 50, d) for s in "xy" for l in range(8) for a, d in (("A", 0.1), ("B", 0.5))])
    for frame in (resample.global_dyadic(rows, 30, unit="item"), resample.nested_cluster(rows, 30), resample.support_bootstrap(rows, 20).select(F.col("by_ess").alias("estimate")), resample.arm_items(rows, 20, independent=True)):
        assert {round(r["estimate"], 9) for r in frame.collect()} == {0.4}
    i = one(resample.interval(resample.global_dyadic(rows, 30, unit="item"), "estimate"))
    assert i["lower"] == pytest.approx(0.4) and i["replicates"] == 30
    cat = rows.withColumn("category", F.col("stratum"))
    for f in (resample.stratified_mean, resample.hierarchical):
        assert {round(r["estimate"], 9) for r in f(cat, 10).collect()} == {0.4}


def test_greedy_matching_equals_the_sequential_rule(spark):
    rng = random.Random(2)
    edges = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(90)})
    frame = spark.createDataFrame([("s", "A", a, b) for a, b in edges], "stratum string, arm string, item_l long, item_r long")
    used, want = set(), set()
    for a, b in sorted(edges, key=lambda e: hashlib.sha256(f"{pairs.SEED}|A|{e[0]}|{e[1]}".encode()).hexdigest()):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert {(r["item_l"], r["item_r"]) for r in pairs.greedy_matching(frame).collect()} == want


def test_round_robin_pairs_neighbours(spark):
    got = pairs.consecutive_pairs(spark.createDataFrame([(i, 1, "d", "c", "train") for i in (5, 3, 9, 7, 1)], "item long, subject long, category string, condition string, split string")).collect()
    assert [(r["item_l"], r["item_r"]) for r in sorted(got, key=lambda r: r["place"])] == [(1, 3), (5, 7)]


def test_greedy_matching_with_a_limit(spark):
    rng = random.Random(3)
    rows = rows_of(spark, [("s", rng.choice("AB"), 1, 2, 0.0) for _ in range(300)])
    rows = rows.withColumn("item_l", F.col("item_l") % 41).withColumn("item_r", F.col("item_r") % 37 + 1).where("item_l < item_r").dropDuplicates(["arm", "item_l", "item_r"])
    for limit in (1, 4, 9, 1000):
        want = []
        for arm in "AB":
            used, kept = set(), 0
            for _, x, y in sorted((hashlib.sha256(f"{pairs.SEED}|{arm}|{r['item_l']}|{r['item_r']}".encode()).hexdigest(), r["item_l"], r["item_r"]) for r in rows.where(F.col("arm") == arm).collect()):
                if not {x, y} & used and kept < limit:
                    used |= {x, y}
                    kept += 1
                    want.append((arm, x, y))
        assert sorted((r["arm"], r["item_l"], r["item_r"]) for r in pairs.greedy_matching(rows, limit=limit).collect()) == sorted(want)


def sequential(strata, limit):
    """The round robin over streams of candidates, as it is said."""
    out, used, labels = [], set(), sorted(x for x in strata if strata[x])
    streams = {x: iter(strata[x]) for x in labels}
    while labels and len(out) < limit:
        for x in list(labels):
            for a, b in streams[x]:
                if not {a, b} & used:
                    out.append((x, a, b))
                    used |= {a, b}
                    break
            else:
                labels.remove(x)
            if len(out) >= limit:
                break
    return out


def random_items(spark, n, seed, subjects=6, categories=4):
    rng = random.Random(seed)
    rows = [(i, int(rng.triangular(0, subjects, 0)), f"d{int(rng.triangular(0, categories, categories))}", rng.choice("cd"), rng.choice(["train", "evaluation"])) for i in rng.sample(range(10 * n), n)]
    return rows, spark.createDataFrame(rows, "item long, subject long, category string, condition string, split string")


@pytest.mark.parametrize("seed", range(4))
def test_bucket_matching_equals_the_sequential_rule(spark, seed):
    from itertools import combinations, product

    rows, items_ = random_items(spark, 90, seed)
    for bucket, within, b, w in (("subject", ("split", "category"), 1, 2), ("category", ("split", "subject"), 2, 1)):
        got = pairs.round_robin(pairs.bucket_matching(items_, bucket, within), within[1]).orderBy("place").collect()
        want = []
        for split in sorted({r[4] for r in rows}):
            strata = {}
            for x in {r[w] for r in rows if r[4] == split}:
                held = {}
                for r in sorted((r for r in rows if r[4] == split and r[w] == x), key=lambda r: (r[3], r[0])):
                    held.setdefault(r[b], []).append(r[0])
                strata[x] = [p for i, j in combinations(sorted(held), 2) for p in product(held[i], held[j])]
            want += [(split, *x) for x in sequential(strata, 10**9)]
        assert [(r["split"], r[within[1]], r["item_l"], r["item_r"]) for r in got] == want
        some = pairs.round_robin(pairs.bucket_matching(items_, bucket, within), within[1], 7).collect()
        assert sorted(r["place"] for r in some) == list(range(1, 8))


@pytest.mark.parametrize("seed", range(4))
def test_crossed_selection_equals_the_sequential_rule(spark, seed):
    from itertools import combinations, product

    rows, items_ = random_items(spark, 70, seed, subjects=3)
    for limit in (1, 5, 19, 1000):
        want = []
        for split in sorted({r[4] for r in rows}):
            held = {}
            for r in sorted((r for r in rows if r[4] == split), key=lambda r: (r[3], r[0])):
                held.setdefault(r[2], {}).setdefault(r[1], []).append(r[0])
            strata = {f"{a}::{b}": [p for s in sorted(held[a]) for t in sorted(held[b]) if s != t for p in product(held[a][s], held[b][t])] for a, b in combinations(sorted(held), 2)}
            want += [(split, *x) for x in sequential(strata, limit - len(want))]
        got = pairs.crossed_selected(items_, limit).orderBy("place").collect()
        assert [(r["split"], r["label"], r["item_l"], r["item_r"]) for r in got] == want


def test_leftovers_use_no_item_twice(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(5), f"d{rng.randrange(2)}", "c", "train") for i in range(60)]
    got = pairs.bucket_matching(spark.createDataFrame(rows, "item long, subject long, category string, condition string, split string")).collect()
    flat = [x for r in got for x in (r["item_l"], r["item_r"])]
    who = {r[0]: r for r in rows}
    assert len(flat) == len(set(flat)) > 20 and all(who[r["item_l"]][1] != who[r["item_r"]][1] and who[r["item_l"]][2] == who[r["item_r"]][2] for r in got)


def test_crossed_never_pairs_a_subject_with_itself(spark):
    it = spark.createDataFrame([(1, 1, "a", "c", "t"), (2, 1, "b", "c", "t"), (3, 2, "a", "c", "t"), (4, 3, "b", "c", "t")], "item long, subject long, category string, condition string, split string")
    assert {(r["item_l"], r["item_r"]) for r in pairs.crossed(it, 5).collect()} == {(3, 4)}


def test_affine_variants(spark):
    f = lambda rows, **k: one(scoring.affine(spark.createDataFrame(rows, "x double, y double"), "x", "y", **k))
    assert f([(0.0, 3.0), (1.0, 1.0)], clamped=True) == {"slope": 0.0, "intercept": 2.0}
    assert f([(0.0, 3.0), (1.0, 1.0)]) == pytest.approx({"slope": -2.0, "intercept": 3.0})
    assert f([(2.0, 5.0), (2.0, 5.0)]) == pytest.approx({"slope": 2.0, "intercept": 1.0})
    assert f([]) == {"slope": 1.0, "intercept": 0.0}


def test_matrices(spark):
    dist = lambda m: spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(m) for j, v in enumerate(row)], "i long, j long, value double")
    groups = spark.createDataFrame([(0, "A"), (1, "A"), (2, "A")], "i long, grp string")
    assert one(matrices.medoids(dist([[0, 1, 4], [1, 0, 2], [4, 2, 0]]), groups))["medoid"] == 1
    assert one(matrices.medoids(dist([[0, 1, 1], [1, 0, 1], [1, 1, 0]]), groups))["medoid"] == 0
    g2 = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B")], "i long, grp string")
    got = {(r["l"], r["r"]): r["value"] for r in matrices.blocks(dist([[0, 2, 4], [2, 0, 6], [4, 6, 0]]), g2).collect()}
    assert got["A", "B"] == 5.0 and got["A", "A"] == 0
    m = spark.createDataFrame([(a, b, float(abs(a - b) ** 1.5 + (a + b) * 0.01 * (a != b))) for a in range(9) for b in range(9)], "l long, r long, value double")
    same = one(matrices.compared(m, m.withColumn("value", F.col("value") * 3)))
    assert same["relations"] == 36 and same["reversals"] == 0 and same["pearson"] == pytest.approx(1) and same["spearman"] == pytest.approx(1)
    assert matrices.normalised(m).agg(F.max("value")).first()[0] == 1.0
    assert {r["rule"] for r in validate.matrix_violations(m.withColumn("value", F.when(F.col("l") == 1, 9.0).otherwise(F.col("value"))), 9).where("n > 0").collect()} == {"asymmetric", "diagonal"}
    near = matrices.nearest(spark.createDataFrame([(1, 1, 0.0, 0.0)], "point long, area long, lon double, lat double"), spark.createDataFrame([(7, 1, 1.0, 0.0), (5, 1, -1.0, 0.0), (1, 2, 0.0, 0.0)], "site long, area long, lon double, lat double"))
    assert one(near)["site"] == 5


def test_audits(spark):
    P = "pair_id string, arm string, item_l long, item_r long, subject_l long, subject_r long, category_l string, category_r string"
    a = spark.createDataFrame([("A-1", "A", 1, 2, 1, 1, "x", "x"), ("A-2", "B", 1, 3, 1, 2, "x", "x")], P)
    b = spark.createDataFrame([("A-1", "A", 2, 1, 1, 1, "x", "x"), ("A-2", "A", 8, 9, 2, 7, "x", "x")], P)
    assert {r["pair_id"] for r in audits.collisions(a, b).collect()} == {"A-2"}
    assert {r["kind"]: r["shared"] for r in audits.leakage(a, b).collect()} == {"pair": 1, "item": 2, "subject": 2}
    assert one(audits.cross_arm(a)) == {"items": 3, "shared": 1, "not_nested_subject": 0, "not_nested_category": 0}
    p = one(audits.participation(a, []))
    assert p["reused"] == 1 and p["most"] == 2
    it = spark.createDataFrame([(1, "d1", "c1"), (1, "d2", "c2"), (2, "d2", "c2")], "subject long, category string, condition string")
    assert one(audits.identifiability(it))["passed"] is False
    full = spark.createDataFrame([(s, d, c) for s in (1, 2) for d in "ab" for c in "xy"], it.schema)
    assert one(audits.identifiability(full))["passed"] is True


def test_pools(spark):
    pool = spark.createDataFrame([(i, float(i % 2)) for i in range(1200)], "unit long, target double")
    assert one(pools.prevalence_capacity(pool))["capacity"] == 600
    m = pools.nested_masks(pool.limit(201), "unit", 7).where("active")
    on = {}
    for r in m.collect():
        on.setdefault(r["q"], set()).add(r["unit"])
    grid = sorted(on)
    assert all(on[a] <= on[b] for a, b in zip(grid, grid[1:], strict=False)) and len(on[0.5]) == 100 and len(on[1.0]) == 201
    inv = {r["fraction"]: r["n"] for r in inventory.inventories(spark.range(10).withColumnRenamed("id", "unit"), "unit", (0.25, 1.0, 2.0)).collect()}
    assert inv == {0.25: 2, 1.0: 10, 2.0: 10}
    r = pools.rotated(spark.createDataFrame([(1, 0.0), (2, 0.4), (3, 0.8)], "unit long, target double"), "unit", "target", 7).collect()
    assert sorted(x["shuffled"] for x in r) == [0.0, 0.4, 0.8] and all(x["shuffled"] != x["target"] for x in r)
    shares = pools.allocation(spark.createDataFrame([(s,) for s in "aaabbc"], "s string"), "s", 4).agg(F.sum("share")).first()[0]
    assert shares == 4
    nat = pools.natural_pools(pool, "unit", 40, 7).groupBy("q").count().collect()
    assert {x["count"] for x in nat} == {40}
    assert pools.folds(spark.range(23).withColumnRenamed("id", "subject"), "subject", 5, 1).groupBy("fold").count().agg(F.max("count") - F.min("count")).first()[0] <= 1


def test_losses():
    a, b = np.array([1.0, 3.0]), np.array([2.0, 6.0])
    assert heads.loss(a, b, 0.5) == 4.0 and heads.loss(a, b, 0.5, "mixed") == 2.0
    assert heads.loss(np.array([0.0, 0.5]), np.array([0.5]), 2.0, "mixed") == pytest.approx(0.5)


def test_balanced_loss(spark):
    r = one(heads.losses(spark.createDataFrame([(0.5, 0.0), (0.5, 0.0), (0.0, 1.0)], "distance double, target double")))
    assert r == pytest.approx({"ordinary": 0.25, "balanced": 0.3125})


def test_did(spark):
    rows = [("p", h, s, e) for h, s, e in (("linear", "off", 0.40), ("linear", "on", 0.42), ("mlp", "off", 0.45), ("mlp", "on", 0.43))] + [("q", "linear", "off", 1.0)]
    got = estimators.did(spark.createDataFrame(rows, "pair_id string, head string, strength string, error double")).collect()
    assert len(got) == 1 and got[0]["interaction"] == pytest.approx(-0.04)


def vec_items(spark, rows):
    return spark.createDataFrame([(i, s, c, [float(x) for x in v]) for i, s, c, v in rows], "item long, subject long, category long, vec array<double>").withColumn("norm", vectors.norm("vec"))


def test_subject_means(spark, monkeypatch):
    monkeypatch.setattr(corrections, "DIM", None)
    it = vec_items(spark, [(1, 1, 0, (10, 1, 0)), (2, 1, 0, (10, 0, 1)), (3, 2, 0, (-10, 1, 0)), (4, 2, 0, (-10, 0, 1))])
    assert {tuple(np.round(r["vec"], 9)) for r in corrections.subject_normalised(it).select("vec").collect()} == {(0.0, 1.0, 0.0), (0.0, 0.0, 1.0)}
    alone = one(corrections.leave_pair_out(spark.createDataFrame([(1, 2)], "item_l long, item_r long"), vec_items(spark, [(1, 1, 0, (1, 0)), (2, 1, 0, (1, 0)), (3, 2, 0, (0, 1))])))
    assert alone["distance"] == 0 and alone["fallbacks"] == 2


def test_canonical_correlations(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = np.column_stack([x[:, :2] @ rng.normal(size=(2, 2)), rng.normal(size=200)])
    rows = spark.createDataFrame([([float(v) for v in a], [float(v) for v in b]) for a, b in zip(x, y, strict=True)], "a array<double>, b array<double>").repartition(4)
    got = corrections.canonical_correlations(rows, "a", "b")
    qx, qy = (np.linalg.qr(z - z.mean(0))[0] for z in (x, y))
    assert got == pytest.approx(np.linalg.svd(qx.T @ qy, compute_uv=False)) and got[:2] == pytest.approx([1, 1])


def test_gates(spark):
    g = gates.gate(lit(spark, a=1, b=None), {"one": F.col("a") == 1, "unknown": F.col("b") == 1})
    assert one(g) == {"one": True, "unknown": False, "passed": False}
    assert one(gates.mechanism(lit(spark, x=True, y=False), ["x", "y"])) == {"status": "unique", "mechanisms": "x"}


def test_sources(spark, tmp_path):
    (tmp_path / "kv").write_text("a 1\nb two words\nonly\na 3\n")
    assert {r["key"]: r["value"] for r in src.key_values(spark, str(tmp_path / "kv")).collect()} == {"a": "3", "b": "two words"}
    for body in ('{"rows": [{"x": 1}, {"x": 2}]}', '[{"x": 1}, {"x": 2}]'):
        (tmp_path / "m.json").write_text(body)
        assert [r["x"] for r in src.manifest(spark, str(tmp_path / "m.json"), "rows", "x int" and __import__("pyspark").sql.types.StructType.fromDDL("x int")).collect()] == [1, 2]
    grid = spark.createDataFrame([(1, "a"), (2, "b")], "seed long, head string")
    path = str(tmp_path / "cells")
    assert src.missing_cells(grid, spark, path, ["seed", "head"]).count() == 2
    src.write_cells(grid.where("seed = 1").withColumn("v", F.lit(1.0)), path, ["seed", "head"])
    assert [r["seed"] for r in src.missing_cells(grid, spark, path, ["seed", "head"]).collect()] == [2]
    h = spark.createDataFrame([('é"', None)], "a string, b string").select(src.record_hash(["b", "a"])).first()[0]
    assert h == hashlib.sha256('{"a":"é\\"","b":null}'.encode()).hexdigest()


def test_nfkc_hash(spark):
    from pairlens.functions.text import content_hash

    rows = spark.createDataFrame([("ﬁ  x\u00a0y ",), ("fi x y",), (None,)], "t string").select(content_hash(F.col("t")).alias("h")).collect()
    assert rows[0]["h"] == rows[1]["h"] == hashlib.sha256(b"fi x y").hexdigest() and rows[2]["h"] is None


def test_media(spark, tmp_path):
    import io
    import tarfile
    import wave

    from pairlens.sources import media

    def wav(width, channels, rate, frames):
        b = io.BytesIO()
        with wave.open(b, "wb") as w:
            w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate), w.writeframes(frames)
        return b.getvalue()

    stereo = np.array([[16384, 0], [0, 16384], [-32768, -32768]], "<i2").tobytes()
    assert media.decode_wav(wav(2, 2, 16000, stereo)).tolist() == [0.25, 0.25, -1.0]
    assert media.decode_wav(wav(1, 1, 16000, bytes([128, 255]))).tolist() == [0.0, 127 / 128]
    assert len(media.decode_wav(wav(2, 1, 8000, bytes(2 * 80)))) == 160
    body = io.BytesIO()
    with tarfile.open(fileobj=body, mode="w") as t:
        for name in ("a.wav", "b.wav", "../evil.wav"):
            i = tarfile.TarInfo(name)
            i.size = 700
            t.addfile(i, io.BytesIO(name[:1].encode() * 700))
    raw = body.getvalue()
    names = []
    for k in range(0, len(raw), 1500):
        names.append(str(tmp_path / f"part{k:06}"))
        (tmp_path / f"part{k:06}").write_bytes(raw[k : k + 1500])
    archives = spark.createDataFrame([("x", names)], "archive string, parts array<string>")
    wanted = spark.createDataFrame([("x", "b.wav"), ("x", "../evil.wav")], "archive string, member string")
    got = media.archive_members(spark, archives, wanted, lambda p: open(p, "rb", buffering=0)).collect()  # noqa: SIM115
    assert [(r["member"], r["size"], bytes(r["content"])) for r in got] == [("b.wav", 700, b"b" * 700)]


def test_release(spark):
    from pairlens.sources import release

    assert release.study({"least_gain": 0.1}).least_gain == 0.1
    for bad in ({"seed": 1}, {"seed": True}, {"what": 1}, {"correction": 5}):
        with pytest.raises(ValueError):
            release.study(bad)
    f = spark.createDataFrame([((1, "/home/me/x"), "keep", ["/home/me/y"])], "s struct<secret:int,path:string>, secret string, l array<string>")
    got = release.sanitised(f, {"secret"}, {"/home/me/": ""}).first().asDict(recursive=True)
    assert got == {"s": {"path": "x"}, "l": ["y"]}


def test_paired_and_seeds(spark):
    a = spark.createDataFrame([(i, 1.0) for i in range(6)], "subject long, value double")
    assert {r["estimate"] for r in resample.paired_mean(a, a.withColumn("value", F.lit(3.0)), 10).collect()} == {2.0}
    s = spark.createDataFrame([(0, 1.0), (0, float("nan")), (0, 3.0)], "replicate int, v double")
    assert one(resample.over_seeds(s, "v"))["v"] == 2.0
