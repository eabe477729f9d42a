"""Plans whose shuffles, broadcasts and methods stay small: what failed on larger tables."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.functions import scalars, vectors
from pairlens.operators import audits, matrices, pairs, replicates, resample, scoring
from pairlens.plans import catalogue

SF = "/root/testdata/sf0.001"


def some_items(spark, n=60, dim=64, seed=3):
    rng = random.Random(seed)
    rows = [(i, i % 7, str(i % 3), str(i % 2), "evaluation", [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    return spark.createDataFrame(rows, "item long, subject long, category string, condition string, split string, vec array<double>").withColumn("norm", vectors.norm("vec", dim))


def joins(frame):
    return sum("Join" in line for line in frame._jdf.queryExecution().optimizedPlan().toString().split("\n"))


def test_distances_within_are_those_of_the_pairs(spark):
    items = some_items(spark)
    got = scoring.distances_within(items)
    want = scoring.distances(pairs.matched_pairs(items), items)
    key = lambda f: {(r["item_l"], r["item_r"]): r for r in f.collect()}
    a, b = key(got), key(want)
    assert got.columns == [*pairs.matched_pairs(items).columns, "distance"] and set(a) == set(b) and len(a) > 100
    assert all(a[k]["distance"] == pytest.approx(b[k]["distance"], abs=1e-12) and a[k]["arm"] == b[k]["arm"] for k in a)


def test_no_shuffled_pair_carries_a_vector(spark):
    """F13 to F28: items meet once, with their vectors; no pair is joined again."""
    items = some_items(spark)
    assert joins(scoring.distances_within(items)) == 1 and joins(scoring.distances(pairs.matched_pairs(items), items)) == 3
    assert joins(catalogue.all_pairs(spark, SF)) == 1 and joins(catalogue._matrix(spark, SF)[0]) == 1


def test_a_dot_product_is_compiled_in_small_methods(spark):
    """A method over 8,000 bytes is interpreted."""
    f = some_items(spark).select(vectors.cosine_from(vectors.dot("vec", "vec", 64), F.col("norm"), F.col("norm")).alias("d"))
    found = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(f._jdf.queryExecution().executedPlan())
    sizes = [found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())]
    assert sizes and max(sizes) <= 8000


def test_groups_on_the_rows_are_those_of_the_join(spark):
    items = some_items(spark)
    groups = items.select(F.col("item").alias("i"), F.col("category").alias("grp"))
    d = items.select(F.col("item").alias("i")).crossJoin(items.select(F.col("item").alias("j"))).withColumn("value", F.abs(F.col("i") - F.col("j")) + 0.5)
    a, b = (groups.select(F.col("i").alias(i), F.col("grp").alias(g)) for i, g in (("i", "l"), ("j", "r")))
    for f in (matrices.blocks, matrices.medoids):
        assert sorted(f(d, groups).collect()) == sorted(f(d.join(a, "i").join(b, "j"), groups).collect())


def test_draws_of_arrays_are_those_of_the_expression(spark):
    rows = spark.range(500).select(F.col("id").alias("r"), (F.col("id") * 7919 % 1000003).alias("k"), (F.col("id") % 97 + 1).alias("n"))
    got = rows.select("r", "k", "n", scalars.draw(F.lit(20260829 + (1 << 28)), F.col("r"), F.col("k"), F.col("n")).alias("x"), scalars.group_seed(5, F.lit("a|b"), F.lit(3)).alias("s")).collect()
    r, k, n, x = (np.array([g[c] for g in got], np.int64) for c in ("r", "k", "n", "x"))
    assert (replicates.drawn(20260829 + (1 << 28), r, k, n) == x).all() and got[0]["s"] == replicates.own_seed(5, "a|b", 3)


def matched(spark, n=300, subjects=6):
    rng = random.Random(9)
    rows = []
    for k in range(n):
        arm, left = rng.choice("AB"), rng.randrange(subjects)
        right = left if arm == "A" else (left + 1 + rng.randrange(subjects - 1)) % subjects
        rows.append((rng.choice("xy"), arm, 2 * k, 2 * k + 1, left, right, rng.gauss(arm == "B", 1), rng.gauss(0.1, 1), rng.random(), rng.random(), str(k)))
    return spark.createDataFrame(rows, "stratum string, arm string, item_l long, item_r long, subject_l long, subject_r long, distance double, delta double, base_error double, error double, pair_id string")


@pytest.mark.parametrize("form", ["nested_cluster", "clustered_delta", "stratum_dyadic"])
def test_strata_too_large_for_a_task_give_the_same(spark, monkeypatch, form):
    """F1, F8, F9: strata drawn where they lie equal those drawn as joined rows."""
    rows = matched(spark)
    key = lambda f: {r["replicate"]: [round(v, 9) for c, v in r.asDict().items() if c != "replicate"] for r in f.collect()}
    near = key(getattr(resample, form)(rows, 20))
    monkeypatch.setattr(resample, "TOGETHER", 10)
    assert near == key(getattr(resample, form)(rows, 20)) and len(near) >= 20


def test_counted_draws_are_the_drawn_rows(spark):
    """counts by block equal the table of draws."""
    rows = matched(spark)
    table = resample.draws(rows, "pair_id", 15).join(rows, "pair_id").groupBy("replicate").agg(F.sum(F.col("m") * F.col("base_error")).alias("b"), F.sum(F.col("m") * F.col("error")).alias("e"))
    want = {r["replicate"]: (r["b"] - r["e"]) / r["b"] for r in table.collect()}
    assert {r["replicate"]: r["gain"] for r in resample.row_gain(rows, 15, "pair_id").collect()} == pytest.approx(want)
    units = resample._indexed(rows.select("pair_id"), "idx", [], "pair_id")
    got = {(k, r["pair_id"]): int(m) for r in replicates.drawn_vectors(units, "pair_id", 15, resample.SEED, 64).collect() for k, m in enumerate(np.frombuffer(r["ms"], "<i4")) if m}
    assert got == {(r["replicate"], r["pair_id"]): r["m"] for r in resample.draws(rows, "pair_id", 15).collect()}
    plan = resample.row_gain(rows, 15, "pair_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan


def test_numbers_of_c_pairs_need_no_sort_of_pairs(spark):
    """the numbers are those of the sorted pairs, a subject's pairs come from many parts, and a condition's pairs from its items."""
    items = some_items(spark, 50)
    c = pairs.same_subject_across(items)
    want = pairs.pair_ids(c, "group", ["item_l", "item_r"]).select("pair_id", "item_l", "item_r")
    assert sorted(pairs.numbered_across(items).collect()) == sorted(want.collect()) and c.count() > 50
    inside = pairs.same_subject_across(items, ("condition",))
    key = lambda f: sorted((r["item_l"], r["item_r"]) for r in f.collect())
    assert key(inside) == key(c.where("condition_l = condition_r"))
    assert "__part" in c._jdf.queryExecution().optimizedPlan().toString()
    named = c.select("item_l", "item_r", F.col("subject").alias("subject_l"), F.col("subject").alias("subject_r"))
    assert {r["kind"]: r["shared"] for r in audits.leakage(named, named.where("item_l < 20")).collect()}["pair"] == c.where("item_l < 20").count()


def test_nearest_sites_are_not_sorted(spark):
    """one row a place, plain minima; ties go to the least site."""
    points = spark.createDataFrame([(i, i % 2, float(i % 5), float(i % 3)) for i in range(40)], "point long, area long, lon double, lat double")
    sites = spark.createDataFrame([(i, i % 2, float(i % 4), float(i % 3)) for i in range(30)], "site long, area long, lon double, lat double")
    s = sites.select("area", "site", F.col("lon").alias("slon"), F.col("lat").alias("slat"))
    km = scalars.haversine_km(F.col("lon"), F.col("lat"), F.col("slon"), F.col("slat"))
    want = points.join(s, "area").groupBy("point", "area").agg(F.min(F.struct(km.alias("km"), "site")).alias("b")).select("point", "area", "b.site", "b.km")
    got = matrices.nearest(points, sites)
    assert sorted(got.collect()) == sorted(want.collect())
    assert "struct(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_replicates_weigh_no_more_cells_than_their_sums_need(spark, monkeypatch):
    """each weighting adds up its cells by its keys and subject pair before any replicate; a pair counts the same either way round."""
    seen, keep = [], replicates.weighed
    monkeypatch.setattr(resample.vectors, "weighed", lambda rows, *a: (seen.append(rows.count()), keep(rows, *a))[1])
    rng = random.Random(4)
    made = [(str(k % 40), a, b, rng.randrange(6), rng.randrange(6), rng.random(), rng.random()) for k in range(800) for a, b in [(rng.randrange(4), rng.randrange(4))]]
    shape = "stratum string, subject_l long, subject_r long, category_l long, category_r long, base_error double, error double"
    key = lambda rows: {(r["replicate"], r["weighting"]): r["gain"] for r in resample.weighted_gains(spark.createDataFrame(rows, shape), 20).collect()}
    got = key(made)
    pairs_, relations = {tuple(sorted(r[1:3])) for r in made}, {(tuple(sorted(r[1:3])), tuple(sorted(r[3:5]))) for r in made}
    assert seen[:2] == [len(pairs_), len(relations)] and len(seen) == 4 and max(seen) < len(made)
    assert got == pytest.approx(key([(s, b, a, d, c, x, y) for s, a, b, c, d, x, y in made])) and len(got) == 80
