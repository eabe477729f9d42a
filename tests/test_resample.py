"""Draws of groups are independent, and all replicates at once equal one replicate after the other."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.functions.ordering import lower_weighted_median
from pairlens.operators import replicates, resample

ROWS = "stratum string, arm string, item_l long, item_r long, subject_l long, subject_r long, distance double, category string"


def some_rows(spark, n=400, subjects=17, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        s, arm, left = rng.choice("xyz"), rng.choice("AB"), rng.randrange(subjects)
        right = left if arm == "A" else rng.choice([i for i in range(subjects) if i != left])
        out.append((s, arm, 2 * k, 2 * k + 1, left, right, round(rng.gauss(1 if arm == "B" else 0, 1) + left / 10, 1), s))
    return out, spark.createDataFrame(out, ROWS)


def test_equal_groups_draw_apart(spark):
    units = spark.createDataFrame([(g, i) for g in ("a", "b") for i in range(17)], "g string, subject long")
    m = {(r["g"], r["replicate"], r["subject"]): r["m"] for r in resample.draws(units, "subject", 400, within=["g"]).collect()}
    a, b = (np.array([[m.get((g, r, i), 0) for i in range(17)] for r in range(400)]) for g in "ab")
    assert (a.sum(1) == 17).all() and (b.sum(1) == 17).all() and (a != b).mean() > 0.4
    assert abs(np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 0.05 and abs(a.var() - 16 / 17) < 0.1


def test_slope_deviation_is_that_of_independent_draws(spark):
    rng = np.random.default_rng(5)
    qs, effects = (0.0, 0.25, 0.5, 1.0), {i: rng.normal() for i in range(17)}
    rows = spark.createDataFrame([(mode, q, i, float(effects[i] * f)) for mode, f in (("ordinary", 1.0), ("balanced", 0.5)) for q in qs for i in effects], "mode string, q double, subject long, gain double")
    got = np.std([r["contrast"] for r in resample.slope_bootstrap(rows, 800).collect()], ddof=1)
    x = np.array(list(effects.values()))
    means = np.array([[x[rng.integers(0, 17, 17)].mean() for _ in qs] for _ in range(4000)])
    q = np.array(qs) - np.mean(qs)
    assert got == pytest.approx(np.std(0.5 * means @ q / (q @ q), ddof=1), rel=0.1)


@pytest.mark.parametrize("small", [0, 1 << 30])
def test_medians_of_all_replicates(spark, monkeypatch, small):
    """Broadcast or shuffled vectors, groups over several parts, ties: the same medians as one window a replicate."""
    monkeypatch.setattr(replicates, "SMALL", small)
    monkeypatch.setattr(replicates, "_CHUNK", 7)
    _, rows = some_rows(spark)
    drawn = resample.draws(rows.select(F.explode(F.array("subject_l", "subject_r")).alias("subject")), "subject", 50)
    got = {(r["stratum"], r["arm"], r["replicate"]): r["median"] for r in replicates.medians(resample.dyadic_weights(rows, drawn, 50), ["stratum", "arm"], "distance").collect()}
    want = lower_weighted_median(resample.pair_weights(rows, drawn), ["stratum", "arm", "replicate"], "distance", "m").collect()
    assert got == {(r["stratum"], r["arm"], r["replicate"]): r["median"] for r in want} and len(got) > 250


def test_support_of_all_replicates(spark):
    out, rows = some_rows(spark, 120, 6)
    drawn = resample.draws(rows.select(F.explode(F.array("subject_l", "subject_r")).alias("subject")), "subject", 30)
    m = {(r["replicate"], r["subject"]): r["m"] for r in drawn.collect()}
    got = {r["replicate"]: r for r in resample.support_bootstrap(rows, 30).collect()}
    for r in range(30):
        sums, weights = defaultdict(float), defaultdict(float)
        for s in "xyz":
            kept = {}
            for arm in "AB":
                ws = [(d, m.get((r, a), 0) * (1 if a == b else m.get((r, b), 0)), a, b) for st, ar, _, _, a, b, d, _ in out if (st, ar) == (s, arm)]
                ws = sorted(w for w in ws if w[1])
                if ws:
                    k = defaultdict(int)
                    for _, w, a, b in ws:
                        for x in {a, b}:
                            k[x] += w
                    run, total, med = 0, sum(w[1] for w in ws), None
                    for d, w, *_ in ws:
                        run += w
                        if 2 * run >= total:
                            med = d
                            break
                    kept[arm] = (total, len(k), sum(k.values()) ** 2 / sum(v * v for v in k.values()), med)
            if len(kept) == 2:
                for j, name in enumerate(("by_pairs", "by_subjects", "by_ess")):
                    w = kept["A"][j] * kept["B"][j] / (kept["A"][j] + kept["B"][j])
                    sums[name] += w * (kept["B"][3] - kept["A"][3])
                    weights[name] += w
        for name in sums:
            assert got[r][name] == pytest.approx(sums[name] / weights[name])


def simulated(out, kind, n=1500):
    """Replicates of the rule in memory, with NumPy's own draws."""
    rng = np.random.default_rng(3)
    held = defaultdict(lambda: defaultdict(lambda: {"A": [], "B": []}))
    for s, arm, _, _, a, b, d, _ in out:
        for x in {a, b}:
            held[s][x][arm].append(d)
    pick = lambda xs: [xs[i] for i in rng.integers(0, len(xs), len(xs))]
    got = []
    for _ in range(n):
        if kind == "nested":
            effects = []
            for subjects in held.values():
                med = {}
                for arm in "AB":
                    have = [v[arm] for v in subjects.values() if v[arm]]
                    med[arm] = np.median([d for rows in pick(have) for d in pick(rows)])
                effects.append(med["B"] - med["A"])
            got.append(np.median(effects))
        elif kind == "hierarchical":
            usable = [[v for v in subjects.values() if v["A"] and v["B"]] for subjects in held.values()]
            got.append(np.mean([np.mean(pick(v["B"])) - np.mean(pick(v["A"])) for c in pick(usable) for v in pick(c)]))
        else:
            flat = {s: {arm: [x[6] for x in out if x[:2] == (s, arm)] for arm in "AB"} for s in "xyz"}
            got.append(np.mean([np.mean(pick(v["B"])) - np.mean(pick(v["A"])) for v in pick(list(flat.values()))]))
    return np.mean(got), np.std(got)


@pytest.mark.parametrize(("kind", "run"), [("nested", resample.nested_cluster), ("hierarchical", resample.hierarchical), ("stratified", resample.stratified_mean)])
def test_nested_draws_have_the_simulated_deviation(spark, kind, run):
    out, rows = some_rows(spark, 240, 9)
    got = [r["estimate"] for r in run(rows, 800).collect()]
    mean, sd = simulated(out, kind)
    assert np.mean(got) == pytest.approx(mean, abs=4 * sd / 28) and np.std(got) == pytest.approx(sd, rel=0.12)


@pytest.mark.parametrize("run", [resample.hierarchical, resample.stratified_mean, lambda rows, n: resample.clustered_delta(rows.withColumn("delta", F.col("distance")), n).withColumnRenamed("delta", "estimate")])
def test_large_clusters_are_drawn_alike(spark, monkeypatch, run):
    _, rows = some_rows(spark, 150, 7)
    monkeypatch.setattr(resample, "_TURN", 7)
    want = {r["replicate"]: r["estimate"] for r in run(rows, 20).collect()}
    monkeypatch.setattr(resample, "TOGETHER", 6)
    assert {r["replicate"]: r["estimate"] for r in run(rows, 20).collect()} == pytest.approx(want)


def test_rows_of_drawn_subjects_are_drawn_again(spark):
    """One subject in one stratum: without inner draws the replicates would all be equal."""
    rows = spark.createDataFrame([("s", i, i, 1, 1, float(i)) for i in range(20)], "stratum string, item_l long, item_r long, subject_l long, subject_r long, delta double")
    got = [r["delta"] for r in resample.clustered_delta(rows, 600).where("replicate >= 0").collect()]
    assert np.std(got) == pytest.approx(np.arange(20).std() / np.sqrt(20), rel=0.15)


def test_too_few_permutations_are_refused(spark):
    effects = spark.createDataFrame([("s", 1, 0.5)], "stratum string, subject long, effect double")
    with pytest.raises(ValueError):
        resample.cluster_sign_flip(effects, 999)
