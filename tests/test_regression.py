"""Fits from sums equal dense fits, downdated folds equal refits, and the parts do what they say."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.operators import regression


def table(spark, seed=1, subjects=14, dim=5, proxy=3):
    rng = np.random.default_rng(seed)
    mix, cat = rng.normal(size=(proxy, dim)), rng.normal(size=(3, dim))
    v, u, s = rng.normal(size=proxy), rng.normal(size=dim), np.array([2.0, -1.0, 0.5])
    rows = []
    for k in range(260):
        who, c = int(rng.integers(subjects)), int(rng.integers(3))
        base = np.random.default_rng(100 + who).normal(size=proxy)
        x = base + 0.1 * rng.normal(size=proxy)
        y = base @ mix + cat[c] + s[c] * (base @ v) * u + 0.1 * rng.normal(size=dim)
        rows.append((k, who, c, [float(a) for a in y], [float(a) for a in x]))
    return spark.createDataFrame(rows, "item long, subject long, category long, vec array<double>, proxy array<double>")


def dense(made, penalty, alphas):
    """The same fit with whole matrices: standardised centroid and one-hot categories, folds refitted."""
    x, y, c, f = (np.array([r[k] for r in made]) for k in ("x", "y", "category", "fold"))
    for k in np.unique(c):
        y[c == k] -= y[c == k].mean(0)
    hot = lambda rows: (c[rows][:, None] == np.unique(c)[None]).astype(float)

    def solve(on, alpha):
        mu, sd = x[on].mean(0), x[on].std(0)
        d = np.hstack([(x[on] - mu) / sd, hot(on)])
        p = np.diag([penalty["centroid"]] * x.shape[1] + [penalty["category"]] * 3)
        return mu, sd, np.linalg.solve(d.T @ d + alpha * p, d.T @ y[on])

    def error(alpha):
        out = []
        for k in np.unique(f):
            mu, sd, beta = solve(f != k, alpha)
            out.append((((np.hstack([(x[f == k] - mu) / sd, hot(f == k)]) @ beta) - y[f == k]) ** 2).mean())
        return np.mean(out)

    alpha = min((error(a), a) for a in alphas)[1]
    mu, sd, beta = solve(np.ones(len(x), bool), alpha)
    design = np.hstack([(x - mu) / sd, hot(np.ones(len(x), bool))])
    return alpha, beta, design, y, y - design @ beta


@pytest.mark.parametrize("penalty", [{"centroid": 1.0, "category": 1.0, "rank_one": 1.0}, regression.BLOCK_PENALTIES])
def test_fits_from_sums_equal_dense_fits(spark, penalty):
    items = table(spark).repartition(5)
    made = regression.cells(items, regression.centroids(items))
    rows = made.collect()
    got = regression.fit(regression.blocks(made), (0.01, 0.1, 1.0, 10.0, 100.0), penalty, rank_one=True)
    alpha, beta, design, y, rest = dense(rows, penalty, (0.01, 0.1, 1.0, 10.0, 100.0))
    assert got.alpha == alpha and np.allclose(got.weights, beta[:3]) and all(np.allclose(got.bias[k], beta[3 + k]) for k in range(3))
    # The rank-one term is worth as much on whole rows as the sums say.
    z, cat = design[:, :3], [r["category"] for r in rows]
    term = np.outer((z @ got.v) * np.array([got.strength[c] for c in cat]), got.u)
    spread = ((y - y.mean(0)) ** 2).sum()
    assert got.r2 == pytest.approx(1 - ((rest - term) ** 2).sum() / spread)
    assert ((rest - term) ** 2).sum() < 0.5 * (rest**2).sum()
    assert np.allclose(got.anchor, got.component(np.array([r["x"] for r in rows]), cat).mean(0))


def test_applying_a_fit(spark):
    items = table(spark)
    centred = regression.centroids(items)
    fitted = regression.fit(regression.blocks(regression.cells(items, centred)), rank_one=True)
    x = {r["subject"]: np.array(r["x"]) for r in centred.collect()}
    before = {r["item"]: r for r in items.collect()}
    for r in regression.cleaned(items, centred, fitted).collect():
        b = before[r["item"]]
        assert np.allclose(r["vec"], np.array(b["vec"]) - fitted.component(x[b["subject"]][None], [b["category"]])[0] + fitted.anchor)
    assert fitted.with_bias_of_the_next().bias[2] is fitted.bias[0] and fitted.with_strength_of_the_next().strength[0] == fitted.strength[1]
    with pytest.raises(ValueError):
        fitted.component(np.zeros((1, 3)), ["unknown"])


def test_leave_pair_out_uses_the_other_items(spark):
    items = table(spark, subjects=40)
    centred = regression.centroids(items)
    fitted = regression.fit(regression.blocks(regression.cells(items, centred)), rank_one=True)
    rows = {r["item"]: r for r in items.collect()}
    rng = random.Random(2)
    pairs = [(a, b) for a, b in (sorted(rng.sample(range(260), 2)) for _ in range(60))] + [tuple(sorted(i for i in rows if rows[i]["subject"] == s)[:2]) for s in range(10)]
    got = regression.leave_pair_out(spark.createDataFrame(pairs, "item_l long, item_r long"), items, centred, fitted).collect()
    assert len(got) == len(pairs)
    for r in got:
        vs, short = [], 0
        for me in (r["item_l"], r["item_r"]):
            who = rows[me]["subject"]
            rest = [rows[i]["proxy"] for i in rows if rows[i]["subject"] == who and i not in (r["item_l"], r["item_r"])]
            short += not rest
            x = np.mean(rest or [rows[i]["proxy"] for i in rows if rows[i]["subject"] == who], axis=0)
            vs.append(np.array(rows[me]["vec"]) - fitted.component(x[None], [rows[me]["category"]])[0] + fitted.anchor)
        assert r["distance"] == pytest.approx(1 - vs[0] @ vs[1] / np.linalg.norm(vs[0]) / np.linalg.norm(vs[1])) and r["fallbacks"] == short


def test_shuffled_centroids(spark):
    centred = regression.centroids(table(spark, subjects=9))
    own = {r["subject"]: r["x"] for r in centred.collect()}
    for wrong in (False, True):
        dealt = {r["subject"]: r["x"] for r in regression.shuffled(centred, 5, wrong).collect()}
        assert sorted(dealt.values()) == sorted(own.values()) and dealt != own
        assert not wrong or all(dealt[s] != own[s] for s in own)


def test_nothing_to_explain(spark):
    items = table(spark, subjects=4).withColumn("vec", F.transform("vec", lambda _: F.lit(1.0)))
    got = regression.fit(regression.blocks(regression.cells(items, regression.centroids(items))), rank_one=True)
    assert np.allclose(got.weights, 0) and np.allclose(got.anchor, 0) and got.r2 == 0
