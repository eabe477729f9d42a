"""The corrections of a whole report: pairs are made once, and nothing of a pair is joined or sent to all."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pairlens.operators import regression, scoring
from pairlens.plans import catalogue, reports
from pairlens.sources import items as src


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Tables of 250 items whose vectors follow their subject's second view."""
    rng, path = random.Random(5), tmp_path_factory.mktemp("small")
    views = {s: [rng.gauss(0, 1) for _ in range(3)] for s in range(25)}
    loads = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(3)]
    con = duckdb.connect()
    con.execute("CREATE TABLE e (vec_id BIGINT, label INTEGER, embedding FLOAT[])")
    con.execute("CREATE TABLE o (o_orderkey BIGINT, o_totalprice DOUBLE)")
    con.execute("CREATE TABLE l (l_orderkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_linenumber INTEGER)")
    far = [[rng.gauss(0, 3) for _ in range(64)] for _ in range(5)]
    for i in range(0, 250, 2):
        s, label = i % 25, rng.randrange(6)
        vec = [sum(v * w[d] for v, w in zip(views[s], loads, strict=True)) * (1 + label / 5) + far[label // 2][d] + rng.gauss(0, 0.5) for d in range(64)]
        con.execute("INSERT INTO e VALUES (?, ?, ?)", [i, label, vec])
        if i not in (50, 60):
            con.execute("INSERT INTO o VALUES (?, ?)", [i, 5e5 * views[s][0]])
            con.execute("INSERT INTO l VALUES (?, ?, ?, ?, ?, ?)", [i, 50 * (views[s][1] + rng.gauss(0, 0.1)), 1e5 * views[s][2], 0.1 * rng.random(), 0.05, 1])
    for t, name in (("e", "embeddings"), ("o", "orders"), ("l", "lineitem")):
        con.execute(f"COPY {t} TO '{path}/{name}.parquet'")
    return str(path)


def test_corrections_are_those_of_joined_pairs(spark, small, monkeypatch):
    """the same errors as by joins of every pair with each distance; the pairs are made by two joins of items, and no pair takes part in another."""
    plans = []
    monkeypatch.setattr(reports, "settled", lambda f, keep=reports.settled: (plans.append(f._jdf.queryExecution().optimizedPlan().toString()), keep(f))[1])
    made = []
    monkeypatch.setattr(reports, "_forms", lambda *a, keep=reports._forms: (made.append(keep(*a)), made[-1])[1])
    rows, best = reports._corrections(spark, small, (5,))
    assert sum("Join" in line for line in plans[-1].split("\n")) == 2
    got = {(r["item_l"], r["item_r"]): r for r in rows.collect()}
    forms = made[0][1]
    items = src.proxy_items(spark, small).cache()
    drawn = catalogue.all_pairs(spark, small).select("item_l", "item_r", "split", "target", "grp", "distance").cache()
    parts = {s: items.where(F.col("split") == s) for s in ("calibration", "evaluation")}
    centred = {s: regression.centroids(p) for s, p in parts.items()}

    def fitted_errors(distance, fit=None):
        both = drawn.drop("distance").join(distance.select("item_l", "item_r", "distance"), ["item_l", "item_r"])
        fit = fit or scoring.affine(both.where("split = 'calibration'"), "distance", "target", clamped=True)
        return fit, {(r["item_l"], r["item_r"]): r["error"] for r in scoring.scored(both.where("split = 'evaluation'"), fit).collect()}

    _, want = fitted_errors(drawn)
    assert len(got) > 1000 and set(got) < set(want) and {r["grp"] for r in got.values()} == set("ABCD")
    assert {k: r["base_error"] for k, r in got.items()} == pytest.approx({k: want[k] for k in got})
    spread = set()
    for name in ("error", "rival", "bias_swap", "swapped"):
        clean = [regression.cleaned(parts[s], centred[s], forms[name][0]).select("item", "vec", "norm") for s in parts]
        fit, want = fitted_errors(scoring.distances(drawn.select("item_l", "item_r"), clean[0].unionByName(clean[1]), "distinct"))
        assert {k: r[name] for k, r in got.items()} == pytest.approx(want)
        spread.add(round(sum(want.values()), 6))
        if name == "error":
            apart = regression.leave_pair_out(drawn.where("split = 'evaluation'").select("item_l", "item_r"), parts["evaluation"], centred["evaluation"], best)
            _, left = fitted_errors(apart, fit)
            assert {k: r["left_out"] for k, r in got.items()} == pytest.approx(left) and left != pytest.approx(want)
            assert {k: r["fallbacks"] for k, r in got.items()} == {(r["item_l"], r["item_r"]): r["fallbacks"] for r in apart.collect()}
    assert len(spread) == 4 and "shuffled_0" in rows.columns and "wrong_0" in rows.columns
