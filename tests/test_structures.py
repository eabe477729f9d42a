"""Digest trees, walks of JSON, task records, two-way terms and block power iteration."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.operators import corrections, inventory, pools, scoring, validate
from pairlens.sources import items as src


def ids(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "u long")


def plain_root(xs):
    groups = {}
    for x in sorted(set(xs)):
        groups.setdefault(x >> 8, []).append(str(x))
    nodes = {b: hashlib.sha256(",".join(v).encode()).hexdigest() for b, v in groups.items()}
    for k in range(inventory.LEVELS + 1):
        up = {}
        for b in sorted(nodes):
            up.setdefault(b >> 8 if k < inventory.LEVELS else 0, []).append(f"{b}:{nodes[b]}")
        nodes = {b: hashlib.sha256(",".join(v).encode()).hexdigest() for b, v in up.items()}
    return nodes[0]


def test_equal_sets_have_equal_roots(spark):
    rng = random.Random(1)
    xs = [rng.randrange(-(2**63), 2**63) for _ in range(50)] + list(range(1000)) + [0, 0, None]
    want = plain_root([x for x in xs if x is not None])
    for parts in (1, 7):
        got = inventory.roots(inventory.leaves(ids(spark, xs).repartition(parts), "u")).first()
        assert got["digest"] == want and got["n"] == len({x for x in xs if x is not None})
    assert inventory.roots(inventory.leaves(ids(spark, []), "u")).count() == 0


def test_nested_inventories_and_their_edges(spark):
    xs = sorted(random.Random(2).sample(range(5000), 901))
    got = {r["fraction"]: r for r in inventory.inventories(ids(spark, [*xs, xs[0]]), "u", (0.25, 0.5, 1.0, 2.0)).collect()}
    for f, n in ((0.25, 225), (0.5, 450), (1.0, 901), (2.0, 901)):
        assert got[f]["n"] == n and got[f]["digest"] == plain_root(xs[:n])


def test_the_first_difference(spark):
    xs = set(range(0, 3000, 3))
    a = ids(spark, xs)
    assert inventory.first_difference(a, ids(spark, xs).repartition(5), "u") is None
    assert inventory.first_difference(a, ids(spark, xs | {1501, 2**40}), "u") == 1501
    assert inventory.first_difference(ids(spark, xs - {600, 2400}), a, "u") == 600
    assert inventory.first_difference(ids(spark, []), ids(spark, [-5]), "u") == -5


def test_json_nodes_at_any_depth(spark):
    deep = {"x": 1}
    for _ in range(30):
        deep = {"a": [deep, "t"]}
    texts = [json.dumps(deep), '{"a": {"b": null, "c": "é"}, "0": [1.5, true]}', "[]", "no json", None, '"bare"']
    want = set()

    def walk(i, value, path):
        items_ = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        for k, v in items_:
            want.add((i, f"{path}/{k}", k if isinstance(value, dict) else None, v if isinstance(v, str) else None))
            walk(i, v, f"{path}/{k}")

    for i, t in enumerate(texts):
        if t and t != "no json":
            walk(i, json.loads(t), "")
    got = validate.json_nodes(spark.createDataFrame(list(enumerate(texts)), "id int, j string"), ["id"], "j").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert validate.json_nodes(spark.createDataFrame([], "id int, j string"), ["id"], "j").count() == 0


def test_manifest_identity(spark):
    h, other = hashlib.sha256(b"x").hexdigest(), hashlib.sha256(b"y").hexdigest()
    rows = [{"a": [{"manifest_sha256": h.upper()}]}, {"pair_manifest_sha256": other, "n": {"projection_manifest_sha256": other}}, {"bootstrap": {"resampling_unit": "s within matched_stratum"}}, {"manifest_sha256": "short"}]
    frame = spark.createDataFrame([(i, json.dumps(r), h) for i, r in enumerate(rows)], "id int, j string, e string")
    got = {r["id"]: (r["status"], r["reason"], r["n_hashes"], r["locations"]) for r in validate.manifest_identity(frame, ["id"], "j", "e").collect()}
    assert got == {0: ("verified", "expected_hash_recorded", 1, ["/a/0/manifest_sha256"]), 1: ("invalidated", "hash_mismatch", 2, []), 2: ("invalidated", "stratum_origin_missing", 0, []), 3: ("invalidated", "hash_missing", 0, [])}


def test_task_records(spark):
    kv = lambda **x: spark.createDataFrame(list(x.items()), "key string, value string")
    files = kv(u1="a/phase1/u1.wav", u2="a/phase2/u2.wav")
    early, late = kv(u1="read", u2="x"), kv(u2="car")
    rows = src.task_records(files, kv(u1="s1", u2="s2", u3="s3"), kv(u1="d1", u2="d2"), early, late, kv(u1="Ｈi  there", u2="Hi there"))
    got = {r["item"]: r for r in src.corpus({"t": (rows, "train")}).collect()}
    assert got["u1"]["condition"] == "read" and got["u2"]["condition"] == "car" and got["u1"]["content"] == got["u2"]["content"]
    for bad, what in (((kv(u1="s1"), kv(u1="d1", u2="d2"), early, late), "u2 has no subject"), ((kv(u1="s1", u2=" "), kv(u1="d1", u2="d2"), early, late), "u2 has no subject"), ((kv(u1="s1", u2="s2"), kv(u1="d1", u2="d2"), early, kv(u1="car")), "u2 has no condition"), ((kv(u1="s1", u2="s2"), kv(u1="d", u2="d"), early, late, kv(u1="t")), "u2 has no transcript")):
        with pytest.raises(validate.Rejected, match=what):
            src.task_records(files, *bad)


def test_two_way_terms_and_f(spark):
    """Unbalanced labels, some cells empty: the same F as a dense dummy design."""
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(6)), int(a), int(b)) for a in range(5) for b in range(4) if (a + b) % 5 for _ in range(int(rng.integers(1, 9)))]
    z = rng.normal(size=(len(rows), 3)) + np.array([[s, a * b, b] for s, a, b in rows])
    t = spark.createDataFrame([(*r, [float(x) for x in v]) for r, v in zip(rows, z, strict=True)], "subject long, category long, condition long, z array<double>")
    design = np.column_stack([np.ones(len(rows)), *[[r[1] == a for r in rows] for a in range(1, 5)], *[[r[2] == b for r in rows] for b in range(1, 4)]]).astype(float)
    rest = z - design @ np.linalg.lstsq(design, z, rcond=None)[0]
    subject = np.array([r[0] for r in rows])
    means = np.array([rest[subject == s].mean(0) for s in range(6)])
    n = np.array([(subject == s).sum() for s in range(6)])
    between = (n[:, None] * (means - rest.mean(0)) ** 2).sum(0) / 5
    inside = ((rest - means[subject]) ** 2).sum(0) / (len(rows) - 6)
    got = [corrections.f_of(r) for r in corrections.f_sums(t, ("category", "condition")).orderBy("k").collect()]
    assert got == pytest.approx(list(between / inside), rel=1e-6)
    assert corrections.f_of({"g": 1, "b": 1.0, "s": 1.0, "n": 1, "q": 1.0}) == 0


@pytest.mark.parametrize("tasks", [1, 6])
def test_block_power_iteration(spark, tasks):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 20)) * np.linspace(3, 1, 20) + 7
    t = spark.createDataFrame([([float(v) for v in r],) for r in x], "vec array<double>").repartition(tasks)
    mean, dirs = corrections.principal_directions(t, 4, tol=1e-13, rounds=300)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    top = vectors[:, ::-1][:, :4].T
    assert np.allclose(mean, x.mean(0)) and np.allclose(np.abs((dirs * top).sum(1)), 1, atol=1e-5)
    n, m, cov = corrections.covariance(t)
    assert n == 300 and np.allclose(m, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    assert np.allclose(corrections.principal_directions(t, 50)[1] @ corrections.principal_directions(t, 50)[1].T, np.eye(20))


def test_identity_and_pairing(spark):
    m = spark.createDataFrame([("a", 1, 2, "x"), ("b", 3, 4, "y")], "pair_id string, item_l long, item_r long, stratum string")
    rows = spark.createDataFrame([("a", 1, 2, 0.5), ("b", 3, 4, 0.7)], "pair_id string, item_l long, item_r long, error double")
    assert {r["pair_id"]: r["stratum"] for r in scoring.with_identity(rows, m).collect()} == {"a": "x", "b": "y"}
    for bad in (rows.withColumn("item_r", F.lit(9)), rows.withColumn("pair_id", F.lit("z"))):
        with pytest.raises(validate.Rejected):
            scoring.with_identity(bad, m)
    with pytest.raises(validate.Rejected):
        scoring.with_identity(rows, m.unionByName(m))
    assert [round(r["delta"], 6) for r in scoring.paired(rows, rows.withColumn("error", F.lit(0.2))).orderBy("pair_id").collect()] == [0.3, 0.5]
    for other in (rows.limit(1), rows.unionByName(rows)):
        with pytest.raises(validate.Rejected):
            scoring.paired(rows, other)
    assert scoring.available(m, spark.createDataFrame([(1,), (2,), (2,), (3,)], "item long")).count() == 1


def test_shares_of_the_gradient(spark):
    got = pools.budget(spark.createDataFrame([(100, 30, 2.0, 1.0)], "pair long, cross long, pair_norm double, cross_norm double"), (0.25, 1.0), (0.0, 2.0)).collect()
    r = {(x["ratio"], x["strength"]): x for x in got}
    assert r[0.25, 2.0]["cross_drawn"] == 25 and r[1.0, 2.0]["cross_drawn"] == 30
    assert r[1.0, 2.0]["eta_separate"] == 0.5 and r[1.0, 2.0]["eta_mixed"] == pytest.approx(60 / 260) and r[1.0, 0.0]["eta_mixed"] == 0
    none = pools.budget(spark.createDataFrame([(0, 0)], "pair long, cross long"), (1.0,), (0.0,)).first()
    assert none["eta_mixed"] == 0
