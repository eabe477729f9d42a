"""Gates, manifest audits and pair rules on small tables with known answers."""

from pyspark.sql import functions as F

from pairlens.operators import audits, gates, pairs, validate


def row(frame):
    return frame.first().asDict()


def test_pair_violations(spark):
    items = spark.createDataFrame([(1, "calibration"), (2, "calibration"), (3, "evaluation")], "item long, split string")
    rows = [("a", [1, 2]), ("b", [1, 3]), ("b", [2, 1]), ("c", [1]), ("d", None), ("e", [2, 2]), ("f", [1, 9])]
    got = {r["rule"]: r["n"] for r in validate.pair_violations(spark.createDataFrame(rows, "pair_id string, ends array<long>"), items).collect()}
    assert got == {"not_two_ends": 2, "self_pair": 1, "unknown_end": 1, "two_splits": 1, "duplicate_id": 1, "duplicate_ends": 1}
    none = spark.createDataFrame([], "pair_id string, ends array<long>")
    assert all(r["n"] == 0 for r in validate.pair_violations(none, items).collect())


def test_corpus_audit(spark):
    items = spark.createDataFrame([(i, i % 3, i % 2) for i in range(12)], "item long, subject long, category long")
    got = row(audits.corpus(items, usable=True, redistributable=True, minimum_categories=2, minimum_pairs=1))
    # Six cells of two items: 6 pairs of A, 2 * C(6, 2) - 6 of B, 3 * C(4, 2) - 6 of C, the rest of C(12, 2) are D.
    assert (got["a"], got["b"], got["c"], got["d"]) == (6, 24, 12, 24) and got["passed"] and got["licence"] == "permitted"
    got = row(audits.corpus(items, usable=False, redistributable=True))
    assert got["failed"] == ["category_count", "pair_capacity", "usable_for_research"] and got["licence"] == "pending_audit" and not got["passed"]


def test_manifest_groups_and_strata(spark):
    cols = "group string, item_l long, item_r long, subject_l long, subject_r long, category_l string, category_r string, condition_l string, condition_r string"
    p = spark.createDataFrame([("A", 1, 2, 1, 1, "x", "y", "q", "q"), ("A", 3, 1, 2, 1, "y", "x", "q", "p"), ("B", 3, 4, 2, 2, "x", "x", "p", "p")], cols)
    got = {r["group"]: r.asDict() for r in audits.manifest_groups(p, ["group"]).collect()}
    assert (got["A"]["pairs"], got["A"]["items"], got["A"]["reused"], got["A"]["category_relations"], got["A"]["condition_relations"]) == (2, 3, 1, 1, 2)
    keys = [r[0] for r in p.orderBy("group", "item_l").select(pairs.symmetric_stratum()).collect()]
    assert keys == ["A|x::y|q", "A|x::y|p::q", "B|x|p"]
    assert row(audits.shared_across(p, "group"))["shared"] == 1


def test_weighting_gate(spark):
    rows = [(r, w, 0.1) for r in ("a", "b") for w in gates.WEIGHTINGS]
    status = lambda x: row(gates.weighting(spark.createDataFrame(x, "reference string, weighting string, lower double"), 2))["status"]
    assert status(rows) == "passed"
    assert status([*rows[:-1], ("b", "stratum", -0.1)]) == "narrowed"
    assert status(rows[:-1]) == "incomplete" and status([]) == "incomplete"
    assert status([*rows[:-1], ("b", "stratum", None)]) == "incomplete"


def test_ordering_gate(spark):
    rows = [("a", m, 0.1, 0.2) for m in gates.ORDERING] + [("a", "mae", -0.2, -0.1)]
    of = lambda x: row(gates.ordering(gates.practical(spark.createDataFrame(x, "reference string, metric string, lower double, upper double"))))
    assert of(rows) == {"better_ordering_allowed": True, "lower_error_of_other": True, "status": "passed"}
    assert of([*rows[:2], ("a", "order_accuracy", -0.1, 0.2), ("a", "mae", -0.1, 0.1)]) == {"better_ordering_allowed": False, "lower_error_of_other": False, "status": "narrowed"}
    assert of(rows[1:])["status"] == "narrowed"  # a metric is missing


def test_dependency_gate(spark):
    audit = spark.createDataFrame([(9, 3, 0, 0)], "items long, shared long, not_nested_subject long, not_nested_category long")
    within = lambda n: spark.createDataFrame([("A", n), ("B", 0)], "arm string, reused long")
    models = lambda e: spark.createDataFrame([("m", 0.2, 0.1), ("n", e, -0.1)], "model string, estimate double, lower double")
    got = row(gates.dependency(audit, within(0), models(0.1), 3))
    assert got["passed"] and got["shared_as_declared"] and not got["lower_bounds_positive"]
    assert not row(gates.dependency(audit, within(1), models(0.1)))["passed"]
    assert not row(gates.dependency(audit, within(0), models(-0.1)))["passed"]
    assert not row(gates.dependency(audit.withColumn("not_nested_subject", F.lit(1)), within(0), models(0.1)))["passed"]


def test_manifest_gate(spark):
    groups = spark.createDataFrame([("A", 5, 0), ("B", 4, 0)], "group string, pairs long, reused long")
    shared = lambda n: spark.createDataFrame([("subject", n), ("item", 7)], "kind string, shared long")
    none = spark.createDataFrame([], "pair_id string")
    assert row(gates.manifest(groups, groups, shared(0), none))["passed"]
    assert not row(gates.manifest(groups, groups.where("group = 'A'"), shared(0), none))["counts_as_declared"]
    assert not row(gates.manifest(groups, groups, shared(1), none))["subjects_disjoint"]
    assert not row(gates.manifest(groups, groups, shared(0), spark.createDataFrame([("A-1",)], "pair_id string")))["ids_unique"]


def test_variant_gate(spark):
    def of(pair):
        rows = [("v", s, w, pair[s] if w == "pair" else 0.1) for s in range(5) for w in ("pair", "endpoint_subject", "category_relation")]
        return gates.variants(spark.createDataFrame(rows, "variant string, seed long, weighting string, gain double"))

    good = of([0.1, 0.1, 0.2, 0.3, -0.1])
    assert row(good)["stable"] and not row(good)["stratum_available"] and row(gates.stability(good))["status"] == "reference_stable"
    bad = row(of([0.1, 0.1, 0.2, -0.3, -0.1]))
    assert bad["pair_median_positive"] and not bad["enough_pair_seeds_positive"] and not bad["stable"]


def test_reference_and_transfer_gates(spark):
    cols = "reference string, gain double, lower double, seeds_passed boolean, shuffled double, linear_alone double, increment boolean, linear_increment boolean"
    r = spark.createDataFrame([("a", 0.2, 0.1, True, 0.1, 0.3, True, False), ("b", 0.2, 0.1, True, 0.2, 0.2, True, True)], cols)
    b = gates.boundary(r, ["gain", "linear_alone"], ["shuffled"])
    assert [(x["specific"], x["strongest"], x["robust"]) for x in b.orderBy("reference").collect()] == [(True, "linear_alone", False), (False, "gain", True)]
    assert row(gates.references(b)) == {"efficacy": True, "specificity": False, "architecture_robust": False, "linear_alone_strongest": False}
    c = spark.createDataFrame([("p", 0.1, 0.1, True), ("o", 0.1, None, True)], "condition string, slope_lower double, mean_lower double, seeds_positive boolean")
    checked = gates.prevalence(c)
    assert all(x["associated"] for x in checked.collect())
    assert row(gates.transfer(checked)) == {"conditions": 2, "transfer_supported": False}
    assert row(gates.transfer(checked.where("condition = 'p'")))["transfer_supported"]


def test_diversity_and_correction_gates(spark):
    c = spark.createDataFrame([("base", 5, 2, 0.1, 4), ("broad", 5, 3, 0.1, 4)], "condition string, pairs long, relations long, lower double, same long")
    of = lambda x: row(gates.diversity(x, "base", "broad", F.max("lower"), F.max("same")))
    assert of(c)["passed"] and not of(c.withColumn("same", F.lit(3)))["passed"] and not of(c.withColumn("relations", F.lit(3)))["more_relations"]
    cols = "gain double, lower double, harm double, harm_upper double, shuffled double, wrong double, bias_swap double, v double, other double"
    r = spark.createDataFrame([(0.2, 0.1, 0.0, 0.01, 0.0, 0.01, 0.0, 0.05, None)], cols)
    assert row(gates.correction(r, swapped="v", rival="other"))["passed"]
    assert not row(gates.correction(r.withColumn("v", F.lit(0.1)), swapped="v"))["passed"]
    assert not row(gates.correction(r.withColumn("wrong", F.lit(0.06))))["wrong_gains_less"]


def test_slopes_of_prevalence_are_judged_to_six_places_as_the_sql_does(spark, monkeypatch):
    """Gains of a millionth: their contrasts round to 0, and 0 reduces nothing."""
    import duckdb

    from pairlens.plans import reports
    from pairlens.plans.catalogue import _SCORED, ORACLE_SQL

    rows = [(s, s, 0.5, 0.5 - 4e-7 - 1e-9 * s) for s in range(8, 20)]
    monkeypatch.setattr(reports, "_scored", lambda *_: spark.createDataFrame(rows, "subject_l long, subject_r long, base_error double, error double"))
    con = duckdb.connect()
    con.execute("CREATE TABLE given AS SELECT * FROM (VALUES " + ", ".join(map(str, rows)) + ") t(subject_l, subject_r, base_error, error)")
    want = con.execute(ORACLE_SQL["prevalence_checks"].replace(_SCORED, "WITH scored AS (SELECT * FROM given)")).fetchall()
    got = sorted(map(tuple, reports.prevalence_checks(spark, "").collect()))
    assert got == sorted(want) and not got[1][1]
