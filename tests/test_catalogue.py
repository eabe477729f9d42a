"""Every registered query with SQL gives the SQL's rows, at the smallest scale."""

import math

import duckdb
import pytest

from pairlens.plans import catalogue, studies

SF = "/root/testdata/sf0.001"
#: Gates and contrasts over tables that are queries of their own and run here; their rules are in test_gates.py.
OVER_TABLES = {"paired_contrast", "ordering_gate", "weighting_gate", "variant_checks", "variant_gate", "reference_gate", "transfer_gate"}
#: Gates over a report whose evidence is made in full by a query that runs here.
OVER_REPORTS = {"correction_gate", "reference_gate_trained", "prevalence_transfer_trained"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(autouse=True)
def short(monkeypatch):
    """What trains takes two steps, two seeds and few replicates here."""
    for name, value in (("STEPS", 2), ("SEEDS", [1, 2]), ("REPLICATES", 50)):
        monkeypatch.setattr(studies, name, value)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def value(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return str(v)
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return "None" if isinstance(v, float) and math.isnan(v) else f"{round(float(v), 5) + 0.0:.5f}"
        return str(v)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLE_SQL) - OVER_TABLES))
def test_query(spark, oracle, name):
    frame = catalogue.QUERIES[name](spark, SF)
    got = oracle.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(frame.columns) == sorted(names)
    order = sorted(names)
    want = [tuple(r[names.index(c)] for c in order) for r in got.fetchall()]
    assert plain(frame.select(*(f"`{c}`" for c in order)).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) - OVER_REPORTS))
def test_rows_only(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
