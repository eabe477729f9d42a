"""Ranked search against the formula over all documents, for several sizes of shards and tiers."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from pairlens.llm import tiered_index
from pairlens.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_native import docs

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LETTERS))


def plain(rows, items, k=20):
    """{item row: [(score, id)]}; rows are documents of their own."""
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in rows if terms(t)]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in held:
            m = 75 + 25 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, 3, "z") for i, t in items], "item_id long, text string, item int, terms string")


@pytest.mark.parametrize(("shard", "tiers", "block"), [(7, (1, 2), 3), (30, (2, 5), 2), (8192, (128, 1024), 256)])
def test_ranks(spark, monkeypatch, shard, tiers, block):
    for name, value in (("SHARD", shard), ("TIERS", tiers), ("ITEMS", block)):
        monkeypatch.setattr(tiered_index, name, value)
    rng = random.Random(shard)
    vocabulary = [f"w{int(rng.expovariate(0.05))}" for _ in range(400)] + ["Ünï", "日本", "x_y", "A-b", "the", "THE"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows += [(200 + i, f"{rows[i][1]} {passage}") for i in range(8)] + [(300 + i, passage) for i in range(30)]
    rows += [(400, None), (401, ""), (402, "-- !"), (None, passage), (300, passage), (403, "the " * 5000), (404, "long " + "w1 w2 w3 " * 30_000)]
    items = [(1, passage), (2, "the"), (3, "w1 w1 w1 w2 w90"), (4, None), (5, "?!"), (6, "absent words"), (7, "日本 Ünï the"), (1, "w5 w6")] + [(10 + i, " ".join(rng.choice(vocabulary) for _ in range(12))) for i in range(8)]
    got = sorted(map(tuple, tiered_index.ranked(docs(spark, rows), benchmark(spark, items)).collect()), key=str)
    assert got == plain(rows, items)


def test_an_index_of_all_terms_serves_any_items(spark, monkeypatch):
    monkeypatch.setattr(tiered_index, "SHARD", 20)
    rng = random.Random(4)
    rows = [(f"d{i:03}", " ".join(f"w{rng.randrange(60)}" for _ in range(40))) for i in range(90)]
    made = tiered_index.index(spark.createDataFrame(rows, "doc_id string, text string"))
    for items in ([(1, "w1 w2 w3")], [(2, "w7"), (3, "w8 w8 w50")]):
        asked = tiered_index.items(benchmark(spark, items))
        got = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in tiered_index.search(made, asked, 5).collect()}
        number = {d: int(d[1:]) + 1 for d, _ in rows}
        want = {(i, r): (d, s) for i, r, d, s in plain([(number[d], t) for d, t in rows], items, 5)}
        assert {k: (number[d], s) for k, (d, s) in got.items()} == want


def test_most_pairs_are_proven_high_up(spark, monkeypatch):
    """Items of rare terms need no lower tier; an item of common terms falls through."""
    monkeypatch.setattr(tiered_index, "SHARD", 50)
    monkeypatch.setattr(tiered_index, "TIERS", (3, 10))
    tables, written = [], tiered_index.written
    monkeypatch.setattr(tiered_index, "written", lambda f: (tables.append(f.columns), written(f))[1])
    rows = [(i, f"common rare{i} common" if i % 2 else f"common rare{i}") for i in range(200)]
    for items, rounds in (([(1, "rare7")], 0), ([(2, "common")], 2), ([(3, "rare8 common")], 2)):
        tables.clear()
        got = sorted(map(tuple, tiered_index.ranked(docs(spark, rows), benchmark(spark, items)).collect()), key=str)
        assert got == plain(rows, items) and tables.count(["shard", "items"]) == rounds


def test_empty_tables(spark):
    assert tiered_index.ranked(docs(spark, []), benchmark(spark, [(1, "a")])).count() == 0
    assert tiered_index.ranked(docs(spark, [(1, "a")]), benchmark(spark, [])).count() == 0
    assert tiered_index.ranked(docs(spark, [(1, None)]), benchmark(spark, [(1, "a")])).count() == 0
    assert tiered_index.ranked(docs(spark, [(1, "b c")]), benchmark(spark, [(1, "a")])).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = con.execute(ORACLE_SQL["op11_tiered_search"])
    names = [d[0] for d in got.description]
    frame = QUERIES["op11_tiered_search"](spark, "/root/testdata/sf0.001")
    assert frame.columns == names
    assert sorted(map(tuple, frame.collect())) == sorted(map(tuple, got.fetchall()))
