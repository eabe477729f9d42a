"""Running values over parts and segments against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from pairlens.functions import ordering
from pairlens.operators import pools
from pairlens.plans.scan import Run, scan


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_segments_across_parts(spark, partitions):
    """One key holds most rows, so that its segment crosses parts; null keys and values, repeated keys of order."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rng = random.Random(2)
        rows = [(rng.choice(["a", "a", "a", "a", "b", None]), k, rng.choice([None, 1, 2, 5, -3])) for k in range(300)]
        rng.shuffle(rows)
        frame = spark.createDataFrame(rows, "k string, o int, v int").repartition(5)
        runs = {"n": Run("count"), "s": Run("sum", "v"), "hi": Run("max", "v"), "lo": Run("min", "v"), "last": Run("last", "v"), "before": Run("sum", "v", past=True), "top": Run("max", "v", past=True)}
        got = {r["o"]: r for r in scan(frame, ["k"], ["o"], runs, {"all": Run("count"), "total": Run("sum", "v")}).collect()}
        for k in ("a", "b", None):
            mine = sorted((o, v) for x, o, v in rows if x == k)
            for i, (o, _) in enumerate(mine):
                seen = [v for _, v in mine[: i + 1] if v is not None]
                past = [v for _, v in mine[:i] if v is not None]
                r = got[o]
                assert (r["n"], r["all"]) == (i + 1, len(mine)) and r["total"] == sum(v for _, v in mine if v is not None)
                assert (r["s"], r["hi"], r["lo"], r["last"]) == ((sum(seen), max(seen), min(seen), seen[-1]) if seen else (None,) * 4)
                assert (r["before"], r["top"]) == ((sum(past), max(past)) if past else (None, None))
        assert [r["n"] for r in scan(frame, [], ["o"], {"n": Run("count")}).orderBy("o").collect()] == list(range(1, 301))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_no_window_over_the_table(spark):
    """The plans of the global orders partition every window by part."""
    t = spark.range(100).select(F.col("id").alias("unit"), (F.col("id") % 2).cast("double").alias("target"), (F.col("id") / 100).alias("p"))
    for frame in (pools.nested_masks(t, "unit", 1), pools.folds(t, "unit", 5, 1), ordering.holm(t, [], "p", "unit"), ordering.average_ranks(t, [], "target", "r"), pools.natural_pools(t, "unit", 10, 1)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert all("__p" in line for line in plan.splitlines() if "Window [" in line)


def test_average_ranks(spark):
    t = spark.createDataFrame([("a", 1), ("a", 1), ("a", 3), ("b", None), ("b", 2)], "k string, v int")
    assert sorted((r["k"], r["v"] or 0, r["r"]) for r in ordering.average_ranks(t, ["k"], "v", "r").collect()) == [("a", 1, 1.5), ("a", 1, 1.5), ("a", 3, 3.0), ("b", 0, 1.0), ("b", 2, 2.0)]


def test_shuffled_partners_have_no_cap(spark):
    """A subject that holds nearly a whole category; a category of one subject gives none."""
    items = spark.createDataFrame([(i, 1 if i % 50 else 2 + i, "big") for i in range(400)] + [(1000 + i, 7, "one") for i in range(5)], "item long, subject long, category string")
    examples = spark.createDataFrame([(k, 1 + (k % 3 == 0), "big") for k in range(300)] + [(900, 7, "one"), (901, 8, "one"), (902, 8, "none")], "pair_id long, subject_l long, category_r string")
    got = {r["pair_id"]: r["partner"] for r in pools.shuffled_partners(examples, items, 3).collect()}
    subject, category = ({r["item"]: r[c] for r in items.collect()} for c in ("subject", "category"))
    assert len(got) == 303 and got[900] is None and got[902] is None and category[got[901]] == "one"
    assert all(category[got[k]] == "big" and subject[got[k]] != 1 + (k % 3 == 0) for k in range(300))
    assert len({got[k] for k in range(300)}) > 60
