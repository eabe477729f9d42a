"""Validators: each gives the rows or counts that break a rule; ``require`` stops on any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.plans.storage import settled

SPLITS = ("calibration", "evaluation", "train")


class Rejected(ValueError):
    pass


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def not_finite(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))


def record_violations(items: DataFrame) -> DataFrame:
    """(rule, n) for every rule of an item table: one scan for the row rules, one grouped pass per key rule."""
    rules = {"blank_field": blank("category") | blank("condition") | F.col("subject").isNull() | F.col("item").isNull(), "unknown_split": ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))}
    by_row = items.agg(*(F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).alias(name) for name, test in rules.items()))
    rows = by_row.select(F.explode(F.create_map(*(x for name in rules for x in (F.lit(name), F.col(name))))).alias("rule", "n"))
    twice = items.groupBy("item").count().where("count > 1").agg(F.lit("duplicate_item").alias("rule"), F.count("*").alias("n"))
    leaking = items.groupBy("subject").agg(F.count_distinct("split").alias("k")).where("k > 1").agg(F.lit("subject_in_two_splits").alias("rule"), F.count("*").alias("n"))
    return rows.unionByName(twice).unionByName(leaking).select("rule", F.col("n").cast("long").alias("n"))


def pair_violations(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(rule, n) of pairs(pair_id, ends): exactly two different ends, both known, in one split, every id and every pair of ends once."""
    ends = F.col("ends")
    two = F.coalesce(F.size(ends) == 2, F.lit(False))
    shape = pairs.agg(*(F.coalesce(F.sum(F.when(t, 1).otherwise(0)), F.lit(0)).alias(n) for n, t in {"not_two_ends": ~two, "self_pair": two & (ends[0] == ends[1])}.items()))
    rows = shape.select(F.explode(F.create_map(F.lit("not_two_ends"), F.col("not_two_ends"), F.lit("self_pair"), F.col("self_pair"))).alias("rule", "n"))
    known = lambda s: items.select(F.col("item").alias(s), F.col("split").alias(f"split_{s}")).dropDuplicates([s])
    both = pairs.where(two).select(ends[0].alias("l"), ends[1].alias("r")).join(known("l"), "l", "left").join(known("r"), "r", "left")
    tests = {"unknown_end": F.col("split_l").isNull() | F.col("split_r").isNull(), "two_splits": F.col("split_l") != F.col("split_r")}
    found = both.agg(*(F.coalesce(F.sum(F.when(t, 1).otherwise(0)), F.lit(0)).alias(n) for n, t in tests.items()))
    rows = rows.unionByName(found.select(F.explode(F.create_map(*(x for n in tests for x in (F.lit(n), F.col(n))))).alias("rule", "n")))
    for name, key in (("duplicate_id", F.col("pair_id")), ("duplicate_ends", F.array_sort("ends"))):
        twice = pairs.groupBy(key.alias("k")).count().where("count > 1")
        rows = rows.unionByName(twice.agg(F.lit(name).alias("rule"), F.count("*").alias("n")))
    return rows.select("rule", F.col("n").cast("long").alias("n"))


def distance_violations(rows: DataFrame) -> DataFrame:
    """Distance rows of an unknown arm, without subject or stratum, or not finite or outside 0..2."""
    return rows.where(~F.coalesce(F.col("arm").isin("A", "B"), F.lit(False)) | blank("stratum") | F.col("subject_l").isNull() | F.col("subject_r").isNull() | not_finite("distance") | (F.col("distance") < 0) | (F.col("distance") > 2))


def matrix_violations(long: DataFrame, labels: int, atol: float = 1e-10, dtol: float = 1e-12) -> DataFrame:
    """(rule, n) of a label matrix (l, r, value): complete, finite, symmetric, zero diagonal, some positive entry."""
    other = long.select(F.col("l").alias("r"), F.col("r").alias("l"), F.col("value").alias("back"))
    both = long.join(other, ["l", "r"], "full_outer")
    got = both.agg(
        F.abs(F.count("*") - labels * labels).alias("incomplete"),
        F.coalesce(F.sum(F.when(not_finite("value"), 1).otherwise(0)), F.lit(0)).alias("not_finite"),
        F.coalesce(F.sum(F.when(F.abs(F.col("value") - F.col("back")) <= atol, 0).otherwise(1)), F.lit(0)).alias("asymmetric"),
        F.coalesce(F.sum(F.when((F.col("l") == F.col("r")) & (F.abs("value") > dtol), 1).otherwise(0)), F.lit(0)).alias("diagonal"),
        F.when(F.max("value") > 0, 0).otherwise(1).alias("no_positive"),
    )
    names = got.columns
    return got.select(F.explode(F.create_map(*(x for n in names for x in (F.lit(n), F.col(n).cast("long"))))).alias("rule", "n"))


def grid_gaps(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the expected grid that were not reported."""
    return expected.select(*keys).distinct().join(found.select(*keys).distinct(), keys, "left_anti")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side) of rows without a partner on either side: empty where both hold the same keys."""
    a, b = left.select(*keys).distinct().withColumn("__a", F.lit(1)), right.select(*keys).distinct().withColumn("__b", F.lit(1))
    return a.join(b, keys, "full_outer").where("__a IS NULL OR __b IS NULL").select(*keys, F.when(F.col("__a").isNull(), "right").otherwise("left").alias("side"))


def manifest_hash_status(frame: DataFrame, column: str, invalid: list[str]) -> DataFrame:
    """Whether each hash is one, and whether it is known to be invalidated."""
    return frame.withColumn("is_hash", F.col(column).rlike("^[0-9a-f]{64}$")).withColumn("status", F.when(~F.col("is_hash"), "malformed").when(F.col(column).isin(*invalid) if invalid else F.lit(False), "invalidated").otherwise("verified"))


def json_nodes(frame: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, path, key, text) of every value below the root of a JSON text, at any depth: its path from the root, its name (null inside a list) and its text, null for
    what is not text. One round a level, each written; a text that is no JSON has none."""
    spark = frame.sparkSession
    level = settled(frame.select(*keys, F.lit("").alias("path"), F.try_parse_json(column).alias("v")).where("v IS NOT NULL"))
    out = None
    while True:
        kids = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        named = kids.select(*keys, F.concat_ws("/", "path", F.coalesce("key", F.col("pos").cast("string"))).alias("path"), "key", "value", F.schema_of_variant("value").alias("kind"))
        named = settled(named)
        if named.isEmpty():
            break
        told = named.select(*keys, "path", "key", F.when(F.col("kind") == "STRING", F.col("value").cast("string")).alias("text"))
        out = told if out is None else out.unionByName(told)
        level = named.where(F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")).select(*keys, "path", F.col("value").alias("v"))
    return out if out is not None else level.select(*keys, "path", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("text"))


#: Names under which a report records the manifest it was made from.
HASH_NAMES = ("manifest_sha256", "pair_manifest_sha256", "projection_manifest_sha256")


def manifest_identity(frame: DataFrame, keys: list[str], column: str, expected: str, names: tuple[str, ...] = HASH_NAMES) -> DataFrame:
    """(keys, status, reason, n_hashes, locations) of reports as JSON: verified if the expected hash (a column) is recorded anywhere under one of ``names``; else invalidated, because another
    is, because the report resamples matched strata whose origin it does not say, or because none is."""
    found = json_nodes(frame, keys, column).where(F.col("key").isin(*names)).withColumn("hash", F.lower("text")).where(F.col("hash").rlike("^[0-9a-f]{64}$"))
    seen = found.join(frame.select(*keys, F.col(expected).alias("__e")), keys).groupBy(*keys).agg(
        F.count("*").alias("n_hashes"), F.bool_or(F.col("hash") == F.col("__e")).alias("__v"), F.array_sort(F.collect_list(F.when(F.col("hash") == F.col("__e"), F.col("path")))).alias("locations")
    )
    strata = F.coalesce(F.get_json_object(column, "$.bootstrap.resampling_unit").contains("matched_stratum"), F.lit(False))
    both = frame.select(*keys, strata.alias("__s")).join(seen, keys, "left")
    reason = F.when(F.col("__v"), "expected_hash_recorded").when(F.col("n_hashes") > 0, "hash_mismatch").when(F.col("__s"), "stratum_origin_missing").otherwise("hash_missing")
    return both.select(*keys, F.when(F.col("__v"), "verified").otherwise("invalidated").alias("status"), reason.alias("reason"), F.coalesce("n_hashes", F.lit(0)).alias("n_hashes"), F.coalesce("locations", F.array().cast("array<string>")).alias("locations"))


def below_root(path: Column, root: str) -> Column:
    """Whether a relative path stays below its root: not absolute, no step upwards."""
    return ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)") | path.startswith(root.rstrip("/") + "/") & ~path.rlike(r"(^|/)\.\.(/|$)")


#: Scope of a correction's features -> the inference it allows.
SCOPES = {"own_item": "transductive", "own_subject": "transductive", "calibration_only": "inductive", "strict_inductive": "inductive"}


def scope_violations(frame: DataFrame) -> DataFrame:
    """Rows (scope, inference, score) whose inference is not the scope's, or strict ones that carry a score."""
    allowed = F.create_map(*(F.lit(x) for pair in SCOPES.items() for x in pair))
    return frame.where(~F.coalesce(F.try_element_at(allowed, F.col("scope")) == F.col("inference"), F.lit(False)) | ((F.col("scope") == "strict_inductive") & F.col("score").isNotNull()))


def require(violations: DataFrame, what: str) -> None:
    """Fails closed: raises with a few of the rows if there are any."""
    if some := violations.take(5):
        raise Rejected(f"{what}: {[r.asDict() for r in some]}")
