"""Audits of manifests and designs: leakage, collisions, dependency, reuse, identifiability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUANTILES = (0.0, 0.25, 0.5, 0.75, 0.95, 1.0)


def identity(pairs: DataFrame) -> DataFrame:
    """Adds ``ends``: the sorted endpoints, which with the id make a pair's identity."""
    return pairs.withColumn("ends", F.array_sort(F.array("item_l", "item_r")))


def collisions(first: DataFrame, second: DataFrame) -> DataFrame:
    """(pair_id, ends, other_ends): ids two manifests share for different endpoints."""
    a, b = identity(first).select("pair_id", "ends"), identity(second).select("pair_id", F.col("ends").alias("other_ends"))
    return a.join(b, "pair_id").where("ends <> other_ends")


def leakage(source: DataFrame, target: DataFrame) -> DataFrame:
    """(kind, shared): distinct pair identities, items and subjects that two pair tables have in common."""
    def common(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
        return a.intersect(b).agg(F.lit(name).alias("kind"), F.count("*").alias("shared"))

    ends = lambda p: p.select(F.least("item_l", "item_r").alias("x"), F.greatest("item_l", "item_r").alias("y"))
    # Items and subjects are few beside the pairs: each task drops what it has seen before anything is shuffled.
    items = lambda p: p.select(F.explode(F.array("item_l", "item_r")).alias("x")).distinct()
    subjects = lambda p: p.select(F.explode(F.array("subject_l", "subject_r")).alias("x")).distinct()
    return common("pair", ends(source), ends(target)).unionByName(common("item", items(source), items(target))).unionByName(common("subject", subjects(source), subjects(target)))


def text_leakage(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(item_id, n): whole benchmark texts that occur as whole documents, by digest of the blank-collapsed text."""
    digest = F.sha2(F.regexp_replace(F.trim("text"), r"\s+", " "), 256).alias("h")
    return benchmark.select("item_id", digest).join(documents.select(digest).groupBy("h").agg(F.count("*").alias("n")), "h").select("item_id", "n")


def cross_arm(pairs: DataFrame) -> DataFrame:
    """One row: items, those in both arms, and whether each shared one nests in one subject and one category."""
    e = lambda s: F.struct(F.col(f"item_{s}").alias("item"), F.col(f"subject_{s}").alias("subject"), F.col(f"category_{s}").alias("category"))
    ends = pairs.select("arm", F.explode(F.array(e("l"), e("r"))).alias("e")).select("arm", "e.*")
    per = ends.groupBy("item").agg(F.count_distinct("arm").alias("arms"), F.count_distinct("subject").alias("subjects"), F.count_distinct("category").alias("categories"))
    shared = F.col("arms") > 1
    n = lambda test: F.sum(F.when(test, 1).otherwise(0))
    return per.agg(F.count("*").alias("items"), n(shared).alias("shared"), n(shared & (F.col("subjects") > 1)).alias("not_nested_subject"), n(shared & (F.col("categories") > 1)).alias("not_nested_category"))


def participation(pairs: DataFrame, keys: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Per group: items, reused ones, the largest participation, and its quantiles over items."""
    ends = pairs.select(*keys, F.explode(F.array("item_l", "item_r")).alias("item"))
    per = ends.groupBy(*keys, "item").agg(F.count("*").alias("n"))
    g = per.groupBy(*keys).agg(F.count("*").alias("items"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("reused"), F.max("n").alias("most"), F.percentile("n", F.array(*map(F.lit, quantiles))).alias("q"))
    return g.select(*keys, "items", "reused", "most", *(F.col("q")[k].alias(f"q{int(q * 100)}") for k, q in enumerate(quantiles)))


def design(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: pairs, distinct items and subjects, and items used more than once."""
    e = lambda s: F.struct(F.col(f"item_{s}").alias("item"), F.col(f"subject_{s}").alias("subject"))
    ends = pairs.select(*keys, F.explode(F.array(e("l"), e("r"))).alias("e")).select(*keys, "e.*")
    per = ends.groupBy(*keys, "item", "subject").agg(F.count("*").alias("n"))
    each = per.groupBy(*keys).agg(F.count_distinct("item").alias("items"), F.count_distinct("subject").alias("subjects"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("reused"))
    return pairs.groupBy(*keys).agg(F.count("*").alias("pairs")).join(each, keys)


def identifiability(items: DataFrame) -> DataFrame:
    """One row: subject x category cells, single-item ones, and categories that stand for one condition only."""
    cells = items.groupBy("subject", "category").agg(F.count("*").alias("n")).agg(F.count("*").alias("cells"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("singletons"))
    cat = items.groupBy("category").agg(F.count_distinct("condition").alias("k")).agg(F.count("*").alias("categories"), F.sum(F.when(F.col("k") == 1, 1).otherwise(0)).alias("one_condition"))
    return cells.crossJoin(cat).withColumn("passed", (F.col("singletons") == 0) & (F.col("one_condition") < F.col("categories")))


def differing(reports: DataFrame, fields: list[str]) -> DataFrame:
    """(field, variants) of the fields that are not the same in all reports."""
    g = reports.agg(*(F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit("\0"))).alias(f) for f in fields))
    return g.select(F.explode(F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f))))).alias("field", "variants")).where("variants > 1")


def largest_gap(first: DataFrame, second: DataFrame) -> DataFrame:
    """(items, unmatched, largest): vectors (item, vec) of two loaders, the largest absolute difference of any entry."""
    both = first.select("item", F.col("vec").alias("a")).join(second.select("item", F.col("vec").alias("b")), "item", "full_outer")
    gap = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    return both.agg(F.count("*").alias("items"), F.sum(F.when(F.col("a").isNull() | F.col("b").isNull(), 1).otherwise(0)).alias("unmatched"), F.max(gap).alias("largest"))


def annotation(pairs: DataFrame) -> DataFrame:
    """Pairs whose stratum does not name the category or the condition of each end."""
    ok = F.lit(True)
    for c in ("category_l", "category_r", "condition_l", "condition_r"):
        if c in pairs.columns:
            ok = ok & (F.instr(F.col("stratum"), F.col(c).cast("string")) > 0)
    return pairs.where(~ok)


def roles(manifests: DataFrame) -> DataFrame:
    """manifests(path, role, split, sha256): rows per role and split, and digests registered more than once."""
    g = manifests.groupBy("role", "split").agg(F.count("*").alias("n"), F.count_distinct("sha256").alias("distinct"))
    return g.withColumn("duplicated", F.col("n") - F.col("distinct"))


def bounded_sample(frame: DataFrame, column: str, most: int = 10) -> DataFrame:
    """(n, sample): how many distinct values, and the first few in order: a report's example list."""
    few = frame.select(column).distinct().orderBy(column).limit(most)
    return few.agg(F.array_sort(F.collect_list(column)).alias("sample")).crossJoin(frame.agg(F.count_distinct(column).alias("n")))


def corpus(items: DataFrame, usable: bool, redistributable: bool, minimum_categories: int = 8, minimum_pairs: int = 200) -> DataFrame:
    """One row: records, subjects, categories, the four pair capacities, the licence class, the failed checks and whether there are none."""
    from pairlens.operators.pairs import capacity

    if minimum_categories <= 0 or minimum_pairs <= 0:
        raise ValueError("audit thresholds must be positive")
    counts = items.agg(F.count("*").alias("records"), F.count_distinct("subject").alias("subjects"), F.count_distinct("category").alias("categories"))
    both = counts.crossJoin(F.broadcast(capacity(items).agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in "abcd"))))
    failed = {"category_count": F.col("categories") < minimum_categories, "pair_capacity": F.least("a", "b", "c", "d") < minimum_pairs, "usable_for_research": F.lit(not usable)}
    names = F.filter(F.array(*(F.when(test, F.lit(n)) for n, test in failed.items())), lambda x: x.isNotNull())
    licence = "permitted" if usable and redistributable else "research_only" if usable else "pending_audit"
    return both.withColumn("licence", F.lit(licence)).withColumn("failed", names).withColumn("passed", F.size("failed") == 0)


def manifest_groups(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pairs, items, subjects, categories, category_relations, conditions, condition_relations, reused) of pairs with
    category_l/r and condition_l/r; ``reused`` are the item places beyond each item's first."""
    e = lambda s: F.struct(*(F.col(f"{c}_{s}").alias(c) for c in ("item", "subject", "category", "condition")))
    ends = pairs.select(*keys, F.explode(F.array(e("l"), e("r"))).alias("e")).select(*keys, "e.*")
    each = ends.groupBy(*keys).agg(F.count("*").alias("places"), *(F.count_distinct(c).alias(n) for c, n in (("item", "items"), ("subject", "subjects"), ("category", "categories"), ("condition", "conditions"))))
    rel = lambda c: F.count_distinct(F.array_sort(F.array(f"{c}_l", f"{c}_r"))).alias(f"{c}_relations")
    got = pairs.groupBy(*keys).agg(F.count("*").alias("pairs"), rel("category"), rel("condition"))
    return got.join(each, keys).withColumn("reused", F.col("places") - F.col("items")).drop("places")


def shared_across(pairs: DataFrame, key: str) -> DataFrame:
    """(shared, digest): the items that pairs of two groups use, and a digest of their set: the sum of the first 32 bits of each SHA-256,
    which needs neither an order nor all of them in one place."""
    ends = pairs.select(key, F.explode(F.array("item_l", "item_r")).alias("item"))
    both = ends.groupBy("item").agg(F.count_distinct(key).alias("k")).where("k > 1")
    bits = F.conv(F.substring(F.sha2(F.col("item").cast("string"), 256), 1, 8), 16, 10).cast("long")
    return both.agg(F.count("*").alias("shared"), F.coalesce(F.sum(bits), F.lit(0)).alias("digest"))
