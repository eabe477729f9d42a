"""Digests of sets of ids as a tree by key range.

A leaf digests the ids of a range of 256 numbers, a node those of its 256 ranges; the tree's shape depends on the ids alone, so equal sets have equal roots however
they are partitioned, no task holds more than 256 entries of a node, nested inventories share all nodes but those at their edge, and two inventories that differ are told apart by one node a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.plans.scan import Run, scan
from pairlens.plans.storage import settled

#: Bits of a level, and levels above the leaves that bring any 64-bit number to one of two nodes.
BITS, LEVELS = 8, 7


def _up(bucket: str) -> Column:
    return F.shiftright(bucket, BITS)


def leaves(frame: DataFrame, unit: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, bucket, digest, n) of the distinct ids of every range."""
    keys = keys or []
    ids = frame.where(F.col(unit).isNotNull()).select(*keys, F.col(unit).cast("long").alias("__u"))
    g = ids.groupBy(*keys, _up("__u").alias("bucket")).agg(F.array_sort(F.collect_set("__u")).alias("us"))
    return g.select(*keys, "bucket", F.sha2(F.array_join(F.transform("us", lambda u: u.cast("string")), ","), 256).alias("digest"), F.size("us").cast("long").alias("n"))


def above(nodes: DataFrame, keys: list[str] | None = None, top: bool = False) -> DataFrame:
    """The nodes one level up; ``top``: the root (bucket 0) over whatever is left."""
    keys = keys or []
    parent = F.lit(0).cast("long") if top else _up("bucket")
    g = nodes.groupBy(*keys, parent.alias("up")).agg(F.array_sort(F.collect_list(F.struct("bucket", "digest"))).alias("cs"), F.sum("n").alias("n"))
    return g.select(*keys, F.col("up").alias("bucket"), F.sha2(F.array_join(F.transform("cs", lambda c: F.concat_ws(":", c["bucket"], c["digest"])), ","), 256).alias("digest"), "n")


def roots(nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, digest) of ``leaves``: one row a set; an empty set has none."""
    for _ in range(LEVELS):
        nodes = above(nodes, keys)
    return above(nodes, keys, top=True).select(*(keys or []), "n", "digest")


def inventories(pool: DataFrame, unit: str, fractions: tuple[float, ...]) -> DataFrame:
    """(fraction, n, digest): the first round(n*f) ids in order (half to even, at most all). Leaves that lie inside several inventories are digested once; each inventory makes anew the one it cuts."""
    ranked = settled(scan(pool.select(F.col(unit).cast("long").alias("id")).distinct(), [], ["id"], {"rank": Run("count")}, {"n": Run("count")}))
    spans = ranked.groupBy(_up("id").alias("bucket")).agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    whole = settled(leaves(ranked, "id").join(spans, "bucket"))
    cuts = F.broadcast(ranked.groupBy().agg(F.max("n").alias("all")).select(F.explode(F.array(*map(F.lit, fractions))).alias("fraction"), "all").select("fraction", F.least("all", F.bround(F.col("all") * F.col("fraction")).cast("long")).alias("cut")))
    shared = whole.join(cuts, F.col("last") <= F.col("cut")).select("fraction", "bucket", "digest", "n")
    edge = whole.join(cuts, (F.col("first") <= F.col("cut")) & (F.col("last") > F.col("cut"))).select("fraction", "bucket", "cut")
    # At most 256 ids a fraction.
    kept = ranked.withColumn("bucket", _up("id")).join(F.broadcast(edge), "bucket").where("rank <= cut").select("fraction", "id")
    return roots(shared.unionByName(leaves(kept, "id", ["fraction"])), ["fraction"])


def first_difference(a: DataFrame, b: DataFrame, unit: str) -> int | None:
    """The least id that one of two sets has and the other has not, or None: the trees are gone down along the first node that differs."""
    trees = []
    for frame in (a, b):
        levels = [settled(leaves(frame, unit))]
        for _ in range(LEVELS):
            levels.append(settled(above(levels[-1])))
        trees.append(levels)
    inside: int | None = None
    for level in range(LEVELS, -1, -1):
        mine, theirs = (t[level] if inside is None else t[level].where(_up("bucket") == inside) for t in trees)
        both = mine.select("bucket", F.col("digest").alias("d")).join(theirs.select("bucket", F.col("digest").alias("e")), "bucket", "full_outer")
        inside = both.where(~F.col("d").eqNullSafe(F.col("e"))).agg(F.min("bucket")).first()[0]
        if inside is None:
            return None
    left, right = (f.select(F.col(unit).cast("long").alias("u")).where(_up("u") == inside).distinct() for f in (a, b))
    return left.exceptAll(right).unionByName(right.exceptAll(left)).agg(F.min("u")).first()[0]
