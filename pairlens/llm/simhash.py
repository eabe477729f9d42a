"""SimHash near-duplicates through deletion-variant signatures (Arrow for the fingerprints, SQL for the links).

Each text gets a 64-bit fingerprint of its word shingles; two fingerprints link at MOST_BITS or fewer differing bits. Of two linked fingerprints cut
into two halves, one half differs by at most one bit. So every half is indexed whole and, for each of its bits, as the variant without that bit. Linked
fingerprints meet by an equality join in a whole half, or in a variant whose missing bit they differ in (the two sides of that join are the values of the
missing bit, so equal halves do not meet there again), and each meeting is verified on all 64 bits.

A half that more than ``crowd`` fingerprints share would make too many meetings. There the other half is cut into variants as well: without two bits where the
halves are equal, without one where they differ. Fingerprints that agree in all that is left lie within two bits of each other, and there are at most four of them, so
a group is never large and one chain through it carries all its links. Components come from the links by contraction; no pair of copies and no
fingerprint list passes through the driver or one task.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; a text of fewer words than a shingle is one shingle; equal texts are
one fingerprint; very long texts are hashed in blocks; rows that share an id are judged each by its own text and stay rows; a null id is kept, but names a
component only if it has no other id; ids of any ordered type; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected, even, lean, whole_text, written

WORDS, SEED, MOST_BITS = 3, 42, 2
#: Bits of a half, and how many fingerprints may share one before the other half is cut as well.
HALF, CROWD = 32, 1024
#: Shingles hashed at once.
_BLOCK = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The fingerprint of a UTF-8 text, as a signed 64-bit integer."""
    import xxhash

    found = text.translate(_LOWER).split()  # bytes part at the six ASCII blanks alone
    if not found:
        return 0
    last = max(len(found) - words + 1, 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, last, _BLOCK):
        hashed = np.fromiter((xxhash.xxh64_intdigest(b" ".join(found[i : i + words]), SEED) for i in range(at, min(at + _BLOCK, last))), np.uint64)
        counts += np.unpackbits(hashed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > last, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = pa.array((fingerprint(t.as_py(), words) for t in part.column(1)), pa.int64(), size=len(part))
            yield pa.RecordBatch.from_arrays([part.column(0), fps], names=["doc_id", "fp"])

    texts = docs.select("doc_id", whole_text("text").cast("binary").alias("text"))
    return texts.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _less(value: Column, *bits: Column) -> Column:
    """The value without these bits."""
    for b in bits:
        value = value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    return value


def _bit(value: str, at: Column) -> Column:
    return F.call_function("shiftright", F.col(value), at).bitwiseAND(1)


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between the distinct fingerprints of ``fps(fp)`` that join all that lie within MOST_BITS of each other; pairs may repeat."""
    low = F.col("fp").bitwiseAND((1 << HALF) - 1)
    high = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(HALF))
    half = lambda k, mine, other: F.struct(F.lit(k).alias("side"), mine.alias("half"), other.alias("other"))
    halves = fps.select("fp", F.explode(F.array(half(0, low, high), half(1, high, low))).alias("h")).select("fp", "h.*")
    bits = F.explode(F.sequence(F.lit(0), F.lit(HALF - 1)))
    busy = written(halves.groupBy("side", "half").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("side", "half"))
    calm = halves.join(busy, ["side", "half"], "left_anti").select("side", "half", "fp")

    # Halves that are equal, then those that differ in the missing bit.
    near = _differ("a", "b") <= MOST_BITS
    left, right = even(calm.withColumnRenamed("fp", "a")), calm.withColumnRenamed("fp", "b")
    same = left.join(right, ["side", "half"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    cut = calm.withColumn("bit", bits).select("side", "bit", _bit("half", F.col("bit")).alias("v"), _less(F.col("half"), F.col("bit")).alias("rest"), "fp")
    zero, one = cut.where("v = 0").drop("v").withColumnRenamed("fp", "a"), cut.where("v = 1").drop("v").withColumnRenamed("fp", "b")
    apart = even(zero).join(one, ["side", "bit", "rest"]).where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    # Around a crowded half: both halves in variants. ``to`` is the crowded half, bit1 the bit in which a neighbour differs from it (-1: in none).
    around = busy.select("side", F.col("half").alias("to"), F.explode(F.sequence(F.lit(-1), F.lit(HALF - 1))).alias("bit1"))
    around = around.withColumn("half", F.when(F.col("bit1") < 0, F.col("to")).otherwise(F.col("to").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.col("bit1"), F.lit(0))))))
    met = halves.join(around, ["side", "half"])
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(HALF) for j in range(i + 1, HALF)))
    inside = met.where("bit1 < 0")
    twice = inside.withColumn("p", F.explode(pairs)).select("side", F.col("to").alias("rest"), F.lit(-1).alias("bit1"), F.col("p.i").alias("bit2"), F.col("p.j").alias("bit3"), _less(F.col("other"), F.col("p.i"), F.col("p.j")).alias("kept"), "fp")
    # The crowded side itself takes part in the variant of every bit.
    each = inside.drop("bit1").withColumn("bit1", bits).unionByName(met.where("bit1 >= 0"), allowMissingColumns=True)
    once = each.withColumn("bit2", bits).select("side", _less(F.col("to"), F.col("bit1")).alias("rest"), "bit1", "bit2", F.lit(-1).alias("bit3"), _less(F.col("other"), F.col("bit2")).alias("kept"), "fp")
    groups = twice.unionByName(once).groupBy("side", "rest", "bit1", "bit2", "bit3", "kept").agg(F.array_sort(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    chain = F.transform(F.sequence(F.lit(1), F.size("fps") - 1), lambda i: F.struct(F.get("fps", i - 1).alias("a"), F.get("fps", i).alias("b")))
    crowded = groups.select(F.explode(chain).alias("e")).select("e.a", "e.b")
    return same.unionByName(apart).unionByName(crowded)


def components(docs: DataFrame, words: int = WORDS, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: 16 hex digits, and the least id that links reach."""
    marked = written(fingerprints(docs, words))
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    classes = connected(links(distinct.select("fp"), crowd)).select(F.col("node").alias("fp"), "root")
    rooted = written(distinct.join(classes, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return even(marked).join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
