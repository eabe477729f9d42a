"""Conversation prefix trie: chained prefix digests, nodes by (depth, digest), subtree sums by exploding nodes to their ancestors.

Every turn is known by the SHA-256 of its role and text, every prefix by a digest chained over its turns; equal prefixes of a depth are one node. Turns are
numbered after a sort by range, so that a conversation may spread over tasks. Chains run inside blocks of BLOCK turns; whole blocks are chained like turns, by the
same rule, and lead the digests of what follows, so no task holds more than a block whatever the length. Nodes reach their ancestors inside a block of
depths alone; what lies below a block is first summed for the node above it, again by the same rule over blocks, so a conversation of n turns costs n rows times a
block, not n squared. The ids of conversations that end in a node are sorted by range, joined into chunks, and the chunks hashed in order as a stream.

Defined cases: a null role or text is empty; rows without a conversation belong to none and are left out; turns are ordered null first, equal ones by their digest,
repeated rows are turns of their own; a conversation left without a turn is a member of the root; an empty table has no node, not even a
root; very long texts are hashed whole; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import even, lean, settled, whole_text, words, written

#: Turns in a block, and bytes of a chunk of joined ids.
BLOCK, CHUNK = 32, 1 << 16


def _root() -> Column:
    """The digest of the empty prefix."""
    return F.lit(b"")


def _sha(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def numbered_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, place, t, n_words) of every message: its number from 1 in its conversation, the digest of role and text, the words of the text."""
    role, text = whole_text("role"), whole_text("text")
    told = _sha(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = messages.where("conv_id IS NOT NULL").select("conv_id", "turn", told.alias("t"), F.size(words(text)).cast("long").alias("n_words"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "t"]
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "t", "n_words", F.spark_partition_id().alias("part"), inside.alias("i")))
    runs = parts.groupBy("conv_id", "part").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("conv_id", "part", (before - F.col("first") + 1).alias("shift"))
    return even(parts).join(runs, ["conv_id", "part"]).select("conv_id", (F.col("i") + F.col("shift")).alias("place"), "t", "n_words")


def branched(turns: DataFrame, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on shared beginnings: the first crc32(conv_id) % 4 turns come from the conversation whose id is the last multiple of ``every``.
    Returns (conv_id, length) and (conv_id, length, place, t, n_words)."""
    heads = written(turns.where((F.col("conv_id") % every == 0) & (F.col("place") <= 3)).withColumnRenamed("conv_id", "base"))
    each = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    have = heads.groupBy("base").agg(F.count("*").alias("have"))
    taken = F.least("h", F.coalesce("have", F.lit(0)))
    convs = written(each.join(have, "base", "left").select("conv_id", "base", "h", taken.alias("k"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    first = even(convs).join(heads, "base").where("place <= h").select("conv_id", "length", "place", "t", "n_words")
    own = even(turns).join(convs, "conv_id").where("place > h").select("conv_id", "length", (F.col("place") - F.col("h") + F.col("k")).alias("place"), "t", "n_words")
    return convs.select("conv_id", "length"), first.unionByName(own)


def chained(turns: DataFrame) -> list[DataFrame]:
    """Prefix digests, by blocks: (conv_id, length, block, digests, before, n_words). ``before`` is the digest of all before the block, null for the
    first. Level n + 1 of the list has the whole blocks of level n for turns; its digests are those of level n at the blocks' ends."""
    block = F.call_function("div", F.col("place") - 1, F.lit(BLOCK))
    listed = turns.groupBy("conv_id", "length", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "t", "n_words"))).alias("ts"))
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), _root())
    chain = F.aggregate("ts", F.array().cast("array<binary>"), lambda a, x: F.concat(a, F.array(_sha(F.concat(last(a), x["t"])))))
    inner = written(listed.select("conv_id", "length", "block", chain.alias("digests"), F.col("ts.n_words").alias("n_words")))
    long = inner.where(F.col("length") >= BLOCK)
    if long.isEmpty():
        return [inner.withColumn("before", F.lit(None).cast("binary"))]
    whole = long.where(F.size("digests") == BLOCK).select("conv_id", F.call_function("div", F.col("length"), F.lit(BLOCK)).alias("length"), (F.col("block") + 1).alias("place"), F.element_at("digests", BLOCK).alias("t"), F.lit(0).cast("long").alias("n_words"))
    above = chained(whole)
    ends = written(above[0].select("conv_id", F.posexplode("digests").alias("i", "x"), "block").select("conv_id", (F.col("block") * BLOCK + F.col("i")).alias("block"), "x"))
    led = long.join(ends.withColumnRenamed("x", "end"), ["conv_id", "block"], "left").join(ends.select("conv_id", (F.col("block") + 1).alias("block"), F.col("x").alias("before")), ["conv_id", "block"], "left")
    full = F.transform("digests", lambda d, i: F.when((i == BLOCK - 1), F.col("end")).when(F.col("before").isNull(), d).otherwise(_sha(F.concat("before", d))))
    led = led.select("conv_id", "length", "block", full.alias("digests"), "n_words", "before")
    short = inner.where(F.col("length") < BLOCK).withColumn("before", F.lit(None).cast("binary"))
    return [written(short.unionByName(led)), *above]


def _below(nodes: DataFrame, levels: list[DataFrame], sums: list[str]) -> DataFrame:
    """(depth, digest, sums): ``sums`` over the node and all under it; nodes(depth, digest, conv_id, sums), conv_id any member."""
    block = F.call_function("div", F.col("depth") - 1, F.lit(BLOCK))
    met = written(even(nodes.withColumn("block", block)).join(levels[0].select("conv_id", "block", "digests", "before"), ["conv_id", "block"]))
    total = [F.sum(c).alias(c) for c in sums]
    if len(levels) > 1:
        # What lies under the last node of a block: its next block, and what lies under that one.
        under = met.where("block > 0").groupBy(F.col("block").alias("depth"), F.col("before").alias("digest")).agg(F.min("conv_id").alias("conv_id"), *total)
        under = _below(under, levels[1:], sums).select((F.col("depth") * BLOCK).alias("depth"), "digest", *(F.col(c).alias(f"u_{c}") for c in sums))
        met = met.join(under, ["depth", "digest"], "left").select("depth", "digest", "block", "digests", *((F.col(c) + F.coalesce(f"u_{c}", F.lit(0))).alias(c) for c in sums))
    up = met.select("block", *sums, F.posexplode(F.slice("digests", F.lit(1), (F.col("depth") - F.col("block") * BLOCK).cast("int"))).alias("i", "digest"))
    return up.groupBy((F.col("block") * BLOCK + F.col("i") + 1).alias("depth"), "digest").agg(*total)


Batches = Iterator[pa.RecordBatch]


def _runs(emit: Callable[[tuple, object, Iterator], Iterator[tuple]], schema: pa.Schema) -> Callable[[Batches], Batches]:
    """A batch function over rows sorted by (depth, digest, x): ``emit(state, key, row)`` gives the next state and rows to put out."""

    def run(parts: Batches) -> Batches:
        key, state, out = None, None, []
        for part in parts:
            for depth, digest, x in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if (depth, digest) != key:
                    if key is not None:
                        out += emit.close(key, state)
                    key, state = (depth, digest), emit.open()
                out += emit.add(key, state, x)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)
                out = []
        if key is not None:
            out += emit.close(key, state)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

    return run


class _Chunks:
    """Ids joined by commas, in chunks."""

    def open(self) -> list:
        return [0, []]

    def add(self, key: tuple, state: list, x: int) -> list[tuple]:
        text = str(x)
        state[0] += len(text) + 1
        state[1].append(text)
        return self.close(key, state) if state[0] >= CHUNK else []

    def close(self, key: tuple, state: list) -> list[tuple]:
        out = [(*key, {"first": int(state[1][0]), "ids": ",".join(state[1])})] if state[1] else []
        state[:] = [0, []]
        return out


class _Hashes:
    """The SHA-256 of all chunks of a node, joined by commas."""

    def open(self) -> list:
        return [hashlib.sha256(), False]

    def add(self, key: tuple, state: list, x: dict) -> list[tuple]:
        state[0].update((("," if state[1] else "") + x["ids"]).encode())
        state[1] = True
        return []

    def close(self, key: tuple, state: list) -> list[tuple]:
        return [(*key, state[0].hexdigest())]


def ended(ends: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256) of ends(depth, digest, conv_id): the digest of a node's ids in order. A node's ids never lie in memory together."""
    node = [("depth", pa.int64()), ("digest", pa.binary())]
    chunk = pa.struct([("first", pa.int64()), ("ids", pa.string())])
    rows = ends.select("depth", "digest", F.col("conv_id").cast("long").alias("x"))
    rows = rows.repartitionByRange("depth", "digest", "x").sortWithinPartitions("depth", "digest", "x")
    chunks = rows.mapInArrow(lean(_runs(_Chunks(), pa.schema([*node, ("x", chunk)]))), "depth long, digest binary, x struct<first: long, ids: string>")
    chunks = chunks.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "x.first")
    return chunks.mapInArrow(lean(_runs(_Hashes(), pa.schema([*node, ("ends_sha256", pa.string())]))), "depth long, digest binary, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a node, of convs(conv_id, length) and turns(conv_id, length, place, t, n_words); the columns are those of ``nodes``."""
    levels = chained(turns)
    at = F.posexplode("digests").alias("i", "digest")
    above = F.when(F.col("i") > 0, F.get("digests", F.col("i") - 1)).otherwise(F.coalesce("before", _root()))
    prefixes = levels[0].select("*", at).select("conv_id", (F.col("block") * BLOCK + F.col("i") + 1).cast("long").alias("depth"), "digest", above.alias("parent"), F.get("n_words", F.col("i")).alias("n_words"), "length")
    named = prefixes.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_words").alias("n_words"), F.max("parent").alias("parent"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), _root().alias("digest"), "conv_id", "n_convs", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("parent"))
    named = written(named.unionByName(root))
    children = named.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    parents = named.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = written(even(named).join(children, ["depth", "digest"], "left").join(even(parents), ["depth", "parent"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    weighed = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n_words"))
    sums = ["n_leaves", "saved_tokens"]
    under = _below(weighed.where("depth > 0").select("depth", "digest", "conv_id", *sums), levels, sums)
    under = under.unionByName(weighed.agg(*(F.sum(c).alias(c) for c in sums)).where("n_leaves IS NOT NULL").select(F.lit(0).cast("long").alias("depth"), _root().alias("digest"), *sums))
    ends = prefixes.where("depth = length").select("depth", "digest", "conv_id").unionByName(convs.where("length = 0").select(F.lit(0).cast("long").alias("depth"), _root().alias("digest"), "conv_id"))
    got = even(nodes).join(even(under), ["depth", "digest"]).join(even(ended(ends)), ["depth", "digest"], "left")
    return got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *sums, F.coalesce("ends_sha256", F.sha2(_root(), 256)).alias("ends_sha256"))


def nodes(messages: DataFrame) -> DataFrame:
    """The trie of ``messages(conv_id, turn, role, text)`` as they are: one row a node, with its least member, depth, the parent's least member (the root: null), members,
    children, leaves under it, the words that sharing saves under it, and the digest of the ids of the conversations that end in it."""
    turns = written(numbered_turns(messages))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    return trie(convs, even(turns).join(convs, "conv_id"))


def branched_nodes(messages: DataFrame) -> DataFrame:
    """``nodes`` of the conversations after ``branched``."""
    convs, turns = branched(written(numbered_turns(messages)))
    return trie(convs, turns)
