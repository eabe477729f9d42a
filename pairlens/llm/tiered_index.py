"""Ranked lexical search over a tiered index (Arrow, partitioned by documents).

The index is a table of shards, one row for at most SHARD documents. A shard holds its terms' postings by impact, the highest first, in tiers: the first
TIERS[0] postings of a term in one column, the next in a second, all others in the last; and for each term and tier the residual bound, the
highest impact that is left below it. Reading a tier is reading its column.

A block of items is searched in rounds. The first reads the top tier of every shard and takes, for each item, the K-th highest score that is
certain so far. Then each shard proves what it can: an item is done in a shard if every document whose certain score and residual bounds reach that mark has no residue
left; else the pair of item and shard falls through to the next tier, and the shard is read again with one more column. The last tier leaves no residue, so every
item ends with exact scores. Each shard gives at most its own K best of an item, and the ranks are taken over those.

Scores are whole numbers. Terms are the runs of ASCII letters and digits and of all that is not ASCII, with A-Z lower-cased, and are known by their 64-bit hash. An index that
is made for known items keeps the postings of their terms alone, and of terms that share a slot of a sieve of fixed size with them.

Defined cases: null and empty texts have no terms and count for nothing; rows that share an id, copies included, are documents of their own, and so are items; equal scores
go by id, null first; items without a term, or none of whose terms occurs, get no row; very long texts are counted whole; empty tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import even, lean, whole_text, written

K = 20
#: Documents and postings of a shard; postings of a term in the upper tiers.
SHARD, POSTINGS, TIERS = 8192, 4_000_000, (128, 1024)
#: Items of a block and their terms; slots of the sieve.
ITEMS, TERMS, SIEVE = 256, 1 << 16, 1 << 20
#: Bytes that are part of a term, lower-cased; all others part terms.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

Batches = Iterator[pa.RecordBatch]


def _counted(text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of terms, hashes of the distinct ones, their counts."""
    import xxhash

    found = text.translate(_TERM).split()
    counts = Counter(found)
    return len(found), np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))


def items(benchmark: DataFrame) -> DataFrame:
    """(block, item, item_id, terms, counts): the items that have terms, numbered, in blocks of bounded size."""

    def run(parts: Batches) -> Batches:
        number, block, held, full = TaskContext.get().partitionId() << 40, TaskContext.get().partitionId() << 40, 0, 0
        for part in parts:
            out = []
            for i, t in zip(part.column(0), part.column(1), strict=True):
                n, terms, counts = _counted(t.as_py())
                if not n:
                    continue
                if held == ITEMS or full + len(terms) > TERMS:
                    block, held, full = block + 1, 0, 0
                held, full = held + 1, full + len(terms)
                out.append((block, number, i.as_py(), terms.tobytes(), counts.tobytes()))
                number += 1
            if out:
                b, k, i, t, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(k, pa.int64()), pa.array(i, part.schema.field(0).type), pa.array(t, pa.binary()), pa.array(c, pa.binary())], names=["block", "item", "item_id", "terms", "counts"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return written(benchmark.select("item_id", whole_text("text").cast("binary").alias("text")).mapInArrow(lean(run), f"block long, item long, item_id {kind}, terms binary, counts binary"))


def sieve(asked: DataFrame) -> np.ndarray:
    """Which of SIEVE slots hold a term of the items: of fixed size, however many there are."""

    def run(parts: Batches) -> Batches:
        for part in parts:
            slots = [np.frombuffer(t.as_py(), np.uint64) % SIEVE for t in part.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(slots)).astype(np.int64))], names=["slot"])

    kept = np.zeros(SIEVE, bool)
    kept[[r[0] for r in asked.select("terms").mapInArrow(run, "slot long").distinct().toLocalIterator()]] = True
    return np.packbits(kept)


def index(docs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """The tiered index of ``docs(doc_id, text)``, written; with ``asked`` (see ``items``) of their terms alone."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    slots = None if asked is None else sieve(asked)

    def count(parts: Batches) -> Batches:
        kept = None if slots is None else np.unpackbits(slots).astype(bool)
        for part in parts:
            ids, rows = [], []
            for i, t in zip(part.column(0), part.column(1), strict=True):
                n, terms, counts = _counted(t.as_py())
                if n:
                    if kept is not None:
                        stays = kept[terms % SIEVE]
                        terms, counts = terms[stays], counts[stays]
                    ids.append(i.as_py())
                    rows.append((n, terms.tobytes(), counts.astype(np.uint32).tobytes()))
            if rows:
                n, t, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, part.schema.field(0).type), pa.array(n, pa.int64()), pa.array(t, pa.binary()), pa.array(c, pa.binary())], names=["doc_id", "n", "terms", "counts"])

    counted = written(docs.select("doc_id", whole_text("text").cast("binary").alias("text")).mapInArrow(lean(count), f"doc_id {kind}, n long, terms binary, counts binary"))
    total = counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    n_docs, n_terms, depth = total["n"], total["l"], len(TIERS) + 1

    def shard(ids: list, ns: list[int], terms: list[np.ndarray], counts: list[np.ndarray], number: int) -> dict:
        t, tf = np.concatenate(terms), np.concatenate(counts).astype(np.int64)
        doc = np.repeat(np.arange(len(ids)), [len(x) for x in terms])
        m = np.array([75 + 25 * n * n_docs // n_terms for n in ns], np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        order = np.lexsort((doc, -impact, t))
        t, doc, impact = t[order], doc[order], impact[order]
        own, first, size = np.unique(t, return_index=True, return_counts=True)
        place = np.arange(len(t)) - np.repeat(first, size)
        tier = np.searchsorted(np.cumsum(TIERS), place, side="right")
        ends = np.cumsum([*TIERS, 1 << 40])
        sizes = np.diff(np.minimum(size[:, None], np.concatenate([[0], ends])), axis=1)
        left = size[:, None] > ends
        bounds = np.where(left, impact[np.minimum(first[:, None] + ends, max(len(t) - 1, 0))], 0) if len(t) else np.zeros((0, depth), np.int64)
        packed = {f"tier{k}": doc[tier == k].astype("<u2").tobytes() + impact[tier == k].astype("<u4").tobytes() for k in range(depth)}
        return {"shard": number, "n_docs": n_docs, "docs": ids, "terms": own.astype("<u8").tobytes(), "sizes": sizes.astype("<i4").tobytes(), "bounds": bounds.astype("<i4").tobytes(), **packed}

    def build(parts: Batches) -> Batches:
        number, schema, held, full = TaskContext.get().partitionId() << 32, None, ([], [], [], []), 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([shard(*held, number)], schema=schema)

        for part in parts:
            schema = schema or pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("docs", pa.list_(part.schema.field(0).type)), ("terms", pa.binary()), ("sizes", pa.binary()), ("bounds", pa.binary()), *((f"tier{k}", pa.binary()) for k in range(depth))])
            for i, n, t, c in zip(*part.columns, strict=True):
                terms = np.frombuffer(t.as_py(), np.uint64)
                if len(held[0]) == SHARD or (held[0] and full + len(terms) > POSTINGS):
                    yield close()
                    number, held, full = number + 1, ([], [], [], []), 0
                full += len(terms)
                for to, x in zip(held, (i.as_py(), n.as_py(), terms, np.frombuffer(c.as_py(), np.uint32)), strict=True):
                    to.append(x)
        if held[0]:
            yield close()

    shape = f"shard long, n_docs long, docs array<{kind}>, terms binary, sizes binary, bounds binary, " + ", ".join(f"tier{k} binary" for k in range(depth))
    return written(counted.mapInArrow(lean(build), shape)) if n_docs else spark.createDataFrame([], shape)


class _Block:
    """The items of a block as executors need them: vocabulary (sorted hashes), and per item the places in it and the weights."""

    def __init__(self, rows: list) -> None:
        terms = [np.frombuffer(r["terms"], np.uint64) for r in rows]
        self.items = [r["item"] for r in rows]
        self.vocabulary = np.unique(np.concatenate(terms))
        self.places = [np.searchsorted(self.vocabulary, t) for t in terms]
        self.counts = [np.frombuffer(r["counts"], np.int64) for r in rows]
        self.marks = np.zeros(len(rows), np.int64)

    def weigh(self, found: dict[int, int], n_docs: int) -> None:
        """``found``: how many documents hold the term at a place of the vocabulary."""
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * found.get(k, 0) + 1))) for k in range(len(self.vocabulary))], np.int64)
        self.weights = [c * w[p] for c, p in zip(self.counts, self.places, strict=True)]


def _by_term(data: bytes, n: int, depth: int = len(TIERS) + 1) -> np.ndarray:
    """Whole numbers by term and tier."""
    return np.frombuffer(data, "<i4").reshape(n, -1 if n else depth)


class _Shard:
    """One shard's postings of a block's vocabulary, down to a tier."""

    def __init__(self, row: dict, vocabulary: np.ndarray, level: int) -> None:
        terms = np.frombuffer(row["terms"], "<u8")
        at = np.minimum(np.searchsorted(terms, vocabulary), max(len(terms) - 1, 0))
        self.at = np.where(terms[at] == vocabulary, at, -1) if len(terms) else np.full(len(vocabulary), -1)
        sizes = _by_term(row["sizes"], len(terms))
        self.found = sizes.sum(1)
        self.bounds = _by_term(row["bounds"], len(terms))[:, level].astype(np.int64)
        self.docs, self.tiers = row["docs"], []
        for k in range(level + 1):
            n = int(sizes[:, k].sum())
            data = row[f"tier{k}"]
            stop = np.cumsum(sizes[:, k])
            self.tiers.append((stop - sizes[:, k], stop, np.frombuffer(data, "<u2", n), np.frombuffer(data, "<u4", n, 2 * n)))

    def scores(self, places: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(certain score, score with all residual bounds) of every document."""
        low, high = np.zeros(len(self.docs), np.int64), np.zeros(len(self.docs), np.int64)
        for at, w in zip(self.at[places], weights, strict=True):
            if at >= 0 and w:
                bound = self.bounds[at]
                high += w * bound
                for start, stop, doc, impact in self.tiers:
                    d, s = doc[start[at] : stop[at]], impact[start[at] : stop[at]].astype(np.int64)
                    low[d] += w * s
                    high[d] += w * (s - bound)
        return low, high


def _rows(parts: Batches) -> Iterator[dict]:
    for part in parts:
        for k in range(len(part)):
            yield part.slice(k, 1).to_pylist()[0]


def search(shards: DataFrame, asked: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item of ``asked`` (see ``items``) in the index ``shards``."""
    spark, kind = shards.sparkSession, shards.schema["docs"].dataType.elementType.simpleString()
    first = shards.select("n_docs").first()
    found = spark.createDataFrame([], f"item long, doc_id {kind}, score long")
    for name in [r[0] for r in asked.select("block").distinct().collect()] if first else []:
        found = found.unionByName(_searched(shards, _Block(asked.where(F.col("block") == name).collect()), first[0], kind, k))
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return even(ranked).join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _searched(shards: DataFrame, block: _Block, n_docs: int, kind: str, k: int) -> DataFrame:
    def held(parts: Batches) -> Batches:
        total = np.zeros(len(block.vocabulary), np.int64)
        for row in _rows(parts):
            got = _Shard(row, block.vocabulary, -1)
            total[got.at >= 0] += got.found[got.at[got.at >= 0]]
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["place", "n"])

    small = shards.select("terms", "sizes", "bounds", F.array().cast("array<long>").alias("docs"))
    block.weigh({r[0]: r[1] for r in small.mapInArrow(held, "place long, n long").groupBy("place").agg(F.sum("n")).collect()}, n_docs)

    def certain(parts: Batches) -> Batches:
        for row in _rows(parts):
            part, out = _Shard(row, block.vocabulary, 0), []
            for item, places, weights in zip(block.items, block.places, block.weights, strict=True):
                low, _ = part.scores(places, weights)
                if len(low) > k:
                    low = np.partition(low, len(low) - k)[-k:]
                out += [(item, x) for x in low[low > 0].tolist()]
            if out:
                item, low = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(low, pa.int64())], names=["item", "low"])

    # The k-th highest certain score of each item: no document below it can be among the k best.
    columns = ["shard", "docs", "terms", "sizes", "bounds"]
    sure = shards.select(*columns, "tier0").mapInArrow(lean(certain), "item long, low long")
    placed = sure.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.col("low").desc()))).where(F.col("place") <= k)
    marks = {r[0]: r[1] for r in placed.where(F.col("place") == k).select("item", "low").collect()}
    block.marks = np.array([marks.get(i, 0) for i in block.items], np.int64)
    number = {x: j for j, x in enumerate(block.items)}

    def prove(level: int):
        def run(parts: Batches) -> Batches:
            for row in _rows(parts):
                part, out = _Shard(row, block.vocabulary, level), []
                for j in [number[x] for x in row["items"]] if "items" in row else range(len(block.items)):
                    low, high = part.scores(block.places[j], block.weights[j])
                    can = (high >= block.marks[j]) & (high > 0)
                    if (low[can] < high[can]).any():
                        out.append((block.items[j], None, None, row["shard"]))
                        continue
                    at = np.flatnonzero(can)
                    if len(at) > k:
                        at = at[low[at] >= np.partition(low[at], len(at) - k)[-k]]
                    mine = sorted((-int(low[d]), part.docs[d] is not None, part.docs[d]) if part.docs[d] is not None else (-int(low[d]), False) for d in at)[:k]
                    out += [(block.items[j], x[2] if x[1] else None, -x[0], None) for x in mine]
                if out:
                    item, doc, score, shard = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, docs_type), pa.array(score, pa.int64()), pa.array(shard, pa.int64())], names=["item", "doc_id", "score", "shard"])

        from pyspark.sql.pandas.types import to_arrow_type

        docs_type = to_arrow_type(shards.schema["docs"].dataType.elementType)
        return lean(run)

    done, open_ = None, None
    for level in range(len(TIERS) + 1):
        read = shards.select(*columns, *(f"tier{t}" for t in range(level + 1)))
        if open_ is not None:
            read = read.join(open_, "shard")
        got = written(read.mapInArrow(prove(level), f"item long, doc_id {kind}, score long, shard long"))
        proven = got.where("score IS NOT NULL").select("item", "doc_id", "score")
        done = proven if done is None else done.unionByName(proven)
        left = got.where("shard IS NOT NULL")
        if left.isEmpty():
            break
        open_ = written(left.groupBy("shard").agg(F.collect_list("item").alias("items")))
    return done


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score) of every row of ``benchmark(item_id, text)`` over all ``docs(doc_id, text)``."""
    asked = items(benchmark)
    return search(index(docs, asked), asked, k)
