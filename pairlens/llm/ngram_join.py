"""N-gram Jaccard self-join by MinHash banding.

A text is the set of its 5-word shingles (its whole word sequence, where it has fewer words). Bands and
rows follow from the similarity and the wished recall; texts are shuffled on their band hashes, and texts that share one
are compared on their full shingle sets.

Nothing is expanded pair by pair in rows, and nothing is chained before it is verified. Exact copies are one text from the start.
Every text has a home: the least head (least member) of its buckets. A home's texts are dealt into blocks of about BLOCK texts and BLOCK_BYTES
bytes. Two blocks of a home meet in a task; where some bucket has texts of two homes, the larger is the host and the texts of all its guests, dealt into packs,
meet its blocks. A task holds two blocks, compares them in memory and returns one row per text: its number of links and the least text it is joined with there. Every verified link counts,
however large the bucket; among n different near copies the work is n*n/2 comparisons, in tasks of bounded size. Classes are the
connected verified links.

Result: one row per input row: doc_id, class_id (least id of the class), n_links (different texts of similarity THRESHOLD
or more that were met) and n_copies (rows of this very text, itself included).

Defined cases: a null text is an empty one; empty texts have no shingle and are joined as copies only; a
text of fewer than five words has one shingle; a text is known by its digest, so rows that repeat an id with different texts
are texts of their own, and with the same text copies; ids are of any type that has an order; a null id joins and takes the class of its
text, whose id is null where no text of it has one; ties of similarity do not matter (every link at THRESHOLD or more counts); a very long
text takes a block of its own size; empty tables give an empty result; other columns are not looked at, and ``one_of_each`` keeps
them (names that begin with ``__op9`` are ours).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected, even, lean, whole_text, written

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.995
#: Texts and bytes of a block.
BLOCK, BLOCK_BYTES = 200, 4 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, widest: int = 7) -> tuple[int, int]:
    """(bands, rows): as many rows as ``widest`` allows and the fewest bands that find a pair of just that similarity with that probability."""
    rows = widest
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(texts: list[bytes], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owner) of the texts' shingles, repeats included, for all texts at once.

    Words are hashed from prefix sums of byte * P^place (mod 2^64); a shingle mixes its word hashes.
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[joined]
    edge = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=np.int8(1)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    size = len(joined)
    powers = np.empty(size + 1, np.uint64)
    powers[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(size, _P), out=powers[1:])
        sums = np.empty(size + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_mix(np.arange(256, dtype=np.uint64) + np.uint64(1))[joined] * powers[:-1], out=sums[1:])
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        backs = np.empty(size, np.uint64)
        backs[0] = 1
        np.multiply.accumulate(np.full(size - 1, inverse), out=backs[1:])
        word = _mix((sums[ends] - sums[starts]) * backs[starts])
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        first = np.searchsorted(starts, at)
        count = np.diff(first)
        owner = np.repeat(np.arange(len(texts)), count)
        left = np.repeat(first[1:], count) - np.arange(len(starts))  # words from here to the text's end
        total = np.repeat(count, count)
        out = word.copy()
        for k in range(1, n):
            more = left > k
            out[:-k or None][more[: len(out) - k]] = _mix(out[: len(out) - k][more[: len(out) - k]] * np.uint64(31)) + word[k:][more[: len(out) - k]]
        out = _mix(out ^ np.minimum(left, n).astype(np.uint64))
        keep = (left >= n) | ((total < n) & (left == total))
    return out[keep], owner[keep]


def _batches(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) in runs of about that many bytes; only they are Python objects."""
    run, start = [], 0
    for at in range(0, len(column), 32):
        run += [t or b"" for t in column.slice(at, 32).cast(pa.binary()).to_pylist()]
        if sum(map(len, run)) >= most:
            yield start, run
            run, start = [], at + 32
    if run:
        yield start, run


def _signer(bands: int, rows: int):
    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        rng = np.random.default_rng(20260829)
        mul = rng.integers(1, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
        for batch in parts:
            for start, texts in _batches(batch.column(1)):
                hashes, owner = shingles(texts)
                low = (hashes >> np.uint64(32)).astype(np.uint32)
                begins = np.flatnonzero(np.diff(owner, prepend=-1)) if len(owner) else np.empty(0, np.int64)
                sig = np.zeros((len(begins), bands * rows), np.uint32)
                for k in range(bands * rows):
                    x = low * mul[k] + add[k]
                    x ^= x >> np.uint32(15)
                    x *= np.uint32(0x2C1B3C6D)
                    if len(begins):
                        sig[:, k] = np.minimum.reduceat(x, begins)
                band = np.zeros((len(texts), bands), np.int64)
                with np.errstate(over="ignore"):
                    for b in range(bands):
                        acc = np.full(len(begins), np.uint64(b + 1))
                        for r in range(rows):
                            acc = _mix(acc * np.uint64(31) + sig[:, b * rows + r].astype(np.uint64))
                        band[owner[begins] if len(begins) else [], b] = acc.view(np.int64)
                has = np.zeros(len(texts), bool)
                has[owner[begins] if len(begins) else []] = True
                offsets = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[has].ravel()))],
                    ["doc_id", "key", "size", "bands"],
                )

    return sign


def _inside(texts: list[bytes], half: np.ndarray, same_block: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each text among these; of two different blocks only the pairs across count."""
    n = len(texts)
    hashes, owner = shingles(texts)
    links, root = np.zeros(n, np.int64), np.arange(n)
    if not len(hashes):
        return links, root
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    size = np.bincount(owner, minlength=n)
    group = np.cumsum(np.concatenate([[True], hashes[1:] != hashes[:-1]])) - 1
    shared = np.bincount(group)[group] > 1
    group, who = group[shared], owner[shared]
    if not len(group):
        return links, root
    _, group = np.unique(group, return_inverse=True)
    both = np.zeros((n, n), np.float32)
    wide = 1 << 14
    for lo in range(0, int(group[-1]) + 1, wide):
        here = slice(*np.searchsorted(group, (lo, lo + wide)))
        grid = np.zeros((n, min(wide, int(group[-1]) + 1 - lo)), np.float32)
        grid[who[here], group[here] - lo] = 1
        both += grid @ grid.T
    near = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
    near &= both > 0
    if not same_block:
        near &= half[:, None] != half[None, :]
    np.fill_diagonal(near, False)
    links = near.sum(1)
    while True:  # the least member reached, by repeated minima
        up = np.minimum(root, np.where(near, root[None, :], n).min(1))
        up = up[up]
        if (up == root).all():
            return links, root
        root = up


def _rows(parts: Iterator[pa.RecordBatch], few: int = 64) -> Iterator[tuple]:
    """Rows whose last column is text, as bytes; a few at a time are Python objects."""
    for batch in parts:
        for at in range(0, batch.num_rows, few):
            *cols, text = batch.slice(at, few).columns
            yield from zip(*(c.to_pylist() for c in cols), text.cast(pa.binary()).to_pylist(), strict=True)


def _verifier(threshold: float):
    def emit(rows: list, task: tuple) -> pa.RecordBatch:
        keys, texts, half = [r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows])
        links, root = _inside(texts, half, task[1] == 0 and task[2] == task[3], threshold)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([keys[k] for k in root], pa.binary()), pa.array(links, pa.int64())], ["key", "to", "links"])

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, task = [], None
        for home, kind, i, j, half, key, text in _rows(parts):
            if (home, kind, i, j) != task:
                if len(held) > 1:
                    yield emit(held, task)
                held, task = [], (home, kind, i, j)
            held.append((key, text or b"", half))
        if len(held) > 1:
            yield emit(held, task)

    return verify


def _dealt(texts: DataFrame) -> DataFrame:
    """(key, least, home, kind, i, j, half): each text of ``texts(key, least, size, bands)`` that shares a bucket, once for every task it is in: blocks i and
    j of a home (kind 0), or block i of a host and pack j of its guests (kind 1). The half says which of the two a text is of."""
    h = F.xxhash64("key").alias("h")  # 64 bits do for homes: two texts that share them only meet in vain
    buckets = texts.select(h, F.explode_outer("bands").alias("hash")).where("hash IS NOT NULL")
    heads = written(buckets.groupBy("hash").agg(F.min("h").alias("head"), F.count("*").alias("n")).where("n > 1").select("hash", "head"))
    stars = buckets.join(even(heads), "hash")
    homes = written(stars.groupBy("h").agg(F.min("head").alias("home")))
    lodged = texts.select("key", "least", "size", h).join(even(homes), "h").drop("h")
    sized = lodged.groupBy("home").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    sized = written(sized.select("home", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"), "n", "bytes"))
    # Homes that some bucket joins. Nearly every bucket is of one home.
    mixed = written(stars.select("hash", "h").join(even(homes), "h").groupBy("hash", "home").agg(F.lit(1).alias("one")).select("hash", "home"))
    several = mixed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    mixed = mixed.join(several, "hash", "left_semi")
    joined = mixed.join(mixed.withColumnRenamed("home", "other"), "hash").where("home <> other").select("home", "other").distinct()
    # The larger home of such a pair is the host. The guests of a host are dealt into packs as large as blocks.
    size_of = lambda x: sized.select(F.col("home").alias(x), F.col("n").alias(f"{x}_n"), F.col("bytes").alias(f"{x}_bytes"), F.col("blocks").alias(f"{x}_blocks"))
    pairs = joined.join(size_of("home"), "home").join(size_of("other"), "other").where("home_n > other_n OR (home_n = other_n AND home < other)")
    packs = F.greatest(F.ceil(F.sum("other_n") / BLOCK), F.ceil(F.sum("other_bytes") / BLOCK_BYTES)).cast("int")
    hosts = written(pairs.groupBy("home").agg(packs.alias("packs"), F.first("home_blocks").alias("host_blocks")))
    visits = written(pairs.select("home", "other").join(hosts, "home").select(F.col("home").alias("host"), F.col("other").alias("home"), "packs", "host_blocks"))
    placed = written(lodged.join(sized.select("home", "blocks", "n"), "home").select("key", "least", "home", "n", "blocks", F.pmod(F.xxhash64(F.lit("block"), "key"), F.col("blocks")).cast("int").alias("block")))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inside = placed.where("n > 1").select("key", "least", "home", "block", upto("blocks").alias("o"))
    inside = inside.select("key", "least", "home", F.lit(0).alias("kind"), F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), (F.col("block") > F.col("o")).cast("int").alias("half"))
    host = placed.join(hosts, "home").select("key", "least", "home", F.lit(1).alias("kind"), F.col("block").alias("i"), upto("packs").alias("j"), F.lit(0).alias("half"))
    guest = placed.join(visits, "home").select("key", "least", "host", "packs", upto("host_blocks").alias("i"))
    guest = guest.select("key", "least", F.col("host").alias("home"), F.lit(1).alias("kind"), "i", F.pmod(F.xxhash64("key", "host"), F.col("packs")).cast("int").alias("j"), F.lit(1).alias("half"))
    return inside.unionByName(host).unionByName(guest)


def _classed(docs: DataFrame, id_col: str, text_col: str, threshold: float, recall: float) -> DataFrame:
    """(doc_id, key, class_id, chosen, n_links, n_copies), one row per row of ``docs``; ``chosen``: the key of the class's text of the least id."""
    bands, rows = bands_for(threshold, recall)
    base = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    signed = written(base.mapInArrow(lean(_signer(bands, rows)), f"doc_id {kind}, key binary, size long, bands array<long>"))
    texts = written(signed.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    dealt = written(_dealt(texts))
    # The text of a digest is that of a row of its least id; rows that repeat it are one.
    asked = written(dealt.select("key", "least").distinct().select(F.col("key").alias("k"), "least"))
    own = base.withColumn("key", digest(F.col("text"))).join(even(asked), (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("key", "text").dropDuplicates(["key"])
    task = ["home", "kind", "i", "j"]
    filled = dealt.select(*task, "half", "key").join(even(own), "key").select(*task, "half", "key", "text")
    found = written(filled.repartition(*task).sortWithinPartitions(*task).mapInArrow(lean(_verifier(threshold)), "key binary, to binary, links long"))
    links = found.groupBy("key").agg(F.sum("links").alias("n_links"))
    joined = connected(found.select(F.col("key").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "key")
    members = written(joined.join(texts.select("key", "least"), "key"))
    best = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("class_id"), F.col("key").alias("chosen")))
    named = written(members.groupBy("root").agg(best.alias("b")).select("root", "b.class_id", "b.chosen"))
    of_class = written(members.join(named, "root").join(links, "key", "left").select("key", "class_id", "chosen", "n_links", F.lit(True).alias("joined")))
    told = texts.select("key", "least", "n_copies").join(even(of_class), "key", "left")
    told = told.select("key", F.when(F.col("joined"), F.col("class_id")).otherwise(F.col("least")).alias("class_id"), F.coalesce("chosen", "key").alias("chosen"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    return signed.select("doc_id", "key").join(even(told), "key").select("doc_id", "key", "class_id", "chosen", "n_links", "n_copies")


def digest(text: Column) -> Column:
    """The digest by which a text is known."""
    return F.unhex(F.md5(text.cast("binary")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies), one row per row of ``docs``."""
    return _classed(docs, id_col, text_col, threshold, recall).select("doc_id", "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of each class: its least id with the least digest of that id's texts; of rows that repeat both any one. Without any id, any one of the least digest."""
    rows = written(_classed(docs, id_col, text_col, threshold, recall).select(F.col("doc_id").alias("__op9_id"), F.col("key").alias("__op9_of"), "class_id", "chosen"))
    chosen = (F.col("__op9_of") == F.col("chosen")) & F.col("__op9_id").eqNullSafe(F.col("class_id"))
    names = ["__op9_id", "__op9_of"]
    more = written(rows.where(~chosen).select(*names).distinct())
    again = written(rows.where(chosen).groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").select(*names))
    # A lost class never drops a row: rows are taken out, not picked.
    here = F.col(id_col).eqNullSafe(F.col("__op9_id")) & (F.col("__op9_key") == F.col("__op9_of"))
    left = docs.withColumn("__op9_key", digest(whole_text(text_col))).join(even(more), here, "left_anti")
    if not again.isEmpty():
        left = left.join(again, here, "left_anti").unionByName(left.join(again, here, "left_semi").dropDuplicates([id_col, "__op9_key"]))
    return left.drop("__op9_key")
