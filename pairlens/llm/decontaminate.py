"""Benchmark decontamination by spaced seeds (native).

Fixed masks pick some tokens of a window and ignore the others, so a window with a substituted token
still hashes alike under a mask that ignores its place. Test and training hashes are joined; each hit
fixes a diagonal (item, place in text minus place in item), along which all of the item is compared:
the best-scoring run (+1 for an equal token, -MISS for another) must hold enough equal tokens.

One plan for every size. Texts are cut into parts of PART tokens, so no row holds more than a part of a text once its
tokens are hashed. Two sieves of 2^SIEVE rows of 64 bits, whatever the benchmark's size, are made of the benchmark's hashes (of the first
two tokens, and masked) and broadcast; places that pass go on as (id, text, place, hash) alone and meet the hashes in a plain join. The distinct diagonals are
written; the texts that have any are read again, in parts, and each diagonal gets the one to few parts that it crosses. A full sieve
lets everything pass and the join does the work. Which joins broadcast follows from the written tables' sizes.

Tokens are the runs of letters and digits of the lower-cased text. Defined cases: null and empty texts
have no tokens and never match; items of fewer tokens than the narrowest mask match nothing; a row is known by its id and its
text, so rows that repeat both report the same pairs once, and of rows that share an id alone each reports its own
(the best of them is given); items that repeat an id are items of their own, of which the best is given; of equally good
overlaps of a pair the one with the shorter run, then the lower diagonal and the earlier end is given; a null id is reported as
null; a long text costs memory in proportion to its length, once; empty tables give an empty result; other columns are not
looked at, and ``clean`` keeps them (names that begin with ``__op1`` are ours).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import picked, whole_text, written

# The masks. 1 keeps a token, 0 ignores it; each keeps the first two.
MASKS = ("11101011", "110110101", "1101001011", "111011")
MISS = 2
#: A run counts as an overlap from so many equal tokens on, or this share of a shorter item.
LEAST_EQUAL, SHARE = 13, 0.8
#: Tokens in a part of a text; rows of the sieve, as a power of two.
PART, SIEVE = 256, 18
_WIDEST = max(map(len, MASKS))


def _hashes(table: DataFrame, text: Column, *keys: Column) -> DataFrame:
    words = table.select(*keys, F.split(F.lower(text), r"[^\p{L}\p{N}]+").alias("w"))
    return words.select(*words.columns[:-1], F.transform(F.array_remove("w", ""), lambda x: F.xxhash64(x)).alias("h"))


def _parts(texts: DataFrame, overlap: int) -> DataFrame:
    """The texts' hashes in parts: (..., block, part); a part also holds the first ``overlap`` tokens of the next."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("h") - 1, F.lit(0)), F.lit(PART))
    return texts.select(*texts.columns[:-1], F.posexplode_outer(F.transform(starts, lambda s: F.slice("h", s + 1, PART + overlap))).alias("block", "part"))


def _places(texts: DataFrame) -> DataFrame:
    """(..., block, part, i, pair): every place i of every part, and the hash of the two tokens that all masks keep first.

    Expressions from here to the seeds are compiled into one loop over the part, which stays where it is: only seeds are rows.
    """
    each = _parts(texts, _WIDEST - 1).select("*", F.posexplode_outer("part").alias("i", "a"))
    return each.where(f"i < {PART}").withColumn("pair", F.xxhash64("a", F.get("part", F.col("i") + 1))).drop("a")


def _seeds(places: DataFrame) -> DataFrame:
    """(..., pos, m): the masked hashes at the places."""
    of = lambda k, mask: F.xxhash64(F.lit(k), *(F.get("part", F.col("i") + j) for j, keep in enumerate(mask) if keep == "1"))
    masked = F.array(*(F.when(F.size("part") >= F.col("i") + len(mask), of(k, mask)) for k, mask in enumerate(MASKS)))
    pos = (F.col("block") * PART + F.col("i")).alias("pos")
    rest = [c for c in places.columns if c not in ("block", "part", "i")]
    return places.select(*rest, pos, F.explode_outer(masked).alias("m")).where("m IS NOT NULL")


def _sieved(frame: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """The rows of ``frame`` whose hash may be in ``index``: two bits of 64 in one of 2^SIEVE rows stand for a hash."""
    row = F.col(key).bitwiseAND(F.lit((1 << SIEVE) - 1)).alias("row")
    bits = F.expr(f"shiftleft(1L, CAST(shiftright({key}, {SIEVE}) & 63 AS INT)) | shiftleft(1L, CAST(shiftright({key}, {SIEVE + 6}) & 63 AS INT))")
    sieve = index.select(row, bits.alias("b")).groupBy("row").agg(F.bit_or("b").alias("bits"))
    return frame.withColumn("row", row).join(F.broadcast(sieve), "row").where(bits.bitwiseAND(F.col("bits")) == bits).drop("row", "bits")


def _overlap(doc: Column, item: Column) -> Column:
    """struct(equal, run, end) of the best run along two aligned arrays; null tokens are never equal."""
    equal = F.zip_with(F.slice(doc, 1, F.size(item)), item, lambda a, b: F.coalesce(a == b, F.lit(False)))
    start = F.struct(*(F.lit(0).alias(x) for x in ("score", "eq", "len", "i", "best", "equal", "run", "end")))

    def step(acc: Column, same: Column) -> Column:
        fresh = acc["score"] <= 0
        score = F.when(fresh, 0).otherwise(acc["score"]) + F.when(same, 1).otherwise(-MISS)
        eq = F.when(fresh, 0).otherwise(acc["eq"]) + F.when(same, 1).otherwise(0)
        n = F.when(fresh, 0).otherwise(acc["len"]) + 1
        better = score > acc["best"]
        pick = lambda new, old: F.when(better, new).otherwise(acc[old]).alias(old)
        return F.struct(score.alias("score"), eq.alias("eq"), n.alias("len"), (acc["i"] + 1).alias("i"), pick(score, "best"), pick(eq, "equal"), pick(n, "run"), pick(acc["i"] + 1, "end"))

    return F.aggregate(equal, start, step, lambda acc: F.struct(acc["equal"].alias("equal"), acc["run"].alias("run"), acc["end"].alias("end")))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tx, text): a row is known by its id and the hash of its text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(whole_text(text_col)).alias("tx"), whole_text(text_col).alias("text"))


def _same(left: tuple[str, str], right: tuple[str, str]) -> Column:
    return F.col(left[0]).eqNullSafe(F.col(right[0])) & (F.col(left[1]) == F.col(right[1]))


def _verified(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """(doc_id, tx, item_id, diagonal, o): every diagonal along which enough tokens agree, and its best run."""
    items = _hashes(benchmark, whole_text(item_text), F.col(item_col).alias("item_id"), F.xxhash64(whole_text(item_text)).alias("ix"))
    items = written(items.where(F.size("h") >= min(map(len, MASKS))).dropDuplicates(["item_id", "ix"]))
    index = written(_seeds(_places(items)).withColumnRenamed("pos", "ipos"))
    base = _named(docs, id_col, text_col)
    paired = _sieved(_places(_hashes(base, F.col("text"), F.col("doc_id"), F.col("tx"))), index, "pair")
    sifted = _sieved(_seeds(paired), index, "m")
    hits = written(sifted.join(index.drop("pair"), "m").select("doc_id", "tx", "item_id", "ix", (F.col("pos") - F.col("ipos")).alias("diagonal")).distinct())
    # Each text that was hit, once, in parts.
    hit = hits.select(F.col("doc_id").alias("d"), F.col("tx").alias("t")).distinct()
    again = base.join(hit, _same(("doc_id", "tx"), ("d", "t")), "left_semi")
    parts = _parts(_hashes(again, F.col("text"), F.col("doc_id"), F.col("tx")), 0).groupBy("doc_id", "tx", "block").agg(F.first("part").alias("part"))
    parts = parts.select(F.col("doc_id").alias("d"), F.col("tx").alias("t"), F.col("block").alias("b"), "part")
    # The parts that a diagonal crosses; one past the text's end finds none.
    begin = F.greatest("diagonal", F.lit(0))
    sized = hits.join(items.select(F.col("item_id").alias("j"), F.col("ix").alias("jx"), F.size("h").alias("n")), _same(("item_id", "ix"), ("j", "jx"))).drop("j", "jx")
    crossed = sized.select("*", F.explode_outer(F.sequence(F.expr(f"greatest(diagonal, 0) div {PART}").cast("int"), F.expr(f"greatest(diagonal + n - 1, 0) div {PART}").cast("int"))).alias("block"))
    met = crossed.join(parts, _same(("doc_id", "tx"), ("d", "t")) & (F.col("block") == F.col("b")))
    whole = met.groupBy("doc_id", "tx", "item_id", "ix", "diagonal", "n").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("ps"))
    first = F.get("ps", F.lit(0))["block"] * PART
    pad = F.array_repeat(F.lit(None).cast("long"), F.greatest(-F.col("diagonal"), F.lit(0)))
    aligned = whole.withColumn("flat", F.flatten(F.transform("ps", lambda p: p["part"]))).withColumn("doc", F.concat(pad, F.slice("flat", begin - first + 1, F.col("n")))).drop("ps", "flat")
    both = aligned.join(items.select(F.col("item_id").alias("j"), F.col("ix").alias("jx"), F.col("h").alias("item")), _same(("item_id", "ix"), ("j", "jx")))
    found = both.select("doc_id", "tx", "item_id", "diagonal", "n", _overlap(F.col("doc"), F.col("item")).alias("o"))
    return picked(found, F.col("o.equal") >= F.least(F.lit(LEAST_EQUAL), F.ceil(SHARE * F.col("n")))).drop("n")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, equal, run, doc_start, item_start): the best overlap of each pair that has one."""
    enough = _verified(docs, benchmark, id_col, text_col, item_col, item_text)
    best = enough.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("o.equal").alias("equal"), (-F.col("o.run")).alias("less"), (-F.col("diagonal")).alias("d"), (-F.col("o.end")).alias("e"))).alias("b"))
    start = -F.col("b.e") + F.col("b.less")
    return best.select("doc_id", "item_id", F.col("b.equal").cast("long").alias("equal"), (-F.col("b.less")).cast("long").alias("run"), (start - F.col("b.d")).cast("long").alias("doc_start"), start.cast("long").alias("item_start"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage; of rows that share an id each is judged by its own text."""
    bad = written(_verified(docs, benchmark, id_col, text_col, "item_id", "text").select(F.col("doc_id").alias("__op1_id"), F.col("tx").alias("__op1_bad")).distinct())
    return docs.withColumn("__op1_tx", F.xxhash64(whole_text(text_col))).join(bad, _same((id_col, "__op1_tx"), ("__op1_id", "__op1_bad")), "left_anti").drop("__op1_tx")
