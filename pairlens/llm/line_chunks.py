"""Line dedup by content-defined chunks (native).

The lines of a text that hold a word are hashed; blank ones part nothing. A rolling hash over the last two line hashes puts a boundary
where SPREAD divides it, so boundaries depend on nearby lines only and survive shifts. A chunk runs from the first line of one
boundary's window to the first line of the next one's, so that neighbouring chunks share a line and none has less than two. Chunks are counted
over all texts by their line hashes, the lines of those seen again are compared by bytes, and every occurrence but the first
(least id, then hash of the text, then place) is removed with the blank lines inside it. A line of LONG words or more is a passage and counts as a
chunk of its own.

SPREAD = 1, as shipped, makes every window of two lines a boundary. A wider spread gives fewer and longer chunks and misses the passages
whose edges fall inside them: at 3, of passages of 2, 4, 8 and 20 lines in new surroundings 96, 79, 53 and 24 % of the lines stay, on average. At
1 a repeated run of two lines or more goes from its first line to its last. The first occurrence of a line is in no repeat, so no line
leaves the corpus.

Defined cases: a null or empty text has no chunk and stays as it is; texts of one short line stay; a row is known by its id and its text: rows that
repeat both keep or lose the same lines, rows that share an id alone are texts of their own; a null id is an id, before all others;
a chunk that overlaps its own first occurrence stays; a long text costs memory in proportion to its length; an empty table stays empty;
other columns stay, and ours begin with ``__op8``. Chunks with a line that shares its hash with another line stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, even, picked, whole_text, written

SPREAD, LONG = 1, 50
_BASE, _MOD = 1000003, 2147483647


def _line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def _wordy(line: Column) -> Column:
    return (F.char_length(line) >= 2 * LONG - 1) & (F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")) >= LONG)


def _worded(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD) -> DataFrame:
    """(doc_id, tx, start, end, key): the chunks by their first and last line, from 0, and their line hashes.

    Built in steps, each a column of its own, so that no step is evaluated again inside a lambda.
    """
    text = whole_text(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tx"), F.split(text, "\n").alias("lines"))
    lines = base.withColumn("ls", F.filter(F.transform("lines", lambda x, i: F.when(_worded(x), F.struct(i.alias("i"), _line_hash(x).alias("h"), _wordy(x).alias("long")))), lambda x: x.isNotNull())).drop("lines")
    parted = lines.withColumn("at", F.col("ls.i")).withColumn("hs", F.col("ls.h"))
    last = F.size("hs") - 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    if spread > 1:  # the rolling value r(i) = (r(i-1) - h(i-2)*BASE)*BASE + h(i) of two lines, in closed form
        line = lambda i: F.pmod(F.get("hs", i), F.lit(_MOD))
        places = F.filter(places, lambda i: F.pmod(F.pmod(line(i - 1) * _BASE + line(i), F.lit(_MOD)), F.lit(spread)) == 0)
    edges = parted.withColumn("edges", F.array_distinct(F.concat(F.array(F.lit(0)), F.transform(places, lambda i: i - 1), F.array(F.greatest(last, F.lit(0))))))
    chunk = lambda a, b: F.struct(F.get("at", a).alias("start"), F.get("at", b).alias("end"), F.slice("hs", a + 1, b - a + 1).alias("key"))
    of_lines = F.zip_with(F.slice("edges", F.lit(1), F.size("edges") - 1), F.slice("edges", F.lit(2), F.size("edges") - 1), chunk)
    long = F.transform(F.filter("ls", lambda x: x["long"]), lambda x: F.struct(x["i"].alias("start"), x["i"].alias("end"), F.array(x["h"]).alias("key")))
    return edges.select("doc_id", "tx", F.explode_outer(F.concat(of_lines, long)).alias("c")).where("c IS NOT NULL").select("doc_id", "tx", "c.*")


def _covered(spans: Column) -> Column:
    """The lines of spans."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"]))))


def _same_row(id_col: str, tx: Column, row: str) -> Column:
    return F.col(id_col).eqNullSafe(F.col(f"{row}_id")) & (tx == F.col(f"{row}_tx"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD) -> DataFrame:
    """(doc_id, tx, spans): the spans of lines, first and last, of the chunks that repeat an earlier one."""
    each = written(chunks(docs, id_col, text_col, spread))
    # Hot keys are combined before the shuffle; the joins have a plain exchange on either side, which can be split.
    again = written(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    seen = written(each.join(even(again), "key", "left_semi"))
    first = written(seen.groupBy("key").agg(F.min(F.struct("doc_id", "tx", "start", "end")).alias("first")))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tx") == F.col("first.tx")) & (F.col("start") <= F.col("first.end"))
    later = seen.join(even(first), "key").where(~own).select("key", "doc_id", "tx", "start", "end")
    # The lines of such chunks meet as texts, each once a document.
    rows = seen.groupBy("doc_id", "tx").agg(F.collect_set(F.struct("start", "end")).alias("spans")).select(F.col("doc_id").alias("__op8_id"), F.col("tx").alias("__op8_tx"), "spans")
    text = whole_text(text_col)
    met = docs.join(even(written(rows)), _same_row(id_col, F.xxhash64(text), "__op8")).select(F.split(text, "\n").alias("lines"), _covered(F.col("spans")).alias("wanted"))
    bodies = met.select(F.explode_outer(F.array_distinct(F.filter(F.transform("wanted", lambda i: F.get("lines", i)), _worded))).alias("body")).where("body IS NOT NULL")
    shared = written(bodies.groupBy(_line_hash(F.col("body")).alias("h"), "body").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    if not shared.isEmpty():
        doubtful = first.select("key", F.explode("key").alias("h")).join(shared, "h").select("key").distinct()
        later = later.join(doubtful, "key", "left_anti")
    return later.groupBy("doc_id", "tx").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False, spread: int = SPREAD) -> DataFrame:
    """The table with repeated chunks taken out of its texts; other columns as they are.

    ``drop_emptied``: rows of which no word is left go; rows that had none stay.
    """
    gone = written(repeats(docs, id_col, text_col, spread).select(F.col("doc_id").alias("__op8_id"), F.col("tx").alias("__op8_tx"), F.col("spans").alias("__op8_spans")))
    joined = docs.join(even(gone), _same_row(id_col, F.xxhash64(whole_text(text_col)), "__op8"), "left").drop("__op8_id", "__op8_tx")
    out = joined.withColumn("__op8_lines", F.when(F.col("__op8_spans").isNotNull(), F.split(whole_text(text_col), "\n")))
    out = out.withColumn("__op8_kept", F.array_except(F.sequence(F.lit(0), F.size("__op8_lines") - 1), _covered(F.col("__op8_spans"))))
    out = out.withColumn("__op8_left", F.array_join(F.transform("__op8_kept", lambda i: F.get("__op8_lines", i)), "\n")).drop("__op8_lines", "__op8_kept", "__op8_spans")
    if drop_emptied:
        out = picked(out, F.coalesce(_worded(F.col("__op8_left")), F.lit(True)))
    return out.withColumn(text_col, F.coalesce("__op8_left", F.col(text_col))).drop("__op8_left")
