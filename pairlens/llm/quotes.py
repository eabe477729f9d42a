"""Chat formatting by quotation linking (native).

A line's quote level is the number of ``>`` marks it begins with. Runs of quoted lines of one level are
passages; a passage is normalised (marks off, lower case, blanks collapsed) and hashed, and so is
every message, each of its unquoted paragraphs, and each run of its unquoted lines that begins with the first line of a passage and is as long.
A passage links its message to the first message (conversation, turn) that holds the text: in the same conversation before it, or
else in any other. Messages are then ordered as replies: the parent first, then its answers, by turn; quoted lines leave the text.

No conversation is gathered in one place. Turns are numbered over the whole table by range, so a conversation of any length is spread
over tasks; one without links to other than the turn before is in order then. Where answers branch, the order is the tour of the reply tree: each
turn is entered and left, each step knows the next, and doubling the steps gives every turn its distance from the end in
logarithmically many joins on unique keys.

Defined cases: null and empty texts have no quotes and are no originals; a quote of nothing known stays without
parent, and the turn before is the parent then; passages of fewer than LEAST characters link inside their own conversation alone; of several
holders the least conversation and turn counts, and of several passages of a message the shallowest, the last of them in the text; repeated
rows are kept as they are and share keys: they have one place; null conversations or turns are carried without a parent or place; a message of
many lines costs memory in proportion to its length; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import whole_text, written

MARKS = r"^(?:[\x20\t]*>)+[\x20\t]?"
#: Passages of fewer characters link inside their own conversation alone.
LEAST = 12


def normal(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, turn, role, text)`` with ``own`` (text without quoted lines), ``depth`` (deepest level) and
    ``passages`` (normalised quoted runs: level, body, number of lines that are not blank, and the first of them)."""
    marks = lambda x: F.regexp_extract(x, MARKS, 0)
    level = lambda x: F.char_length(marks(x)) - F.char_length(F.replace(marks(x), F.lit(">"), F.lit("")))
    lines = F.transform(F.split("text", "\n"), lambda x: F.when(F.contains(x, F.lit(">")), F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("body"))).otherwise(F.struct(F.lit(0).alias("level"), x.alias("body"))))
    made = messages.withColumn("lines", lines)
    at = lambda i: F.get("lines", i)["level"]
    # A run ends where the level changes; a deeper run inside is a passage of its own.
    made = made.withColumn("edges", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (at(i) != at(i - 1))))
    run = lambda s, k: F.struct(at(s).alias("level"), F.transform(F.slice("lines", s + 1, F.coalesce(F.get("edges", k + 1), F.size("lines")) - s), lambda x: x["body"]).alias("ls"))
    made = made.withColumn("runs", F.filter(F.transform("edges", run), lambda r: r["level"] > 0))
    whole = lambda r: F.struct(r["level"].alias("level"), normal(F.array_join(r["ls"], "\n")).alias("body"), F.filter(F.transform(r["ls"], normal), lambda x: x != "").alias("ls"))
    told = lambda r: F.struct(r["level"].alias("level"), r["body"].alias("body"), F.size(r["ls"]).alias("n_lines"), F.get(r["ls"], F.lit(0)).alias("head"))
    own = F.btrim(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n"), F.lit("\n"))
    out = made.withColumn("own", F.when(F.size("runs") > 0, own).otherwise(F.col("text"))).withColumn("depth", F.coalesce(F.array_max(F.transform("runs", lambda r: r["level"])), F.lit(0)))
    return out.withColumn("passages", F.transform(F.transform("runs", whole), told)).drop("lines", "edges", "runs")


def _originals(found: DataFrame, sought: DataFrame) -> DataFrame:
    """(conv_id, turn, body, h): the whole texts, paragraphs and runs of lines whose hash is asked for. Rows of messages hold no more than
    a message; its lines travel one by one, as hashes."""
    known = found.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "own")
    parts = F.array_distinct(F.concat(F.array(normal(F.col("own"))), F.transform(F.split("own", r"\n\s*\n"), normal)))
    whole = known.select("conv_id", "turn", F.explode_outer(parts).alias("body")).where("body <> ''").withColumn("h", F.xxhash64("body"))
    asked = written(sought.select("h").distinct())
    lined = known.select("conv_id", "turn", F.filter(F.transform(F.split("own", "\n"), normal), lambda x: x != "").alias("ls"))
    heads = written(sought.where("n_lines > 0").select(F.xxhash64("head").alias("x"), "n_lines").distinct())
    places = lined.select("conv_id", "turn", F.posexplode_outer(F.transform("ls", lambda x: F.xxhash64(x))).alias("i", "x")).join(heads, "x").select("conv_id", "turn", "i", "n_lines").distinct()
    places = places.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "i", "n_lines")
    met = lined.join(written(places), (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")) & (F.col("i") + F.col("n_lines") <= F.size("ls")))
    runs = met.select("conv_id", "turn", F.array_join(F.slice("ls", F.col("i") + 1, F.col("n_lines")), " ").alias("body")).withColumn("h", F.xxhash64("body"))
    return whole.join(asked, "h", "left_semi").unionByName(runs.join(asked, "h", "left_semi"))


def linked(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, own, depth, n_passages, n_linked, parent_conv, parent_turn) for every message."""
    base = conversations.select("conv_id", "turn", "role", whole_text("text").alias("text"))
    found = parsed(base)
    sought = found.select("conv_id", "turn", F.posexplode_outer("passages").alias("k", "p")).where("p.body <> ''").select("conv_id", "turn", "k", "p.*")
    sought = written(sought.withColumn("h", F.xxhash64("body")))
    known = ("conv_id", "turn", "role", "own", F.col("depth").cast("long").alias("depth"), F.size("passages").cast("long").alias("n_passages"))
    if sought.isEmpty():  # nothing is quoted, so nothing is sought and no message has a link
        none = lambda c: F.lit(None).cast(base.schema[c].dataType)
        return found.select(*known, F.lit(0).cast("long").alias("n_linked"), none("conv_id").alias("parent_conv"), none("turn").alias("parent_turn"))
    # The first holder of a text stands for all: hot texts are combined before the shuffle.
    inside = written(_originals(found, sought).groupBy("h", "body", "conv_id").agg(F.min("turn").alias("t")))
    holder = F.min(F.struct("conv_id", F.col("t").alias("turn")))
    firsts = written(inside.groupBy("h", "body").agg(holder.alias("first")))
    # For a passage of the first holder's own conversation: the first of the others.
    others = inside.join(firsts, ["h", "body"]).where("conv_id <> first.conv_id").groupBy("h", "body").agg(holder.alias("second"))
    any_first = written(firsts.join(others, ["h", "body"], "left"))
    here = sought.join(inside, ["h", "body", "conv_id"], "left").withColumn("here", F.when(F.col("t") < F.col("turn"), F.struct("conv_id", F.col("t").alias("turn")))).drop("t")
    there = here.join(any_first, ["h", "body"], "left").withColumn("there", F.when(F.char_length("body") >= LEAST, F.when(F.col("first.conv_id").eqNullSafe(F.col("conv_id")), F.col("second")).otherwise(F.col("first"))))
    links = there.select("conv_id", "turn", "level", "k", F.coalesce("here", "there").alias("to")).where("to IS NOT NULL")
    # The parent is the original of the shallowest passage, the last of them in the text.
    parent = links.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("l"), "k", "to")).alias("m"), F.count_distinct("level", "k").alias("n_linked")).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("m.to").alias("to"), "n_linked")
    joined = found.join(written(parent), (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    return joined.select(*known, F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("to.conv_id").alias("parent_conv"), F.col("to.turn").alias("parent_turn"))


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """The rows with ``g``, their number from 0 in the order of ``by``: sorted by range, numbered in each part, and the parts' sizes added up."""
    parts = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("p", F.spark_partition_id()).withColumn("m", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    # One row a part, however many rows there are.
    sizes = parts.groupBy("p").agg(F.count("*").alias("n"))
    before = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))
    return parts.join(F.broadcast(before), "p").withColumn("g", F.col("before") + F.col("m")).drop("p", "m", "before")


def _tour(nodes: DataFrame) -> DataFrame:
    """(g, rest) of ``nodes(g, pg)``, pg the g of the parent: how many nodes the tour enters from here on, this one included."""
    answers = written(in_order(nodes.where("pg IS NOT NULL").withColumnRenamed("g", "v"), "pg", "v"))
    nexts = answers.select((F.col("g") - 1).alias("g"), F.col("v").alias("sibling"), F.col("pg").alias("of"))
    siblings = answers.join(nexts, "g").where("pg = of").select(F.col("v").alias("g"), "sibling")
    first = answers.groupBy(F.col("pg").alias("g")).agg(F.min("v").alias("child"))
    known = nodes.join(first, "g", "left").join(siblings, "g", "left")
    step = lambda i, n, w: F.struct(i.alias("id"), n.alias("next"), F.lit(w).cast("long").alias("w"))
    enter = step(2 * F.col("g"), F.coalesce(2 * F.col("child"), 2 * F.col("g") + 1), 1)
    leave = step(2 * F.col("g") + 1, F.coalesce(2 * F.col("sibling"), 2 * F.col("pg") + 1), 0)
    steps = written(known.select(F.explode_outer(F.array(enter, leave)).alias("s")).select("s.*"))
    while not steps.where("next IS NOT NULL").isEmpty():  # each round doubles the reach
        ahead = steps.select(F.col("id").alias("next"), F.col("next").alias("after"), F.col("w").alias("more"))
        moved = steps.where("next IS NOT NULL").join(ahead, "next").select("id", F.col("after").alias("next"), (F.col("w") + F.col("more")).alias("w"))
        steps = written(moved.unionByName(steps.where("next IS NULL")))
    return steps.where("id % 2 = 0").select((F.col("id") / 2).cast("long").alias("g"), F.col("w").alias("rest"))


def threads(conversations: DataFrame) -> DataFrame:
    """The messages of ``linked`` in reply order: ``reply_to`` (the linked turn of the same conversation, or else
    the turn before), ``place`` (from 0 within the conversation, parents before answers) and the text without quotes."""
    found = linked(conversations)
    own_parent = F.when(F.col("parent_conv") == F.col("conv_id"), F.col("parent_turn"))
    turns = found.select("conv_id", "turn", own_parent.alias("to")).where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("to").alias("to"))
    turns = written(in_order(turns, "conv_id", "turn"))
    before = turns.select((F.col("g") + 1).alias("g"), F.col("conv_id").alias("c"), F.col("turn").alias("before"))
    turns = turns.join(before, "g", "left").withColumn("before", F.when(F.col("c") == F.col("conv_id"), F.col("before"))).drop("c")
    turns = written(turns.withColumn("reply_to", F.coalesce("to", "before")))
    spans = written(turns.groupBy("conv_id").agg(F.min("g").alias("begin"), F.count("*").alias("n"), F.bool_or(F.col("to") != F.col("before")).alias("branches")))
    placed = turns.join(spans.where("NOT coalesce(branches, false)").select("conv_id", "begin"), "conv_id").select("conv_id", "turn", "reply_to", (F.col("g") - F.col("begin")).alias("place"))
    forked = spans.where("branches")
    if not forked.isEmpty():
        mine = written(turns.join(forked.select("conv_id", "n"), "conv_id").select("conv_id", "turn", "reply_to", "g", "n"))
        heads = mine.select("conv_id", F.col("turn").alias("reply_to"), F.col("g").alias("pg"))
        rest = _tour(written(mine.join(heads, ["conv_id", "reply_to"], "left").select("g", "pg")))
        placed = placed.unionByName(mine.join(rest, "g").select("conv_id", "turn", "reply_to", (F.col("n") - F.col("rest")).alias("place")))
    placed = written(placed.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "reply_to", "place"))
    out = found.join(placed, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    return out.select("conv_id", "place", "turn", "reply_to", "role", F.col("own").alias("text"), "depth", "n_passages", "n_linked", "parent_conv", "parent_turn")
