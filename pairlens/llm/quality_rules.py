"""Quality rules as a bitmask ledger (native).

Every rule is evaluated once per text. The ledger keeps the measurements and one bit per failed rule;
policies are versioned masks over those bits, and ablations are bitwise aggregates of the ledger, so
neither reads a text again.

Defined cases: a null or empty text has no words and fails ``few_words``; a null id is carried through;
repeated rows give repeated ledger rows; an empty table gives an empty ledger; other columns of the
input are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, whole_text, words

#: Windows of so many words count as repeated.
WINDOW = 8
#: (name, failing condition over the measurements), by bit. New rules go to the end: bits are never reused.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("shouting", "n_words >= 20 AND 10 * n_upper > 6 * word_chars"),
    ("exclaiming", "n_words >= 20 AND 10 * n_exclaim > 4 * n_words"),
    ("repeated_lines", "n_words >= 20 AND n_dup_lines >= 5 AND 10 * n_dup_lines > 8 * n_lines"),
    ("stuttering", "n_words >= 20 AND 10 * n_stutter > 4 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Policies by version: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols"),
    "v2": ("few_words", "repeated_windows", "symbols", "shouting", "exclaiming", "repeated_lines"),
    "v3": ("few_words", "repeated_windows", "symbols", "shouting", "exclaiming", "repeated_lines", "stuttering"),
}
CURRENT = "v3"


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _pairs(hashes: Column, step: int) -> Column:
    """Each hash joined with the one ``step`` places on; the last ones pair with null and are cut off later."""
    return F.zip_with(hashes, F.slice(hashes, step + 1, F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and every measurement the rules use.

    Repeated windows are found inside the row: window hashes come from three doubling passes, a set
    comparison settles most texts, and only texts with a repeat sort their windows.
    """
    text = whole_text(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    split = base.select("doc_id", "text", words(F.col("text")).alias("w"), lines.alias("lines"))
    counted = split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[A-Z\p{Lu}]+", ""))).cast("long").alias("n_upper"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"!+", ""))).cast("long").alias("n_exclaim"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    after = F.slice("h", 2, F.greatest(F.size("h"), F.lit(1)))
    counted = counted.withColumn("n_stutter", F.size(F.filter(F.zip_with("h", after, lambda a, b: a == b), lambda same: same)).cast("long"))
    for step in (1, 2, 4):
        counted = counted.withColumn("h", _pairs(F.col("h"), step))
    windows = counted.withColumn("h", F.slice("h", 1, F.greatest(F.col("n_words").cast("int") - F.lit(WINDOW - 1), F.lit(0))))
    ordered = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    windows = windows.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), ordered))
    twice = F.filter("s", lambda e, i: (e["x"] == F.get("s", i - 1)["x"]) | (F.coalesce(e["x"] == F.get("s", i + 1)["x"], F.lit(False))))
    windows = windows.withColumn("at", F.array_sort(F.transform(twice, lambda e: e["i"])))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("end")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i + WINDOW - F.greatest(acc["end"], F.lit(0)))).alias("n"), (i + WINDOW).alias("end")),
        lambda acc: acc["n"],
    )
    return windows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(F.when(F.size("at") > 0, covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_upper", "n_exclaim", "n_lines", "n_stutter",
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and ``fail_bits``, one bit per failed rule."""
    bits = sum((F.when(F.expr(test), F.lit(BIT[name])).otherwise(F.lit(0)) for name, test in RULES), F.lit(0))
    return measurements(docs, id_col, text_col).withColumn("fail_bits", bits.cast("long"))


def keeps(policy: str = CURRENT, bits: Column | str = "fail_bits") -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(found: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(rule, failed, only, kept_without): rows that fail the rule, that fail no other rule of the policy,
    and that the policy without the rule keeps. One aggregation to at most 2^rules rows, then bit tests."""
    seen = found.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in POLICIES[policy])))
    each = seen.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    when = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)).alias
    has, rest = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    return each.groupBy("rule").agg(when(has)("failed"), when(has & (rest == 0))("only"), when(rest == 0)("kept_without"))
