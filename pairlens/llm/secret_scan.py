"""Secret scans (native): three fixed patterns, and sliding-window entropy over candidate strings.

A span is ``kind:start:end`` in code points of the whole match, end exclusive. The fixed kinds are
``assign``, ``access`` and ``hex``; the method adds ``entropy`` spans and never takes a fixed one away.

Entropy: candidates are runs of 20 or more base64 characters that hold letters and digits. In each, a
window of WINDOW characters slides one character at a time. Kept incrementally (one character added, one taken away): the counts of the
window's own characters, at most WINDOW of them, the sum of c*log2(c), which gives the entropy, and how many are digits and
hexadecimal letters. These say which class the window is of: digits and hexadecimal letters alone, or more of the base64
alphabet; windows of digits alone are of none. A candidate with a window that reaches its class's threshold is a span,
unless the allow-list knows the candidate.

Defined cases: a null or empty text has no spans; spans that begin together are listed by kind; a null id is carried; repeated rows
repeat; a long text's matches are placed in groups of GROUP, so the work does not grow with the square of their number; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

# The three kinds, in the order they are listed.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits per character that are too many for text, by class: hexadecimal letters and digits, and any of the candidates' characters.
HEX_BITS, ANY_BITS = 3.0, 3.7
#: Matches that are placed together.
GROUP = 256
#: Candidates that are known to be harmless: UUIDs, plain numbers and dates, and marked examples.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
    r"(?i)example|placeholder|changeme|x{8}",
)
#: c*log2(c), by c.
_PLOGP = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


_SPANS = "array<struct<start:int,kind:int,end:int,body:string>>"


def _found(frame: DataFrame, kind: str, pattern: str, least: int, test: Column) -> DataFrame:
    """``frame`` with a column ``kind``, array<struct(start, kind, end, body)>: leftmost matches that do not overlap, of at least that
    length, in the texts that pass the cheap test.

    The pieces between the matches and the matches themselves give the places: no match is searched twice. Matches are placed within
    groups, and groups by the lengths before them.
    """
    keep = frame.columns
    hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    sizes = lambda hs, ps: F.zip_with(F.slice(ps, 1, F.size(hs)), hs, lambda p, m: F.struct(F.char_length(p).alias("gap"), F.char_length(m).alias("n"), m.alias("m")))
    none = F.array().cast("array<struct<gap:int,n:int,m:string>>")
    made = frame.withColumn("__hits", F.when(test, hits)).withColumn("__parts", F.when(test, F.split("text", pattern, -1)))
    made = made.withColumn("__sizes", F.coalesce(sizes(F.col("__hits"), F.col("__parts")), none)).drop("__hits", "__parts")
    starts = F.when(F.size("__sizes") > 0, F.sequence(F.lit(0), F.size("__sizes") - 1, F.lit(GROUP))).otherwise(F.array().cast("array<int>"))
    made = made.withColumn("__groups", F.transform(starts, lambda s: F.slice("__sizes", s + 1, GROUP))).drop("__sizes")
    made = made.withColumn("__long", F.transform("__groups", lambda g: F.aggregate(g, F.lit(0), lambda n, x: n + x["gap"] + x["n"])))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + x["n"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (acc["at"] + x["gap"] + x["n"]).alias("end"), x["m"].alias("body")))).alias("out"),
    )
    placed = lambda g, k: F.aggregate(g, F.struct(F.aggregate(F.slice("__long", F.lit(1), k), F.lit(0), lambda n, x: n + x).alias("at"), F.array().cast(_SPANS).alias("out")), step, lambda acc: acc["out"])
    # A second mention keeps the lengths a column of their own.
    spans = F.when(F.size("__long") > 0, F.flatten(F.transform("__groups", placed))).otherwise(F.array().cast(_SPANS))
    measured = (lambda s: F.char_length(F.regexp_extract(s["body"], pattern, 2))) if kind == "assign" else (lambda s: F.char_length(s["body"]))
    return made.select(*keep, F.filter(spans, lambda s: measured(s) >= least).alias(kind))


def _windows(body: Column) -> Column:
    """struct(hex, any): the highest Shannon entropy, in bits per character, of the string's windows of WINDOW characters, by the window's class; 0 without one."""
    chars = F.transform(F.split(body, ""), lambda c: F.ascii(c))
    table = F.array(*(F.lit(x) for x in _PLOGP))
    between = lambda c, a, b: (c >= ord(a)) & (c <= ord(b))
    digit = lambda c: F.coalesce(between(c, "0", "9").cast("int"), F.lit(0))
    letter = lambda c: F.coalesce((between(c, "a", "f") | between(c, "A", "F")).cast("int"), F.lit(0))

    def moved(acc: Column, came: Column, went: Column) -> Column:
        count = lambda c: F.coalesce(F.get(F.transform(F.filter(acc["counts"], lambda e: e["c"] == c), lambda e: e["n"]), F.lit(0)), F.lit(0))
        up, down = count(came), count(went)
        change = F.when(went.eqNullSafe(came), F.lit(0.0)).otherwise(F.get(table, up + 1) - F.get(table, up) + F.when(went.isNull(), F.lit(0.0)).otherwise(F.get(table, down - 1) - F.get(table, down)))
        kept = F.filter(F.transform(acc["counts"], lambda e: F.struct(e["c"].alias("c"), (e["n"] + (e["c"] == came).cast("int") - F.coalesce((e["c"] == went).cast("int"), F.lit(0))).alias("n"))), lambda e: e["n"] > 0)
        counts = F.when(up > 0, kept).otherwise(F.concat(kept, F.array(F.struct(came.alias("c"), F.lit(1).alias("n")))))
        return F.struct(counts.alias("counts"), (acc["total"] + change).alias("total"), (acc["digits"] + digit(came) - digit(went)).alias("digits"), (acc["letters"] + letter(came) - letter(went)).alias("letters"), (acc["i"] + 1).alias("i"), acc["hex"].alias("hex"), acc["any"].alias("any"))

    def judged(acc: Column) -> Column:
        bits = F.lit(math.log2(WINDOW)) - acc["total"] / WINDOW
        whole = acc["i"] >= WINDOW
        of_hex = whole & (acc["digits"] + acc["letters"] == WINDOW) & (acc["letters"] > 0)
        of_any = whole & (acc["digits"] + acc["letters"] < WINDOW)
        return F.struct(*(acc[c].alias(c) for c in ("counts", "total", "digits", "letters", "i")), F.when(of_hex, F.greatest(acc["hex"], bits)).otherwise(acc["hex"]).alias("hex"), F.when(of_any, F.greatest(acc["any"], bits)).otherwise(acc["any"]).alias("any"))

    start = F.struct(F.array().cast("array<struct<c:int,n:int>>").alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("digits"), F.lit(0).alias("letters"), F.lit(0).alias("i"), F.lit(0.0).alias("hex"), F.lit(0.0).alias("any"))
    late = F.slice(F.concat(F.array_repeat(F.lit(None).cast("int"), WINDOW), chars), F.lit(1), F.char_length(body))
    steps = F.zip_with(chars, late, lambda c, gone: F.struct(c.alias("came"), gone.alias("went")))
    # Two folds over one step each: the first moves the window, the second is of one element and judges it once.
    one = lambda acc, x: F.element_at(F.transform(F.array(moved(acc, x["came"], x["went"])), judged), 1)
    return F.aggregate(steps, start, one, lambda acc: F.struct(acc["hex"].alias("hex"), acc["any"].alias("any")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found, added): arrays of struct(start, kind, end, body), each ordered by start, then kind.

    ``found`` has the fixed kinds, ``added`` the entropy spans that no fixed span covers.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    text = F.col("text")
    # Searched only where the cheap test finds something.
    fixed = _found(base, "assign", ASSIGN, ASSIGN_LEAST, text.rlike(ASSIGN))
    fixed = _found(fixed, "access", ACCESS, ACCESS_LEAST, F.contains(text, F.lit("AKIA")))
    fixed = _found(fixed, "hex", HEX[:-1] + "{%d,}" % HEX_LEAST, HEX_LEAST, text.rlike(HEX[:-1] + "{%d}" % HEX_LEAST))
    fixed = _found(fixed, "entropy", CANDIDATE, WINDOW, text.rlike(CANDIDATE)).drop("text")
    sought = fixed.withColumn("candidates", F.filter("entropy", lambda s: s["body"].rlike("[0-9]") & s["body"].rlike("[A-Za-z]") & ~F.rlike(s["body"], F.lit("|".join(ALLOWED)))))
    scored = sought.select("doc_id", "assign", "access", "hex", F.transform("candidates", lambda s: F.struct(s.alias("s"), _windows(s["body"]).alias("bits"))).alias("scored"))
    rich = lambda x: (x["bits"]["hex"] >= HEX_BITS) | (x["bits"]["any"] >= ANY_BITS)
    return scored.select(
        "doc_id", "assign", "access", "hex",
        F.array_sort(F.concat("assign", "access", "hex")).alias("found"),
        F.transform(F.filter("scored", rich), lambda x: x["s"]).alias("rich"),
    ).select(
        "doc_id", "assign", "access", "hex", "found",
        F.filter("rich", lambda r: ~F.exists("found", lambda f: (f["start"] <= r["start"]) & (f["end"] >= r["end"]))).alias("added"),
    )


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: counts by fixed kind, the digest of the fixed spans, and all spans."""
    return scan(docs, id_col, text_col).select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(written(F.col("found")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("found", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )
