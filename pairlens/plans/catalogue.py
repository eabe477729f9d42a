"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.functions import ordering, scalars, vectors
from pairlens.operators import audits, corrections, estimators, gates, heads, inventory, matrices, pairs, pools, regression, resample, scoring, validate
from pairlens.sources import items as src
from pairlens.plans.storage import numbered, settled
from pairlens.streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SEED, REPLICATES = 20260829, 1000


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def r6(c: Column | str) -> Column:
    """Rounded to six places, without a negative zero: engines add in different orders."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(frame: DataFrame) -> DataFrame:
    return frame.select(*(r6(c).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in frame.dtypes))


# --- what the SQL shares ---------------------------------------------------------------------------------------

_COS = "least(greatest(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 0.0), 2.0)"
_ITEMS = "WITH items AS (SELECT vec_id AS item, vec_id % 25 AS subject, label::BIGINT AS category, vec_id // 250 AS condition, CASE WHEN vec_id % 25 < 8 THEN 'calibration' ELSE 'evaluation' END AS split, embedding::DOUBLE[] AS v FROM embeddings)"
_PAIRS = _ITEMS + f""", pairs AS (SELECT concat_ws('|', a.split, a.category, a.condition) AS stratum, CASE WHEN a.subject = b.subject THEN 'A' ELSE 'B' END AS arm,
 a.item AS item_l, b.item AS item_r, a.subject AS subject_l, b.subject AS subject_r, a.category, a.condition, {_COS} AS distance
 FROM items a JOIN items b ON a.split = b.split AND a.category = b.category AND a.condition = b.condition AND a.item < b.item WHERE a.split = 'evaluation')"""
_EFFECTS = _PAIRS + """, eff AS (SELECT *, median_b - median_a AS effect, n_a * n_b / (n_a + n_b) AS weight, n_a * n_b / (n_a + n_b) * (median_b - median_a) AS contribution FROM (
 SELECT stratum, count(*) FILTER (arm = 'A') AS n_a, count(*) FILTER (arm = 'B') AS n_b, median(distance) FILTER (arm = 'A') AS median_a, median(distance) FILTER (arm = 'B') AS median_b FROM pairs GROUP BY stratum) WHERE n_a > 0 AND n_b > 0)"""
_SCORED = _ITEMS + f""", mp AS (SELECT a.split, concat_ws('|', a.split, a.condition) AS stratum, a.item AS item_l, b.item AS item_r, a.subject AS subject_l, b.subject AS subject_r,
 a.category AS category_l, b.category AS category_r, {_COS} AS distance, CASE WHEN a.category // 2 = b.category // 2 THEN 0.0 ELSE 1.0 END AS target, abs(a.category - b.category)::DOUBLE AS gap,
 CASE WHEN a.subject = b.subject AND a.category = b.category THEN 'A' WHEN a.category = b.category THEN 'B' WHEN a.subject = b.subject THEN 'C' ELSE 'D' END AS grp
 FROM items a JOIN items b ON a.split = b.split AND a.condition = b.condition AND a.item < b.item),
 fit AS (SELECT regr_slope(target, distance) AS s, avg(target) - regr_slope(target, distance) * avg(distance) AS i, avg(target) AS m FROM mp WHERE split = 'calibration'),
 scored AS (SELECT mp.*, s * distance + i AS predicted, abs(s * distance + i - target) AS error, abs(m - target) AS base_error FROM mp CROSS JOIN fit WHERE split = 'evaluation')"""
_P = 2147483647


def _draw(rep: str, k: str, n: str, seed: int | str = SEED) -> str:
    x = f"(({seed} + {rep} * 1000003 + {k} * 7919) % {_P})"
    return f"((((({x} * {x}) % {_P}) * 48271 + {x}) % {_P}) % {n})"


def _own_seed(*keys: str, seed: int = SEED) -> str:
    """A group's own seed: the seed plus the first 28 bits of the MD5 of its keys."""
    return f"({seed} + ('0x' || md5(concat_ws('|', {', '.join(keys)}))[1:7])::BIGINT)"


def _order(unit: str, seed: int) -> str:
    return _draw(f"({unit} % 1000003)", "1", str(_P), seed)


_ENDS = ", ends AS (SELECT p.*, unnest(CASE WHEN subject_l = subject_r THEN [subject_l] ELSE [subject_l, subject_r] END) AS subject FROM {t} p)"


def evaluation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A and B pairs of the evaluation split inside (category, condition), with cosine distances."""
    return scoring.distances_within(src.vector_items(spark, sf_dir, "evaluation"))


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of all groups inside (split, condition), with distance, target and group."""
    p = scoring.distances_within(src.vector_items(spark, sf_dir), ("split", "condition"))
    same_s, same_c = F.col("subject_l") == F.col("subject_r"), F.col("category_l") == F.col("category_r")
    group = F.when(same_s & same_c, "A").when(same_c, "B").when(same_s, "C").otherwise("D")
    return p.drop("arm").withColumn("target", scoring.binary_reference(F.col("category_l"), F.col("category_r"))).withColumn("gap", scoring.continuous_reference(F.col("category_l"), F.col("category_r"))).withColumn("grp", group)


def scored_pairs(spark: SparkSession, sf_dir: str, target: Column | None = None) -> DataFrame:
    """Evaluation pairs under the affine fit of the calibration pairs; the baseline predicts their mean target."""
    p = all_pairs(spark, sf_dir)
    if target is not None:
        p = p.withColumn("target", target)
    cal = p.where("split = 'calibration'")
    fit = scoring.affine(cal, "distance", "target").crossJoin(F.broadcast(cal.agg(F.avg("target").alias("__m"))))
    return scoring.scored(p.where("split = 'evaluation'"), fit).withColumn("base_error", F.abs(F.col("__m") - F.col("target"))).drop("__m")


# --- validators, capacity, pairs --------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey AS item, o_custkey AS subject, o_orderpriority AS category, o_orderstatus AS condition, CASE WHEN o_custkey % 5 = 0 THEN 'calibration' ELSE 'evaluation' END AS split FROM orders)
SELECT 'blank_field' AS rule, count(*) FILTER (category IS NULL OR trim(category) = '' OR condition IS NULL OR trim(condition) = '' OR subject IS NULL OR item IS NULL) AS n FROM o
UNION ALL SELECT 'unknown_split', count(*) FILTER (split NOT IN ('calibration', 'evaluation', 'train')) FROM o
UNION ALL SELECT 'duplicate_item', count(*) FROM (SELECT item FROM o GROUP BY item HAVING count(*) > 1)
UNION ALL SELECT 'subject_in_two_splits', count(*) FROM (SELECT subject FROM o GROUP BY subject HAVING count(DISTINCT split) > 1)""")
def validate_items_violations(spark, sf_dir):
    return validate.record_violations(src.order_items(spark, sf_dir))


@query(_PAIRS + " SELECT count(*) AS n FROM pairs WHERE distance IS NULL OR isnan(distance) OR distance < 0 OR distance > 2")
def validate_distance_rows(spark, sf_dir):
    return validate.distance_violations(evaluation_pairs(spark, sf_dir)).agg(F.count("*").alias("n"))


_CAP = """SELECT {by} sum(sd)::BIGINT AS a, (sum(d1) - sum(sd))::BIGINT AS b, (sum(s1) - sum(sd))::BIGINT AS c, (sum(al) - sum(d1) - sum(s1) + sum(sd))::BIGINT AS d FROM (
SELECT {by} n * (n - 1) / 2 AS sd, 0 AS d1, 0 AS s1, 0 AS al FROM (SELECT {by} count(*) AS n FROM {t} GROUP BY {by} subject, category)
UNION ALL SELECT {by} 0, n * (n - 1) / 2, 0, 0 FROM (SELECT {by} count(*) AS n FROM {t} GROUP BY {by} category)
UNION ALL SELECT {by} 0, 0, n * (n - 1) / 2, 0 FROM (SELECT {by} count(*) AS n FROM {t} GROUP BY {by} subject)
UNION ALL SELECT {by} 0, 0, 0, n * (n - 1) / 2 FROM (SELECT {by} count(*) AS n FROM {t} {g})) {g}"""


@query(_ITEMS + " " + _CAP.format(by="split,", t="items", g="GROUP BY split"))
def pair_capacity(spark, sf_dir):
    return pairs.capacity(src.vector_items(spark, sf_dir), ["split"])


@query("WITH o AS (SELECT o_custkey AS subject, o_orderpriority AS category FROM orders) " + _CAP.format(by="", t="o", g=""))
def pair_capacity_orders(spark, sf_dir):
    return pairs.capacity(src.order_items(spark, sf_dir))


@query(_ITEMS + " SELECT a.split, CASE WHEN a.subject = b.subject AND a.category = b.category THEN 'A' WHEN a.category = b.category THEN 'B' WHEN a.subject = b.subject THEN 'C' ELSE 'D' END AS \"group\", count(*) AS n FROM items a JOIN items b ON a.split = b.split AND a.item < b.item GROUP BY ALL")
def pair_groups_count(spark, sf_dir):
    return pairs.grouped_counts(src.vector_items(spark, sf_dir))


@query(_PAIRS + " SELECT stratum, arm, item_l, item_r, subject_l, subject_r FROM pairs")
def matched_pairs_ab(spark, sf_dir):
    return pairs.matched_pairs(src.vector_items(spark, sf_dir, "evaluation")).select("stratum", "arm", "item_l", "item_r", "subject_l", "subject_r")


@query(_ITEMS + " SELECT a.split, a.subject, a.item AS item_l, b.item AS item_r, a.category AS category_l, b.category AS category_r FROM items a JOIN items b ON a.split = b.split AND a.subject = b.subject AND a.category < b.category")
def pairs_c(spark, sf_dir):
    return pairs.same_subject_across(src.vector_items(spark, sf_dir)).select("split", "subject", "item_l", "item_r", "category_l", "category_r")


@query(_ITEMS + """, k AS (SELECT *, row_number() OVER (PARTITION BY split, category ORDER BY condition, item) AS rank FROM items)
SELECT a.split, a.rank, a.item AS item_l, b.item AS item_r FROM k a JOIN k b ON a.split = b.split AND a.rank = b.rank WHERE a.rank <= 20 AND a.category < b.category AND a.subject <> b.subject""")
def pairs_d_by_rank(spark, sf_dir):
    return pairs.crossed(src.vector_items(spark, sf_dir), 20).select("split", F.col("rank").cast("long").alias("rank"), "item_l", "item_r")


@query(_PAIRS + f" SELECT arm, item_l, item_r, sha256(concat_ws('|', '{SEED}', arm, item_l, item_r)) AS key FROM pairs")
def pair_order_hash(spark, sf_dir):
    return pairs.matched_pairs(src.vector_items(spark, sf_dir, "evaluation")).select("arm", "item_l", "item_r", pairs.order_key(SEED).alias("key"))


@query(_ITEMS + """, o AS (SELECT *, row_number() OVER w AS n, lead(item) OVER w AS item_r FROM items WINDOW w AS (PARTITION BY split, category, subject ORDER BY condition, item)),
p AS (SELECT split, category, subject, item AS item_l, item_r, row_number() OVER (PARTITION BY split, category ORDER BY subject, condition, item) AS turn FROM o WHERE n % 2 = 1 AND item_r IS NOT NULL)
SELECT *, row_number() OVER (PARTITION BY split ORDER BY turn, category) AS place FROM p""")
def pair_round_robin_a(spark, sf_dir):
    return rounded(pairs.consecutive_pairs(src.vector_items(spark, sf_dir)))


# The sequential rule itself: pair after pair in the order of the hash, with the list of what is used.
_GREEDY = _PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", o AS (SELECT arm, stratum, item_l, item_r, row_number() OVER (PARTITION BY arm ORDER BY sha256(concat_ws('|', '{SEED}', arm, item_l, item_r))) AS n FROM pairs),
g AS (SELECT arm, 0::BIGINT AS n, []::BIGINT[] AS used, false AS kept, 0::BIGINT AS k FROM (SELECT DISTINCT arm FROM o)
 UNION ALL SELECT arm, o.n, CASE WHEN free THEN list_concat(used, [item_l, item_r]) ELSE used END, free, k + free::INT FROM (SELECT g.arm, o.n, used, k, item_l, item_r, NOT list_contains(used, item_l) AND NOT list_contains(used, item_r) AS free FROM g JOIN o ON o.arm = g.arm AND o.n = g.n + 1) o)
SELECT o.arm, stratum, item_l, item_r FROM g JOIN o ON o.arm = g.arm AND o.n = g.n WHERE kept"""


@query(_GREEDY)
def pair_greedy_hash(spark, sf_dir):
    """Greedy matching by hash order."""
    return pairs.greedy_matching(pairs.matched_pairs(src.vector_items(spark, sf_dir, "evaluation"))).select("arm", "stratum", "item_l", "item_r")


@query(_GREEDY + " AND k <= 20")
def pair_greedy_hash_limited(spark, sf_dir):
    """The first 20 kept pairs of each arm, from the pairs under a threshold of the hash that proves them."""
    return pairs.greedy_matching(pairs.matched_pairs(src.vector_items(spark, sf_dir, "evaluation")), limit=20).select("arm", "stratum", "item_l", "item_r")


def _bucket_sql(bucket: str, *within: str) -> str:
    """Buckets taken up one after the other along the line of a stratum's items."""
    w = ", ".join(within)
    return _ITEMS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", ln AS (SELECT {w}, {bucket}, item, row_number() OVER (PARTITION BY {w} ORDER BY {bucket}, condition, item) - 1 AS pos, count(*) OVER (PARTITION BY {w}) AS stop FROM items),
bu AS (SELECT {w}, {bucket}, min(pos) AS b, max(pos) + 1 AS e, max(stop) AS stop FROM ln GROUP BY {w}, {bucket}),
st AS (SELECT {w}, 0::BIGINT AS s FROM (SELECT DISTINCT {w} FROM ln) UNION ALL SELECT {w}, 2 * bu.e - st.s FROM st JOIN bu USING ({w}) WHERE st.s >= bu.b AND st.s < bu.e AND 2 * bu.e - st.s < bu.stop),
tk AS (SELECT {w}, s, e FROM st JOIN bu USING ({w}) WHERE s >= b AND s < e)
SELECT {w}, l.item AS item_l, r.item AS item_r, row_number() OVER (PARTITION BY {w} ORDER BY l.pos) AS turn FROM tk JOIN ln l USING ({w}) JOIN ln r USING ({w}) WHERE l.pos >= s AND l.pos < e AND r.pos = e + l.pos - s"""


@query(_bucket_sql("subject", "split", "category"))
def pair_greedy_b(spark, sf_dir):
    """B pairs without reuse; the line's rule is held against the sequential one in the tests."""
    return pairs.bucket_matching(src.vector_items(spark, sf_dir))


@query(_bucket_sql("category", "split", "subject"))
def pair_greedy_c(spark, sf_dir):
    """C pairs without reuse."""
    return pairs.bucket_matching(src.vector_items(spark, sf_dir), "category", ("split", "subject"))


@query(_bucket_sql("category", "split", "subject").replace("SELECT split, subject, l.item", "SELECT * FROM (SELECT split, subject, item_l, item_r, turn, row_number() OVER (ORDER BY split, turn, subject) AS place FROM (SELECT split, subject, l.item", 1) + ")) WHERE place <= 30")
def pair_round_robin_c(spark, sf_dir):
    """The first 30 C pairs of the round robin over subjects."""
    return pairs.round_robin(pairs.bucket_matching(src.vector_items(spark, sf_dir), "category", ("split", "subject")), "subject", 30)


@query()
def pairs_d_selected(spark, sf_dir):
    """D pairs of the round robin over pairs of categories, at most 1,000; no SQL: turns share what is used (tested against the sequential rule)."""
    return pairs.crossed_selected(src.vector_items(spark, sf_dir), 1000)


@query(_ITEMS + ", p AS (SELECT a.item AS item_l, b.item AS item_r FROM items a JOIN items b ON a.split = b.split AND a.subject = b.subject AND a.category < b.category WHERE a.split = 'calibration') SELECT format('C-{:06d}', row_number() OVER (ORDER BY item_l, item_r)) AS pair_id, item_l, item_r FROM p")
def pair_numbering(spark, sf_dir):
    return pairs.numbered_across(src.vector_items(spark, sf_dir, "calibration"))


@query(_PAIRS + " SELECT item_l, item_r, round(distance, 6) AS distance FROM pairs")
def cosine_pairs(spark, sf_dir):
    return evaluation_pairs(spark, sf_dir).select("item_l", "item_r", r6("distance").alias("distance"))


@query("""SELECT o_orderkey AS item, sha256('{"category":"' || o_orderpriority || '","condition":"' || o_orderstatus || '","item":' || o_orderkey || ',"note":null,"subject":' || o_custkey || '}') AS h FROM orders""")
def record_hashes(spark, sf_dir):
    o = src.order_items(spark, sf_dir).withColumn("note", F.lit(None).cast("string"))
    return o.select("item", src.record_hash(["item", "subject", "category", "condition", "note"]).alias("h"))


_REPORTS = """WITH h AS (SELECT l_orderkey AS k, list({'line': l_linenumber, 'inputs': {'manifest_sha256': CASE WHEN l_linenumber % 2 = 0 THEN sha256('manifest-' || (l_suppkey % 3)) END}} ORDER BY l_linenumber, l_partkey, sha256('manifest-' || (l_suppkey % 3))) AS runs FROM lineitem GROUP BY l_orderkey),
d AS (SELECT o_orderkey AS k, to_json({'bootstrap': {'resampling_unit': CASE WHEN o_custkey % 2 = 0 THEN 'matched_stratum_subject' ELSE 'pair' END}, 'runs': runs}) AS j FROM orders JOIN h ON k = o_orderkey),
t AS (SELECT k, lower(t.atom ->> '$') AS h, '/' || replace(replace(replace(replace(t.fullkey, '$.', ''), '[', '/'), ']', ''), '.', '/') AS path FROM d, json_tree(d.j) t WHERE t.key = 'manifest_sha256' AND t.type = 'VARCHAR'),
f AS (SELECT k, count(*) AS n, bool_or(h = sha256('manifest-0')) AS v, list(path ORDER BY path) FILTER (h = sha256('manifest-0')) AS places FROM t GROUP BY k)
SELECT d.k AS report, CASE WHEN v THEN 'verified' ELSE 'invalidated' END AS status, CASE WHEN v THEN 'expected_hash_recorded' WHEN n > 0 THEN 'hash_mismatch' WHEN (j -> 'bootstrap' ->> 'resampling_unit') LIKE '%matched_stratum%' THEN 'stratum_origin_missing' ELSE 'hash_missing' END AS reason,
coalesce(n, 0) AS n_hashes, places[1] AS first_location FROM d LEFT JOIN f USING (k)"""


@query(_REPORTS)
def report_manifest_status(spark, sf_dir):
    """Reports as JSON, one an order with its lines as nested runs: which record the expected manifest, wherever in them."""
    lines = src.table(spark, sf_dir, "lineitem")
    hashed = F.when(F.col("l_linenumber") % 2 == 0, F.sha2(F.concat(F.lit("manifest-"), (F.col("l_suppkey") % 3).cast("string")), 256))
    run = F.struct(F.col("l_linenumber").alias("at"), F.col("l_partkey").alias("part"), F.struct(F.col("l_linenumber").alias("line"), F.struct(hashed.alias("manifest_sha256")).alias("inputs")).alias("run"))
    runs = lines.groupBy(F.col("l_orderkey").alias("report")).agg(F.transform(F.array_sort(F.collect_list(run)), lambda r: r["run"]).alias("runs"))
    unit = F.struct(F.when(F.col("o_custkey") % 2 == 0, "matched_stratum_subject").otherwise("pair").alias("resampling_unit"))
    reports = src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report"), unit.alias("bootstrap")).join(runs, "report")
    told = reports.select("report", F.to_json(F.struct("bootstrap", "runs")).alias("json"), F.sha2(F.lit("manifest-0"), 256).alias("expected"))
    return validate.manifest_identity(told, ["report"], "json", "expected").select("report", "status", "reason", "n_hashes", F.get("locations", F.lit(0)).alias("first_location"))


@query("""SELECT o_orderkey::VARCHAR AS item, 'files' || CASE WHEN o_orderstatus = 'F' THEN '/phase2/' ELSE '/phase1/' END || o_orderkey AS path, o_custkey::VARCHAR AS subject, o_orderpriority AS category,
CASE WHEN o_orderstatus = 'F' THEN 'month ' || strftime(o_orderdate, '%m') ELSE 'year ' || strftime(o_orderdate, '%Y') END AS condition, CASE WHEN o_custkey % 5 = 0 THEN 'calibration' ELSE 'evaluation' END AS split, CASE WHEN o_custkey % 5 = 0 THEN 'one' ELSE 'two' END AS task FROM orders""")
def corpus_records(spark, sf_dir):
    """The records of two tasks from their key-value tables: files, subjects, categories, and the conditions of either phase."""
    o = src.table(spark, sf_dir, "orders")
    tasks = {}
    for name, split, rows in (("one", "calibration", o.where("o_custkey % 5 = 0")), ("two", "evaluation", o.where("o_custkey % 5 <> 0"))):
        of = lambda value, rows=rows: rows.select(F.col("o_orderkey").cast("string").alias("key"), value.cast("string").alias("value"))
        path = F.concat(F.lit("files"), F.when(F.col("o_orderstatus") == "F", "/phase2/").otherwise("/phase1/"), F.col("o_orderkey").cast("string"))
        early, late = (of(F.concat(F.lit(t), F.date_format("o_orderdate", f))) for t, f in (("year ", "yyyy"), ("month ", "MM")))
        tasks[name] = (src.task_records(of(path), of(F.col("o_custkey")), of(F.col("o_orderpriority")), early, late), split)
    return src.corpus(tasks).select("item", "path", "subject", "category", "condition", "split", "task")


@query(_PAIRS + " SELECT stratum, arm, item_l, item_r FROM pairs WHERE item_l IN (SELECT l_orderkey FROM lineitem) AND item_r IN (SELECT l_orderkey FROM lineitem)")
def available_pairs(spark, sf_dir):
    """Evaluation pairs both of whose items have lines in the second view's table."""
    known = src.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"))
    return scoring.available(pairs.matched_pairs(src.vector_items(spark, sf_dir, "evaluation")), known).select("stratum", "arm", "item_l", "item_r")


@query(_SCORED + """, a AS (SELECT item_l || '-' || item_r AS pair_id, stratum, error, abs(0.5 * distance + 0.25 - target) AS other FROM scored)
SELECT stratum, count(*) AS n, round(avg(error), 6) AS mae, round(avg(other), 6) AS other_mae, round(avg(other - error), 6) AS delta FROM a GROUP BY stratum""")
def paired_errors(spark, sf_dir):
    """Two scores of the same pairs by id, with the strata of the pair manifest attached; ids and ends must agree on all sides."""
    s = settled(scored_pairs(spark, sf_dir).withColumn("pair_id", F.concat_ws("-", "item_l", "item_r")))
    manifest = s.select("pair_id", "item_l", "item_r", "stratum")
    fixed = s.withColumn("error", F.abs(0.5 * F.col("distance") + 0.25 - F.col("target")))
    both = scoring.paired(fixed, s).join(s.select("pair_id", "item_l", "item_r"), "pair_id")
    named = scoring.with_identity(both, manifest)
    return rounded(named.groupBy("stratum").agg(F.count("*").alias("n"), F.avg("second").alias("mae"), F.avg("first").alias("other_mae"), F.avg("delta").alias("delta")))


# --- stratified estimates ----------------------------------------------------------------------------------------


@query(_EFFECTS + " SELECT stratum, n_a, n_b, round(median_a, 6) AS median_a, round(median_b, 6) AS median_b, round(effect, 6) AS effect, round(weight, 6) AS weight, round(contribution, 6) AS contribution FROM eff")
def stratum_effects(spark, sf_dir):
    return rounded(estimators.stratum_effects(evaluation_pairs(spark, sf_dir)))


@query(_EFFECTS + " SELECT round(sum(contribution) / sum(weight), 6) AS estimate, count(*) AS strata FROM eff")
def overlap_effect(spark, sf_dir):
    return rounded(estimators.overlap_effect(estimators.stratum_effects(evaluation_pairs(spark, sf_dir))))


@query(_EFFECTS + " SELECT round(median(effect), 6) AS estimate, count(*) AS strata FROM eff")
def median_of_medians(spark, sf_dir):
    return rounded(estimators.median_of_medians(estimators.stratum_effects(evaluation_pairs(spark, sf_dir))))


@query(_EFFECTS + " SELECT stratum, round((sum(contribution) OVER () - contribution) / (sum(weight) OVER () - weight), 6) AS estimate FROM eff")
def leave_one_stratum_out(spark, sf_dir):
    return rounded(estimators.leave_one_out(estimators.stratum_effects(evaluation_pairs(spark, sf_dir))))


_SUPPORT = _EFFECTS + _ENDS.format(t="pairs") + """, k AS (SELECT stratum, arm, subject, count(*) AS k FROM ends GROUP BY ALL),
 sup AS (SELECT stratum, arm, count(*) AS subjects, sum(k) * sum(k) / sum(k * k) AS ess FROM k GROUP BY ALL), np AS (SELECT stratum, arm, count(*) AS pairs FROM pairs GROUP BY ALL),
 su AS (SELECT * FROM sup JOIN np USING (stratum, arm))"""


@query(_SUPPORT + " SELECT stratum, arm, pairs, subjects, round(ess, 6) AS ess FROM su")
def subject_support_ess(spark, sf_dir):
    return rounded(estimators.subject_support(evaluation_pairs(spark, sf_dir)))


@query(_SUPPORT + """, w AS (SELECT a.stratum, a.pairs * b.pairs / (a.pairs + b.pairs) AS p, a.subjects * b.subjects / (a.subjects + b.subjects) AS s, a.ess * b.ess / (a.ess + b.ess) AS e FROM su a JOIN su b ON a.stratum = b.stratum AND a.arm = 'A' AND b.arm = 'B')
 SELECT round(sum(p * effect) / sum(p), 6) AS by_pairs, round(sum(s * effect) / sum(s), 6) AS by_subjects, round(sum(e * effect) / sum(e), 6) AS by_ess FROM w JOIN eff USING (stratum)""")
def support_estimates(spark, sf_dir):
    return rounded(estimators.support_estimates(estimators.support_weights(evaluation_pairs(spark, sf_dir))))


@query(_SUPPORT + " SELECT stratum, round(effect, 6) AS effect FROM eff WHERE stratum IN (SELECT stratum FROM su GROUP BY stratum HAVING min(subjects) >= 5 AND count(*) = 2)")
def support_qualified(spark, sf_dir):
    return rounded(estimators.qualified(evaluation_pairs(spark, sf_dir), 5).select("stratum", "effect"))


@query(_PAIRS + " SELECT round(median(distance) FILTER (arm = 'A'), 6) AS median_a, round(median(distance) FILTER (arm = 'B'), 6) AS median_b, round(median(distance) FILTER (arm = 'B') - median(distance) FILTER (arm = 'A'), 6) AS estimate FROM pairs")
def pooled_ab(spark, sf_dir):
    return rounded(estimators.pooled(evaluation_pairs(spark, sf_dir)))


@query("""WITH o AS (SELECT o_custkey AS subject, concat_ws('|', CASE WHEN o_custkey % 5 = 0 THEN 'calibration' ELSE 'evaluation' END, o_orderpriority, o_orderstatus, strftime(o_orderdate, '%Y-%m')) AS stratum FROM orders),
k AS (SELECT stratum, subject, count(*) AS n FROM o GROUP BY stratum, subject), p AS (SELECT stratum, (sum(n * (n - 1)) / 2)::BIGINT AS n_a, (sum(n) * (sum(n) - 1) / 2 - sum(n * (n - 1)) / 2)::BIGINT AS n_b FROM k GROUP BY stratum)
SELECT stratum, n_a, n_b FROM p WHERE n_a + n_b > 0 AND (n_a = 0 OR n_b = 0)""")
def one_armed_strata(spark, sf_dir):
    """Strata that lack an arm, over all orders by split, category, condition and month; counted, no pair is made."""
    o = src.order_items(spark, sf_dir).join(src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.date_format("o_orderdate", "yyyy-MM").alias("month")), "item")
    counts = pairs.arm_counts(o, ["split", "category", "condition", "month"]).where("n_a = 0 OR n_b = 0")
    return counts.select(F.concat_ws("|", "split", "category", "condition", "month").alias("stratum"), "n_a", "n_b")


# --- errors ------------------------------------------------------------------------------------------------------


@query(_SCORED + _ENDS.format(t="scored") + """ SELECT 'pair' AS weighting, round(avg(error), 6) AS value FROM scored
UNION ALL SELECT 'endpoint_subject', round(avg(m), 6) FROM (SELECT avg(error) AS m FROM ends GROUP BY subject)
UNION ALL SELECT 'category_relation', round(avg(m), 6) FROM (SELECT avg(error) AS m FROM scored GROUP BY least(category_l, category_r), greatest(category_l, category_r))
UNION ALL SELECT 'stratum', round(avg(m), 6) FROM (SELECT avg(error) AS m FROM scored GROUP BY stratum)""")
def weighted_mae(spark, sf_dir):
    return rounded(estimators.weighted_mae(scored_pairs(spark, sf_dir)))


@query(_SCORED + " SELECT least(category_l, category_r) AS rel_l, greatest(category_l, category_r) AS rel_r, round(avg(predicted), 6) AS mean, count(*) AS n FROM scored WHERE category_l <> category_r GROUP BY ALL")
def relation_means(spark, sf_dir):
    return rounded(estimators.relation_means(scored_pairs(spark, sf_dir)))


@query(_SCORED + " SELECT grp, count(*) AS n, round(avg(base_error), 6) AS base_mae, round(avg(error), 6) AS mae, round(CASE WHEN avg(base_error) <= 0 THEN 0 ELSE (avg(base_error) - avg(error)) / avg(base_error) END, 6) AS gain FROM scored GROUP BY grp")
def group_report(spark, sf_dir):
    return rounded(estimators.group_report(scored_pairs(spark, sf_dir), "grp"))


@query(_SCORED + " SELECT grp, count(*) AS n, round(avg(error), 6) AS mean, round(median(error), 6) AS median, round(quantile_cont(error, 0.75) - quantile_cont(error, 0.25), 6) AS iqr, round(min(error), 6) AS least, round(max(error), 6) AS most FROM scored GROUP BY grp")
def distribution_summary(spark, sf_dir):
    return rounded(estimators.distribution(scored_pairs(spark, sf_dir), ["grp"], "error"))


@query(_SCORED + " SELECT round(s, 6) AS slope, round(i, 6) AS intercept FROM fit")
def affine_ols(spark, sf_dir):
    return rounded(scoring.affine(all_pairs(spark, sf_dir).where("split = 'calibration'"), "distance", "target"))


@query(_SCORED + " SELECT grp, round(CASE WHEN regr_sxx(gap, distance) <= 1e-30 OR regr_slope(gap, distance) IS NULL THEN 0 ELSE greatest(0, regr_slope(gap, distance)) END, 6) AS slope, round(avg(gap) - CASE WHEN regr_sxx(gap, distance) <= 1e-30 OR regr_slope(gap, distance) IS NULL THEN 0 ELSE greatest(0, regr_slope(gap, distance)) END * avg(distance), 6) AS intercept FROM mp GROUP BY grp")
def affine_clamped(spark, sf_dir):
    return rounded(scoring.affine(all_pairs(spark, sf_dir), "distance", "gap", ["grp"], clamped=True))


@query(_SCORED + ", r AS (SELECT least(category_l, category_r) AS a, greatest(category_l, category_r) AS b, round(avg(abs(category_l - category_r)), 6) AS x, round(avg(distance), 9) AS y FROM scored WHERE category_l <> category_r GROUP BY ALL), k AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM r), p AS (SELECT sign(i.x - j.x) AS sx, sign(i.y - j.y) AS sy FROM r i JOIN r j ON (i.a, i.b) < (j.a, j.b)), s AS (SELECT count(*) FILTER (sx * sy > 0) AS p, count(*) FILTER (sx * sy < 0) AS q, count(*) FILTER (sx = 0 AND sy <> 0) AS tx, count(*) FILTER (sx <> 0 AND sy = 0) AS ty, count(*) FILTER (sx = 0) AS tr, count(*) FILTER (sy = 0) AS tp FROM p) SELECT (SELECT count(*) FROM k) AS n, round((SELECT corr(rx, ry) FROM k), 6) AS spearman, round((p - q) / sqrt((p + q + tx)::DOUBLE * (p + q + ty)), 6) AS kendall, round((p + ty / 2) / (p + q + ty), 6) AS order_accuracy, q AS reversals, tr AS tied_reference, tp AS tied_predicted FROM s")
def ranking_metrics(spark, sf_dir):
    means = estimators.relation_means(scored_pairs(spark, sf_dir), "distance")
    rel = means.select((F.col("rel_l") * 1000 + F.col("rel_r")).alias("relation"), F.abs(F.col("rel_l") - F.col("rel_r")).cast("double").alias("reference"), F.round("mean", 9).alias("predicted"))
    return rounded(estimators.ranking_metrics(rel))


@query(_SCORED + ", r AS (SELECT least(category_l, category_r) * 1000 + greatest(category_l, category_r) AS rel, round(avg(distance), 9) AS x, round(avg(error), 9) AS y FROM scored WHERE category_l <> category_r GROUP BY ALL) SELECT count(*) FILTER ((i.x - j.x) * (i.y - j.y) < 0) AS reversals, count(*) FILTER ((i.x - j.x) * (i.y - j.y) <> 0) AS compared FROM r i JOIN r j ON i.rel < j.rel")
def order_reversals(spark, sf_dir):
    off = scored_pairs(spark, sf_dir).where("category_l <> category_r")
    both = off.groupBy(F.least("category_l", "category_r").alias("rel_l"), F.greatest("category_l", "category_r").alias("rel_r")).agg(F.avg("distance").alias("b"), F.avg("error").alias("p"))
    return rounded(estimators.order_reversals(both.select((F.col("rel_l") * 1000 + F.col("rel_r")).alias("relation"), F.round("b", 9).alias("baseline"), F.round("p", 9).alias("predicted"))))


@query(_SCORED + """, c AS (SELECT item_l || '-' || item_r AS pair_id, abs(0.4 * distance - target) AS l0, abs(0.5 * distance - target) AS l1, abs(0.6 * distance - target) AS m0, abs(0.9 * distance - target) AS m1, grp FROM scored)
SELECT grp, count(*) AS n, round(avg((m1 - m0) - (l1 - l0)), 6) AS interaction FROM c GROUP BY grp""")
def did_interaction(spark, sf_dir):
    s = scored_pairs(spark, sf_dir).withColumn("pair_id", F.concat_ws("-", "item_l", "item_r"))
    arm = lambda h, t, f: F.struct(F.lit(h).alias("head"), F.lit(t).alias("strength"), F.abs(f * F.col("distance") - F.col("target")).alias("error"))
    cells = s.select("pair_id", F.explode(F.array(arm("linear", "off", 0.4), arm("linear", "on", 0.5), arm("mlp", "off", 0.6), arm("mlp", "on", 0.9))).alias("c")).select("pair_id", "c.*")
    return rounded(estimators.did(cells).join(s.select("pair_id", "grp"), "pair_id").groupBy("grp").agg(F.count("*").alias("n"), F.avg("interaction").alias("interaction")))


@query(_SCORED + " SELECT grp, round(avg(CASE WHEN abs(distance - target) < 1 THEN 0.5 * (distance - target) ** 2 ELSE abs(distance - target) - 0.5 END), 6) AS ordinary, round((coalesce(avg(l) FILTER (target = 0), avg(l) FILTER (target <> 0)) + coalesce(avg(l) FILTER (target <> 0), avg(l) FILTER (target = 0))) / 2, 6) AS balanced FROM (SELECT *, CASE WHEN abs(distance - target) < 1 THEN 0.5 * (distance - target) ** 2 ELSE abs(distance - target) - 0.5 END AS l FROM scored) GROUP BY grp")
def losses(spark, sf_dir):
    return rounded(heads.losses(scored_pairs(spark, sf_dir), ["grp"]))


# --- vectors -----------------------------------------------------------------------------------------------------


@query(_ITEMS + " SELECT subject, pos - 1 AS pos, round(avg(x), 6) AS mean FROM (SELECT subject, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM items) GROUP BY ALL")
def vector_means_by_subject(spark, sf_dir):
    m = vectors.mean_vectors(src.vector_items(spark, sf_dir), ["subject"])
    return rounded(m.select("subject", F.posexplode("mean").alias("pos", "mean")))


@query(_ITEMS + " SELECT split, count(*) AS n, round(min(q), 6) AS least, round(median(q), 6) AS median, round(max(q), 6) AS most FROM (SELECT split, sqrt(list_dot_product(v, v)) AS q FROM items) GROUP BY split")
def embedding_norms(spark, sf_dir):
    return rounded(src.vector_items(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.min("norm").alias("least"), F.median("norm").alias("median"), F.max("norm").alias("most")))


@query(_ITEMS + " SELECT round(min(s), 6) AS least, round(median(s), 6) AS median, round(max(s), 6) AS most, round(avg(s), 6) AS mean FROM (SELECT var_pop(x) AS s FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM items) GROUP BY pos)")
def embedding_dim_variance(spark, sf_dir):
    v = src.vector_items(spark, sf_dir).select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.var_pop("x").alias("s"))
    return rounded(v.agg(F.min("s").alias("least"), F.median("s").alias("median"), F.max("s").alias("most"), F.avg("s").alias("mean")))


@query("SELECT count(*) AS items, 0::BIGINT AS unmatched, round(max(abs(x - round(x, 3))), 6) AS largest FROM (SELECT unnest(embedding::DOUBLE[]) AS x, vec_id FROM embeddings) HAVING true".replace("count(*) AS items", "count(DISTINCT vec_id) AS items").replace(" HAVING true", ""))
def vector_equality(spark, sf_dir):
    a = src.vector_items(spark, sf_dir)
    return rounded(audits.largest_gap(a, a.select("item", F.transform("vec", lambda x: F.round(x, 3)).alias("vec"))))


@query(_ITEMS + """, m AS (SELECT subject, pos, avg(x) AS s FROM (SELECT subject, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM items) GROUP BY ALL),
g AS (SELECT pos, avg(x) AS g FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM items) GROUP BY pos)
SELECT item, round(sqrt(sum((x - s + g) ** 2)), 6) AS norm FROM (SELECT item, subject, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM items) JOIN m USING (subject, pos) JOIN g USING (pos) GROUP BY item""")
def subject_mean_normalised(spark, sf_dir):
    return rounded(corrections.subject_normalised(src.vector_items(spark, sf_dir)).select("item", "norm"))


_RESID = _ITEMS + """, u AS (SELECT item, subject, category, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM items), s AS (SELECT subject, pos, sum(x) AS s, count(*) AS n FROM u GROUP BY ALL),
"""


@query(_RESID + """p AS (SELECT a.item AS item_l, b.item AS item_r, a.subject AS sl, b.subject AS sr FROM items a JOIN items b ON a.split = b.split AND a.category = b.category AND a.condition = b.condition AND a.item < b.item WHERE a.split = 'evaluation'),
r AS (SELECT item_l, item_r, sl = sr AS same, a.x AS xl, b.x AS xr, ta.s AS tl, tb.s AS tr, ta.n AS nl, tb.n AS nr FROM p JOIN u a ON a.item = item_l JOIN u b ON b.item = item_r AND a.pos = b.pos JOIN s ta ON ta.subject = sl AND ta.pos = a.pos JOIN s tb ON tb.subject = sr AND tb.pos = a.pos),
q AS (SELECT item_l, item_r, nl - CASE WHEN same THEN 2 ELSE 1 END AS kl, nr - CASE WHEN same THEN 2 ELSE 1 END AS kr,
 xl - CASE WHEN kl > 0 THEN (tl - xl - CASE WHEN same THEN xr ELSE 0 END) / kl ELSE tl / nl END AS dl, xr - CASE WHEN kr > 0 THEN (tr - xr - CASE WHEN same THEN xl ELSE 0 END) / kr ELSE tr / nr END AS dr FROM r)
SELECT item_l, item_r, round(least(greatest(1 - sum(dl * dr) / (sqrt(sum(dl * dl)) * sqrt(sum(dr * dr))), 0.0), 2.0), 6) AS distance, any_value((kl <= 0)::INT + (kr <= 0)::INT)::BIGINT AS fallbacks FROM q GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY item_l, item_r"))
def leave_pair_out_distance(spark, sf_dir):
    items = src.vector_items(spark, sf_dir)
    p = pairs.matched_pairs(items.where("split = 'evaluation'")).select("item_l", "item_r")
    return rounded(corrections.leave_pair_out(p, items))


@query(_RESID + """c AS (SELECT subject, category, pos, avg(x) AS m, count(*) AS n FROM u GROUP BY ALL), k AS (SELECT subject FROM items GROUP BY subject HAVING count(DISTINCT category) >= 2)
SELECT subject, category, any_value(c.n) AS n, round(sqrt(sum((m - s.s / s.n) ** 2)) / sqrt(sum(m * m)), 6) AS ratio FROM c JOIN s USING (subject, pos) WHERE subject IN (SELECT subject FROM k) GROUP BY subject, category""")
def category_residuals(spark, sf_dir):
    return rounded(corrections.category_residuals(src.vector_items(spark, sf_dir)))


@query(_RESID + """c AS (SELECT subject, category, pos, avg(x) AS m FROM u GROUP BY ALL), d AS (SELECT subject, category, pos, m - s.s / s.n AS d FROM c JOIN s USING (subject, pos)),
p AS (SELECT a.subject, a.category AS category_l, b.category AS category_r, sum(a.d * b.d) / (sqrt(sum(a.d * a.d)) * sqrt(sum(b.d * b.d))) AS c FROM d a JOIN d b ON a.subject = b.subject AND a.pos = b.pos AND a.category < b.category GROUP BY ALL)
SELECT category_l, category_r, count(*) AS n, round(avg(c), 6) AS mean FROM p GROUP BY ALL""".replace("AS c FROM d a JOIN d b ON a.subject = b.subject AND a.pos = b.pos AND a.category < b.category GROUP BY ALL", "AS c FROM d a JOIN d b ON a.subject = b.subject AND a.pos = b.pos AND a.category < b.category GROUP BY a.subject, a.category, b.category"))
def residual_cosines(spark, sf_dir):
    return rounded(corrections.residual_cosines(src.vector_items(spark, sf_dir)))


_SWEEP = _ITEMS + """, u AS (SELECT item, subject, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM items WHERE split = 'evaluation'),
o AS (SELECT subject, pos, avg(x) AS s FROM u GROUP BY ALL), g AS (SELECT pos, avg(x) AS g FROM u GROUP BY pos), al AS (SELECT unnest([0.0, 0.25, 0.5, 1.0]::DOUBLE[]) AS alpha),
w AS (SELECT alpha, item, list(x - alpha * (s - g) ORDER BY pos) AS v FROM u JOIN o USING (subject, pos) JOIN g USING (pos) CROSS JOIN al GROUP BY ALL),
p AS (SELECT a.item AS l, b.item AS r, CASE WHEN a.subject = b.subject AND a.category = b.category THEN 'A' WHEN a.subject = b.subject THEN 'C' END AS grp FROM items a JOIN items b ON a.split = b.split AND a.subject = b.subject AND a.condition = b.condition AND a.item < b.item WHERE a.split = 'evaluation'),
sw AS (SELECT alpha, grp AS "group", count(*) AS n, avg(least(greatest(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 0), 2)) AS mean FROM p JOIN w a ON a.item = l JOIN w b ON b.item = r AND a.alpha = b.alpha GROUP BY ALL)"""
_SWEEP = _SWEEP.replace("list(x - alpha * (s - g) ORDER BY pos) AS v FROM u JOIN o USING (subject, pos) JOIN g USING (pos) CROSS JOIN al GROUP BY ALL", "list(x - alpha * (s - g) ORDER BY pos) AS v FROM u JOIN o USING (subject, pos) JOIN g USING (pos) CROSS JOIN al GROUP BY alpha, item").replace("a.alpha = b.alpha GROUP BY ALL", "a.alpha = b.alpha GROUP BY alpha, grp").replace("SELECT alpha, grp AS", "SELECT a.alpha AS alpha, grp AS").replace("GROUP BY alpha, grp", "GROUP BY a.alpha, grp")


def _sweep(spark, sf_dir):
    items = src.vector_items(spark, sf_dir, "evaluation")
    left = items.select("subject", "condition", F.col("item").alias("item_l"), F.col("category").alias("cl"))
    right = items.select("subject", "condition", F.col("item").alias("item_r"), F.col("category").alias("cr"))
    p = left.join(right, ["subject", "condition"]).where("item_l < item_r").select("item_l", "item_r", F.when(F.col("cl") == F.col("cr"), "A").otherwise("C").alias("group"))
    return corrections.alpha_sweep(p, items, (0.0, 0.25, 0.5, 1.0))


@query(_SWEEP + ' SELECT alpha, "group", n, round(mean, 6) AS mean FROM sw')
def alpha_sweep(spark, sf_dir):
    return rounded(_sweep(spark, sf_dir))


@query(_SWEEP + """, t AS (SELECT alpha, max(mean) FILTER ("group" = 'A') AS a, max(mean) FILTER ("group" = 'C') AS c FROM sw GROUP BY alpha), z AS (SELECT a AS a0, c AS c0 FROM t WHERE alpha = 0),
y AS (SELECT alpha, round(abs((a - a0) / a0), 9) AS harm, round((c0 - c) / c0, 9) AS gain FROM t CROSS JOIN z)
SELECT alpha, round(harm, 6) AS harm, round(gain, 6) AS gain, NOT EXISTS (SELECT 1 FROM y b WHERE b.harm <= y.harm AND b.gain >= y.gain AND (b.harm < y.harm OR b.gain > y.gain)) AS efficient FROM y""")
def alpha_tradeoff_pareto(spark, sf_dir):
    return rounded(corrections.alpha_tradeoff(_sweep(spark, sf_dir)))


# --- corrections and selection -----------------------------------------------------------------------------------

_VIEW = """, px AS (SELECT o_orderkey AS item, [o_totalprice / 5e5, coalesce(avg(l_quantity) / 50, 0), coalesce(avg(l_extendedprice) / 1e5, 0), coalesce(avg(l_discount) / 0.1, 0), coalesce(avg(l_tax) / 0.1, 0), coalesce(avg(l_linenumber) / 7, 0), count(l_orderkey) / 7]::DOUBLE[] AS v
 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey IN (SELECT item FROM items) GROUP BY o_orderkey, o_totalprice)"""
_LAM = _SCORED + _VIEW + """, st AS (SELECT unnest([0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9, 1.0]::DOUBLE[]) AS strength),
pp AS (SELECT split, gap AS target, distance, """ + _COS + """ AS other FROM mp JOIN px a ON a.item = item_l JOIN px b ON b.item = item_r), x AS (SELECT strength, target, greatest(0, distance - strength * other) AS x FROM pp CROSS JOIN st WHERE split = 'calibration'),
f AS (SELECT strength, greatest(0, coalesce(regr_slope(target, x), 0)) AS slope, avg(target) - greatest(0, coalesce(regr_slope(target, x), 0)) * avg(x) AS intercept FROM x GROUP BY strength),
er AS (SELECT strength, slope, intercept, avg(abs(slope * x + intercept - target)) AS mae FROM x JOIN f USING (strength) GROUP BY ALL)"""
_LAM = _LAM.replace("USING (strength) GROUP BY ALL", "USING (strength) GROUP BY strength, slope, intercept")


def _other(spark, sf_dir):
    """All pairs with the gap as target and ``other``, their distance in the second view; written once."""
    p = settled(all_pairs(spark, sf_dir).drop("target").withColumnRenamed("gap", "target"))
    views = src.proxy_items(spark, sf_dir).withColumn("vec", F.col("proxy")).withColumn("norm", vectors.norm("proxy", 7))
    other = scoring.distances(p.select("item_l", "item_r"), views, dim=7).select("item_l", "item_r", F.col("distance").alias("other"))
    return settled(p.join(other, ["item_l", "item_r"]))


@query(_LAM + " SELECT strength, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(mae, 6) AS mae FROM er")
def strength_errors(spark, sf_dir):
    return rounded(corrections.strength_errors(_other(spark, sf_dir).where("split = 'calibration'")))


@query(_LAM + " SELECT strength, round(mae, 6) AS mae FROM er ORDER BY round(er.mae, 12), strength LIMIT 1")
def lambda_selection(spark, sf_dir):
    return rounded(corrections.chosen(corrections.strength_errors(_other(spark, sf_dir).where("split = 'calibration'"))).select("strength", "mae"))


@query(_LAM + """, b AS (SELECT * FROM er ORDER BY round(mae, 12), strength LIMIT 1), z AS (SELECT slope AS s0, intercept AS i0 FROM er WHERE strength = 0),
e AS (SELECT count(*) AS n, avg(abs(s0 * distance + i0 - target)) AS base_mae, avg(abs(slope * greatest(0, distance - strength * other) + intercept - target)) AS mae FROM pp CROSS JOIN b CROSS JOIN z WHERE split = 'evaluation')
SELECT n, round(base_mae, 6) AS base_mae, round(e.mae, 6) AS mae, round(CASE WHEN base_mae <= 0 THEN 0 ELSE (base_mae - e.mae) / base_mae END, 6) AS gain FROM e""")
def scalar_subtraction_report(spark, sf_dir):
    p = _other(spark, sf_dir)
    errors = corrections.strength_errors(p.where("split = 'calibration'"))
    base = errors.where("strength = 0").select(F.col("slope").alias("base_slope"), F.col("intercept").alias("base_intercept"))
    return rounded(corrections.frozen_report(p.where("split = 'evaluation'"), corrections.chosen(errors).crossJoin(base)))


CONTROL_SEEDS = (SEED, SEED + 1, SEED + 2, SEED + 3, SEED + 4)
_CONTROL = _LAM[: _LAM.index("pp AS (")].replace(", st AS (", ", st AS (", 1) + """sd AS (SELECT unnest([""" + ", ".join(map(str, CONTROL_SEEDS)) + """]) AS seed),
p0 AS (SELECT split, item_l * 100000 + item_r AS id, gap AS target, distance, """ + _COS + """ AS other FROM mp JOIN px a ON a.item = item_l JOIN px b ON b.item = item_r),
od AS (SELECT seed, p0.*, row_number() OVER (PARTITION BY seed, split ORDER BY """ + _draw("(id % 1000003)", "1", str(_P), "seed") + """, id) AS i, count(*) OVER (PARTITION BY seed, split) AS n FROM p0 CROSS JOIN sd),
pp AS (SELECT x.seed, x.split, x.target, x.distance, y.other FROM od x JOIN od y ON y.seed = x.seed AND y.split = x.split AND y.i = CASE WHEN x.i = x.n THEN 1 ELSE x.i + 1 END),
x AS (SELECT seed, strength, target, greatest(0, distance - strength * other) AS x FROM pp CROSS JOIN st WHERE split = 'calibration'),
f AS (SELECT seed, strength, greatest(0, coalesce(regr_slope(target, x), 0)) AS slope, avg(target) - greatest(0, coalesce(regr_slope(target, x), 0)) * avg(x) AS intercept FROM x GROUP BY seed, strength),
er AS (SELECT seed, strength, slope, intercept, avg(abs(slope * x + intercept - target)) AS mae FROM x JOIN f USING (seed, strength) GROUP BY seed, strength, slope, intercept),
b AS (SELECT * FROM er QUALIFY row_number() OVER (PARTITION BY seed ORDER BY round(mae, 12), strength) = 1), z AS (SELECT seed, slope AS s0, intercept AS i0 FROM er WHERE strength = 0)
SELECT seed, round(any_value(strength), 6) AS strength, round((avg(abs(s0 * distance + i0 - target)) - avg(abs(slope * greatest(0, distance - strength * other) + intercept - target))) / avg(abs(s0 * distance + i0 - target)), 6) AS gain
FROM pp JOIN b USING (seed) JOIN z USING (seed) WHERE split = 'evaluation' GROUP BY seed"""


@query(_CONTROL)
def scalar_subtraction_controls(spark, sf_dir):
    """The five controls: the second distances dealt to other pairs of the split, the strength chosen anew, the gain on evaluation pairs."""
    p = settled(_other(spark, sf_dir).withColumn("id", F.col("item_l") * 100000 + F.col("item_r")))
    out = None
    for seed in CONTROL_SEEDS:
        parts = {s: settled(corrections.shuffled_other(p.where(F.col("split") == s), "id", seed)) for s in ("calibration", "evaluation")}
        errors = settled(corrections.strength_errors(parts["calibration"]))
        best = corrections.chosen(errors).crossJoin(errors.where("strength = 0").select(F.col("slope").alias("base_slope"), F.col("intercept").alias("base_intercept")))
        one = corrections.frozen_report(parts["evaluation"], best).crossJoin(best.select("strength")).select(F.lit(seed).cast("long").alias("seed"), "strength", "gain")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


_BUDGET = _SCORED + """, n AS (SELECT count(*) FILTER (category_l = category_r) AS np, count(*) FILTER (category_l <> category_r) AS nc FROM mp WHERE split = 'calibration'), g AS (SELECT unnest([0.25, 0.5, 1.0, 2.0]::DOUBLE[]) AS ratio), l AS (SELECT unnest([0.0, 0.25, 0.5, 1.0, 2.0]::DOUBLE[]) AS strength),
k AS (SELECT ratio, strength, np, least(nc, round_even(np * ratio, 0))::BIGINT AS drawn FROM n CROSS JOIN g CROSS JOIN l) SELECT ratio, strength, np AS pair, drawn AS cross_drawn, round(strength / (1 + strength), 6) AS eta_separate, round(strength * drawn / (np + strength * drawn), 6) AS eta_mixed FROM k"""


@query(_BUDGET)
def gradient_budget(spark, sf_dir):
    """The cross loss's share of the gradient by exposure ratio and strength, losses apart and mixed, of the calibration pairs; counted from group sizes."""
    g = pairs.capacity(src.vector_items(spark, sf_dir, "calibration"), ["condition"]).agg((F.sum("a") + F.sum("b")).alias("pair"), (F.sum("c") + F.sum("d")).alias("cross"))
    return rounded(pools.budget(g, (0.25, 0.5, 1.0, 2.0), (0.0, 0.25, 0.5, 1.0, 2.0)))


@query(_SCORED + _ENDS.format(t="scored") + f""", g AS (SELECT grp, CASE WHEN avg(base_error) <= 0 THEN 0 ELSE (avg(base_error) - avg(error)) / avg(base_error) END AS gain FROM scored GROUP BY grp),
sg AS (SELECT grp, subject, avg(base_error - error) AS d FROM ends GROUP BY grp, subject), un AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY subject) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM sg),
dr AS (SELECT rep, grp, {_draw('rep', 'k', 'n', _own_seed('grp'))} AS idx FROM (SELECT DISTINCT grp, n FROM un) CROSS JOIN range({REPLICATES}) r(rep) CROSS JOIN LATERAL (SELECT unnest(range(n)) AS k)),
lo AS (SELECT grp, quantile_cont(x, 0.025) AS lower FROM (SELECT rep, grp, avg(d) AS x FROM dr JOIN un USING (grp, idx) GROUP BY rep, grp) GROUP BY grp)
SELECT grp, threshold, gain >= threshold AND lower > 0 AS passed FROM g JOIN lo USING (grp) CROSS JOIN (SELECT unnest([0.03, 0.05, 0.1]::DOUBLE[]) AS threshold)""")
def threshold_sensitivity(spark, sf_dir):
    """Gains by group at each threshold, with the lower bound of the subjects' mean gain when the group's subjects are drawn."""
    s = settled(scored_pairs(spark, sf_dir).select("grp", "subject_l", "subject_r", "error", "base_error"))
    lower = resample.interval(resample.grouped_mean(resample.subject_gains(s, ["grp"]), ["grp"], "gain", REPLICATES, SEED), "estimate", keys=["grp"]).select("grp", "lower")
    return corrections.thresholds(estimators.group_report(s, "grp").join(lower, "grp")).select("grp", "threshold", "passed")


# --- audits ------------------------------------------------------------------------------------------------------


@query(_PAIRS + ", n AS (SELECT arm, item, count(*) AS n FROM (SELECT arm, unnest([item_l, item_r]) AS item FROM pairs) GROUP BY ALL) SELECT arm, count(*) AS items, count(*) FILTER (n > 1) AS reused, max(n) AS most, round(quantile_cont(n, 0.0), 6) AS q0, round(quantile_cont(n, 0.25), 6) AS q25, round(quantile_cont(n, 0.5), 6) AS q50, round(quantile_cont(n, 0.75), 6) AS q75, round(quantile_cont(n, 0.95), 6) AS q95, round(quantile_cont(n, 1.0), 6) AS q100 FROM n GROUP BY arm".replace("round(quantile_cont(n, ", "round(quantile_cont(n::DOUBLE, "))
def participation_quantiles(spark, sf_dir):
    return rounded(audits.participation(pairs.matched_pairs(src.vector_items(spark, sf_dir, "evaluation")), ["arm"]))


@query(_PAIRS + """, e AS (SELECT stratum, arm, unnest([item_l, item_r]) AS item, unnest([subject_l, subject_r]) AS subject FROM pairs), k AS (SELECT stratum, arm, item, subject, count(*) AS n FROM e GROUP BY ALL)
SELECT stratum, arm, (SELECT count(*) FROM pairs p WHERE p.stratum = k.stratum AND p.arm = k.arm) AS pairs, count(DISTINCT item) AS items, count(DISTINCT subject) AS subjects, count(*) FILTER (n > 1) AS reused FROM k GROUP BY stratum, arm""")
def design_summary(spark, sf_dir):
    return rounded(audits.design(pairs.matched_pairs(src.vector_items(spark, sf_dir, "evaluation")), ["stratum", "arm"]))


@query(_PAIRS + """, e AS (SELECT arm, unnest([item_l, item_r]) AS item, unnest([subject_l, subject_r]) AS subject, category FROM pairs), k AS (SELECT item, count(DISTINCT arm) AS a, count(DISTINCT subject) AS s, count(DISTINCT category) AS c FROM e GROUP BY item)
SELECT count(*) AS items, count(*) FILTER (a > 1) AS shared, count(*) FILTER (a > 1 AND s > 1) AS not_nested_subject, count(*) FILTER (a > 1 AND c > 1) AS not_nested_category FROM k""")
def cross_arm_dependency(spark, sf_dir):
    p = pairs.matched_pairs(src.vector_items(spark, sf_dir, "evaluation"))
    return rounded(audits.cross_arm(p.withColumn("category_l", F.col("category")).withColumn("category_r", F.col("category"))))


@query(_ITEMS + """, c AS (SELECT subject, category, count(*) AS n FROM items GROUP BY ALL), k AS (SELECT category, count(DISTINCT condition) AS k FROM items GROUP BY category),
x AS (SELECT (SELECT count(*) FROM c) AS cells, (SELECT count(*) FILTER (n = 1) FROM c) AS singletons, (SELECT count(*) FROM k) AS categories, (SELECT count(*) FILTER (k = 1) FROM k) AS one_condition) SELECT *, singletons = 0 AND one_condition < categories AS passed FROM x""")
def variance_identifiability(spark, sf_dir):
    return rounded(audits.identifiability(src.vector_items(spark, sf_dir)))


_TWO = _ITEMS + """, a AS (SELECT 'P-' || row_number() OVER (ORDER BY a.item, b.item) AS pair_id, a.item AS item_l, b.item AS item_r, a.subject AS subject_l, b.subject AS subject_r FROM items a JOIN items b ON a.split = b.split AND a.subject = b.subject AND a.category < b.category WHERE a.split = 'calibration'),
b AS (SELECT 'P-' || row_number() OVER (ORDER BY a.item, b.item) AS pair_id, a.item AS item_l, b.item AS item_r, a.subject AS subject_l, b.subject AS subject_r FROM items a JOIN items b ON a.split = b.split AND a.subject = b.subject AND a.category < b.category WHERE a.condition = b.condition)"""


def _two(spark, sf_dir):
    """The C pairs of the calibration split, and those of both splits inside a condition."""
    items = src.vector_items(spark, sf_dir)
    named = lambda p: p.select("item_l", "item_r", F.col("subject").alias("subject_l"), F.col("subject").alias("subject_r"))
    return named(pairs.same_subject_across(items.where("split = 'calibration'"))), named(pairs.same_subject_across(items, ("condition",)))


def _two_numbered(spark, sf_dir):
    number = lambda x: numbered(x, "place", "item_l", "item_r").withColumn("pair_id", F.concat(F.lit("P-"), (F.col("place") + 1).cast("string"))).drop("place")
    return tuple(map(number, _two(spark, sf_dir)))


@query(_TWO + " SELECT count(*) AS n FROM a JOIN b USING (pair_id) WHERE [least(a.item_l, a.item_r), greatest(a.item_l, a.item_r)] <> [least(b.item_l, b.item_r), greatest(b.item_l, b.item_r)]")
def id_collisions(spark, sf_dir):
    return audits.collisions(*_two_numbered(spark, sf_dir)).agg(F.count("*").alias("n"))


@query(_TWO + """ SELECT 'pair' AS kind, count(*) AS shared FROM (SELECT least(item_l, item_r), greatest(item_l, item_r) FROM a INTERSECT SELECT least(item_l, item_r), greatest(item_l, item_r) FROM b)
UNION ALL SELECT 'item', count(*) FROM (SELECT unnest([item_l, item_r]) FROM a INTERSECT SELECT unnest([item_l, item_r]) FROM b) UNION ALL SELECT 'subject', count(*) FROM (SELECT unnest([subject_l, subject_r]) FROM a INTERSECT SELECT unnest([subject_l, subject_r]) FROM b)""")
def leakage_audit(spark, sf_dir):
    return rounded(audits.leakage(*_two(spark, sf_dir)))


@query("""SELECT item_id, n FROM (SELECT item_id, sha256(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS h FROM benchmark) JOIN (SELECT sha256(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS h, count(*) AS n FROM documents GROUP BY h) USING (h)""")
def text_leakage(spark, sf_dir):
    return audits.text_leakage(src.table(spark, sf_dir, "documents"), src.table(spark, sf_dir, "benchmark"))


@query("SELECT o_orderpriority AS role, o_orderstatus AS split, count(*) AS n, count(DISTINCT sha256(o_custkey::VARCHAR)) AS \"distinct\", count(*) - count(DISTINCT sha256(o_custkey::VARCHAR)) AS duplicated FROM orders GROUP BY ALL")
def manifest_roles(spark, sf_dir):
    o = src.order_items(spark, sf_dir)
    return rounded(audits.roles(o.select(F.col("category").alias("role"), F.col("condition").alias("split"), F.sha2(F.col("subject").cast("string"), 256).alias("sha256"))))


@query("SELECT 'o_orderpriority' AS field, count(DISTINCT o_orderpriority) AS variants FROM orders UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders")
def contract_differences(spark, sf_dir):
    return rounded(audits.differing(src.table(spark, sf_dir, "orders").withColumn("same", F.lit(1)), ["o_orderpriority", "o_orderstatus", "same"]))


@query("WITH e AS (SELECT DISTINCT label AS l, vec_id % 25 AS s FROM embeddings) SELECT l AS label, s AS subject FROM (SELECT DISTINCT label AS l FROM embeddings) CROSS JOIN (SELECT DISTINCT vec_id % 25 AS s FROM embeddings) WHERE (l, s) NOT IN (SELECT (l, s) FROM e)".replace("(l, s) NOT IN (SELECT (l, s) FROM e)", "NOT EXISTS (SELECT 1 FROM e WHERE e.l = label AND e.s = subject)").replace("SELECT l AS label, s AS subject FROM (SELECT DISTINCT label AS l FROM embeddings) CROSS JOIN (SELECT DISTINCT vec_id % 25 AS s FROM embeddings)", "SELECT label, subject FROM (SELECT DISTINCT label FROM embeddings) CROSS JOIN (SELECT DISTINCT vec_id % 25 AS subject FROM embeddings)"))
def grid_gaps(spark, sf_dir):
    e = src.table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 25).alias("subject"))
    return validate.grid_gaps(e.select("label").distinct().crossJoin(e.select("subject").distinct()), e, ["label", "subject"])


# --- matrices ----------------------------------------------------------------------------------------------------

_MAT = _ITEMS + f""", c AS (SELECT a.item AS i, b.item AS j, {_COS} AS value FROM items a JOIN items b ON a.condition = b.condition), gr AS (SELECT item AS i, category AS grp FROM items)"""


def _matrix(spark, sf_dir):
    """The distances of all items inside their condition, with their groups l and r, and the items' groups."""
    items = src.vector_items(spark, sf_dir)
    side = lambda i, g, s: items.select("condition", F.col("item").alias(i), F.col("category").alias(g), F.col("vec").alias(f"v{s}"), F.col("norm").alias(f"n{s}"))
    both = side("i", "l", "l").join(side("j", "r", "r"), "condition")
    d = both.select("i", "j", "l", "r", vectors.cosine_from(vectors.dot("vl", "vr", src.DIM), F.col("nl"), F.col("nr")).alias("value"))
    return d, items.select(F.col("item").alias("i"), F.col("category").alias("grp"))


@query(_MAT + """, m AS (SELECT grp, c.i, avg(value) AS m FROM c JOIN gr ON gr.i = c.i JOIN (SELECT i AS j, grp AS g2 FROM gr) h USING (j) WHERE grp = g2 GROUP BY grp, c.i), l AS (SELECT *, min(m) OVER (PARTITION BY grp) AS least FROM m)
SELECT grp, min(i) AS medoid, round(min(least), 6) AS mean FROM l WHERE m <= least + 1e-12 GROUP BY grp""")
def medoid(spark, sf_dir):
    return rounded(matrices.medoids(*_matrix(spark, sf_dir)))


@query(_MAT + ", b AS (SELECT g1.grp AS l, g2.grp AS r, CASE WHEN g1.grp = g2.grp THEN 0 ELSE avg(value) END AS value FROM c JOIN gr g1 ON g1.i = c.i JOIN gr g2 ON g2.i = c.j GROUP BY g1.grp, g2.grp) SELECT l, r, round(value, 6) AS value FROM b")
def aggregate_matrix(spark, sf_dir):
    return rounded(matrices.blocks(*_matrix(spark, sf_dir)))


@query(_MAT + ", b AS (SELECT g1.grp AS l, g2.grp AS r, CASE WHEN g1.grp = g2.grp THEN 0 ELSE avg(value) END AS value FROM c JOIN gr g1 ON g1.i = c.i JOIN gr g2 ON g2.i = c.j GROUP BY g1.grp, g2.grp), s AS (SELECT b.l, b.r, CASE WHEN b.l = b.r THEN 0 ELSE (b.value + t.value) / 2 END AS value FROM b JOIN b t ON t.l = b.r AND t.r = b.l) SELECT l, r, round(value / (SELECT max(value) FROM s), 6) AS value FROM s")
def normalised_matrix(spark, sf_dir):
    return rounded(matrices.normalised(matrices.blocks(*_matrix(spark, sf_dir))))


@query(_MAT + """, b AS (SELECT g1.grp AS l, g2.grp AS r, round(avg(value), 9) AS x, abs(g1.grp - g2.grp)::DOUBLE AS y FROM c JOIN gr g1 ON g1.i = c.i JOIN gr g2 ON g2.i = c.j WHERE g1.grp < g2.grp GROUP BY g1.grp, g2.grp),
k AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM b)
SELECT count(*) AS relations, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, (SELECT count(*) FROM b i JOIN b j ON (i.l, i.r) < (j.l, j.r) WHERE (i.x - j.x) * (i.y - j.y) < 0) AS reversals FROM k""")
def matrix_compare(spark, sf_dir):
    b = matrices.blocks(*_matrix(spark, sf_dir)).withColumn("value", F.round("value", 9))
    return rounded(matrices.compared(b, b.withColumn("value", F.abs(F.col("l") - F.col("r")).cast("double"))))


@query(_MAT + ", b AS (SELECT DISTINCT g1.grp AS l, g2.grp AS r FROM gr g1 CROSS JOIN gr g2) SELECT 'incomplete' AS rule, abs(count(*) - 100) AS n FROM b UNION ALL SELECT 'not_finite', 0 UNION ALL SELECT 'asymmetric', 0 UNION ALL SELECT 'diagonal', 0 UNION ALL SELECT 'no_positive', 0")
def matrix_violations(spark, sf_dir):
    return validate.matrix_violations(matrices.blocks(*_matrix(spark, sf_dir)), 10)


@query("SELECT 2::BIGINT AS l, 3::BIGINT AS r, 0.0::DOUBLE AS old, 1.0::DOUBLE AS \"new\"")
def zero_rule_changes(spark, sf_dir):
    labels = src.table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("l")).distinct()
    m = labels.crossJoin(labels.select(F.col("l").alias("r"))).withColumn("value", scoring.binary_reference(F.col("l"), F.col("r")))
    return matrices.changed(m, matrices.with_relation(m, 2, 3))


_HAV = "2 * 6371.0088 * atan2(sqrt(h), sqrt(1 - h))"


@query(f"""WITH p AS (SELECT c_custkey AS point, c_nationkey::BIGINT AS area, (c_custkey % 360 - 180)::DOUBLE AS lon, (c_custkey % 160 - 80)::DOUBLE AS lat FROM customer),
s AS (SELECT s_suppkey AS site, s_nationkey::BIGINT AS area, (s_suppkey % 360 - 180)::DOUBLE AS slon, (s_suppkey % 160 - 80)::DOUBLE AS slat FROM supplier),
k AS (SELECT point, area, site, {_HAV} AS km FROM (SELECT *, sin(radians(slat - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(slat)) * sin(radians(slon - lon) / 2) ** 2 AS h FROM p JOIN s USING (area)))
SELECT point, area, arg_min(site, (km, site)) AS site, round(min(km), 6) AS km FROM k GROUP BY point, area""")
def nearest_representative(spark, sf_dir):
    c, s = src.table(spark, sf_dir, "customer"), src.table(spark, sf_dir, "supplier")
    spot = lambda k: ((F.col(k) % 360 - 180).cast("double"), (F.col(k) % 160 - 80).cast("double"))
    (a, b), (x, y) = spot("c_custkey"), spot("s_suppkey")
    return rounded(matrices.nearest(c.select(F.col("c_custkey").alias("point"), F.col("c_nationkey").alias("area"), a.alias("lon"), b.alias("lat")), s.select(F.col("s_suppkey").alias("site"), F.col("s_nationkey").alias("area"), x.alias("lon"), y.alias("lat"))))


# --- pools -------------------------------------------------------------------------------------------------------


@query("SELECT source, count(*) AS \"values\", round(-sum(n / t * ln(n / t)), 6) AS entropy FROM (SELECT source, lang, count(*) AS n, sum(count(*)) OVER (PARTITION BY source) AS t FROM documents GROUP BY source, lang) GROUP BY source")
def pool_entropy(spark, sf_dir):
    return rounded(pools.entropy(src.table(spark, sf_dir, "documents"), "lang", ["source"]))


@query(_SCORED + """, e AS (SELECT grp, unnest([item_l, item_r]) AS i, unnest([subject_l, subject_r]) AS s FROM mp WHERE split = 'calibration')
SELECT grp, count(*) AS pairs, count(DISTINCT (least(category_l, category_r), greatest(category_l, category_r))) AS relations, round(avg(target), 6) AS mean_target, round(stddev_pop(target), 6) AS sd_target, (SELECT count(DISTINCT s) FROM e WHERE e.grp = mp.grp) AS subjects, round((SELECT 1 - count(DISTINCT i) / count(*) FROM e WHERE e.grp = mp.grp), 6) AS reuse FROM mp WHERE split = 'calibration' GROUP BY grp""")
def pool_covariates(spark, sf_dir):
    return rounded(pools.covariates(all_pairs(spark, sf_dir).where("split = 'calibration'"), ["grp"]))


@query(_SCORED + " SELECT round(gap / 9, 6) AS bin, count(*) AS n FROM mp GROUP BY bin".replace("GROUP BY bin", "GROUP BY round(gap / 9, 6)"))
def target_histogram(spark, sf_dir):
    return rounded(pools.histogram(all_pairs(spark, sf_dir).withColumn("target", F.col("gap") / 9)))


_Q = "(SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS q)"


@query(f"WITH c AS (SELECT count(*) FILTER (toxic <> 0) AS nz, count(*) FILTER (toxic = 0) AS z FROM labels), m AS (SELECT nz, z, least(CASE WHEN q > 0 THEN floor(nz / q) END, CASE WHEN q < 1 THEN floor(z / (1 - q)) END) AS m FROM c CROSS JOIN {_Q}) SELECT max(nz) AS nonzero, max(z) AS zero, (floor(min(m) / 20) * 20)::BIGINT AS capacity FROM m")
def prevalence_capacity(spark, sf_dir):
    return rounded(pools.prevalence_capacity(src.table(spark, sf_dir, "labels").withColumn("target", F.col("toxic"))))


@query(f"SELECT doc_id, q, rank <= round_even(q * n, 0) AS active FROM (SELECT doc_id, row_number() OVER (ORDER BY {_order('doc_id', SEED)}, doc_id) AS rank, count(*) OVER () AS n FROM labels) CROSS JOIN {_Q}")
def nested_masks(spark, sf_dir):
    return pools.nested_masks(src.table(spark, sf_dir, "labels"), "doc_id", SEED)


@query(f"SELECT q, doc_id FROM (SELECT doc_id, toxic <> 0 AS nz, row_number() OVER (PARTITION BY toxic <> 0 ORDER BY {_order('doc_id', SEED)}, doc_id) AS rank FROM labels) CROSS JOIN {_Q} WHERE rank <= CASE WHEN nz THEN round_even(q * 40, 0) ELSE 40 - round_even(q * 40, 0) END")
def natural_pools(spark, sf_dir):
    return pools.natural_pools(src.table(spark, sf_dir, "labels").withColumn("target", F.col("toxic")), "doc_id", 40, SEED)


@query("""WITH g AS (SELECT source, count(*) AS n, count(*) * 97 / sum(count(*)) OVER () AS exact FROM documents GROUP BY source), b AS (SELECT *, floor(exact) AS base FROM g)
SELECT source, n, (base + CASE WHEN row_number() OVER (ORDER BY round(base - exact, 9), source) <= 97 - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS share FROM b""")
def largest_remainder(spark, sf_dir):
    return pools.allocation(src.table(spark, sf_dir, "documents"), "source", 97)


def _tree_sql(ids: str) -> str:
    """Roots by fraction of the ids of ``ids`` (fraction, id): leaves of 256 numbers, seven levels, and what is left."""
    levels = [f"l0 AS (SELECT fraction, id >> 8 AS b, sha256(string_agg(id::VARCHAR, ',' ORDER BY id)) AS h, count(*) AS n FROM {ids} GROUP BY fraction, id >> 8)"]
    for k in range(1, inventory.LEVELS + 1):
        levels.append(f"l{k} AS (SELECT fraction, up AS b, sha256(string_agg(b || ':' || h, ',' ORDER BY b)) AS h, sum(n) AS n FROM (SELECT *, b >> 8 AS up FROM l{k - 1}) GROUP BY fraction, up)")
    return ", ".join(levels) + f" SELECT fraction, sum(n)::BIGINT AS n, sha256(string_agg(b || ':' || h, ',' ORDER BY b)) AS digest FROM l{inventory.LEVELS} GROUP BY fraction"


@query("""WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rank, count(*) OVER () AS n FROM embeddings),
x AS (SELECT fraction, vec_id AS id FROM r CROSS JOIN (SELECT unnest([0.25, 0.5, 1.0]::DOUBLE[]) AS fraction) WHERE rank <= round_even(r.n * fraction, 0)), """ + _tree_sql("x"))
def inventory_grid(spark, sf_dir):
    return inventory.inventories(src.table(spark, sf_dir, "embeddings"), "vec_id", (0.25, 0.5, 1.0))


@query(f"SELECT s AS subject, (row_number() OVER (ORDER BY {_order('s', SEED)}, s) - 1) % 5 AS fold FROM (SELECT DISTINCT vec_id % 25 AS s FROM embeddings)")
def grouped_folds(spark, sf_dir):
    return rounded(pools.folds(src.vector_items(spark, sf_dir), "subject", 5, SEED))


@query(f"SELECT doc_id, toxic, coalesce(lead(toxic) OVER w, first_value(toxic) OVER w) AS shuffled FROM labels WINDOW w AS (ORDER BY {_order('doc_id', SEED)}, doc_id)")
def rotated_targets(spark, sf_dir):
    return pools.rotated(src.table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "toxic", SEED)


@query(_SCORED + """, g AS (SELECT unnest(['ordinary', 'balanced']) AS mode, q, unnest([1.0, 0.4]::DOUBLE[]) AS f FROM (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS q)), m AS (SELECT mode, q, avg((base_error - error) * (1 + f * q)) AS g FROM scored CROSS JOIN g GROUP BY mode, q),
s AS (SELECT mode, regr_slope(g, q) AS s FROM m GROUP BY mode) SELECT round(max(s) FILTER (mode = 'ordinary'), 6) AS ordinary, round(max(s) FILTER (mode = 'balanced'), 6) AS balanced, round(max(s) FILTER (mode = 'ordinary') - max(s) FILTER (mode = 'balanced'), 6) AS contrast FROM s""")
def slope_contrast(spark, sf_dir):
    arm = lambda m, f: F.struct(F.lit(m).alias("mode"), F.lit(f).alias("f"))
    s = scored_pairs(spark, sf_dir).select((F.col("base_error") - F.col("error")).alias("d"))
    g = s.select("d", F.explode(F.array(arm("ordinary", 1.0), arm("balanced", 0.4))).alias("a")).select("d", "a.*", F.explode(F.array(*map(F.lit, pools.Q_GRID))).alias("q"))
    return rounded(pools.slope_contrast(g.select("mode", "q", (F.col("d") * (1 + F.col("f") * F.col("q"))).alias("gain"))))


@query("SELECT * FROM (VALUES ('one', 0.5::DOUBLE), ('ln_ratio', 0.25), ('strength', -1.0), ('product', 2.0)) AS t(term, coefficient)")
def interaction_regression(spark, sf_dir):
    """The regression gives back the coefficients its gains were made from."""
    e = src.table(spark, sf_dir, "events").select(F.pow(F.lit(2.0), F.col("event_id") % 4).alias("ratio"), (F.col("event_id") % 3 / F.lit(2.0)).alias("strength"))
    gain = 0.5 + 0.25 * F.ln("ratio") - F.col("strength") + 2 * F.col("strength") * F.ln("ratio")
    return rounded(pools.interaction_regression(e.withColumn("gain", gain)))


# --- order statistics --------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT o_orderpriority AS category, o_totalprice::DOUBLE AS v, (o_orderkey % 4)::BIGINT AS w FROM orders), r AS (SELECT category, v, sum(w) OVER (PARTITION BY category ORDER BY v) AS c, sum(w) OVER (PARTITION BY category) AS t FROM e WHERE w > 0)
SELECT category, min(v) AS median FROM r WHERE c >= t / 2 GROUP BY category""")
def weighted_median_lower(spark, sf_dir):
    o = src.order_items(spark, sf_dir).select("category", "value", (F.col("item") % 4).alias("w"))
    return ordering.lower_weighted_median(o, ["category"], "value", "w")


_HOLM = "WITH h AS (SELECT user_id, least(1.0, count(*) / 1000.0)::DOUBLE AS p FROM events GROUP BY user_id), r AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, user_id) + 1) AS raw FROM h)"


@query(_HOLM + " SELECT user_id, round(p, 6) AS p, round(least(1.0, max(raw) OVER (ORDER BY p, user_id ROWS UNBOUNDED PRECEDING)), 6) AS adjusted FROM r")
def holm(spark, sf_dir):
    p = src.table(spark, sf_dir, "events").groupBy("user_id").agg(F.least(F.lit(1.0), F.count("*") / F.lit(1000.0)).alias("p"))
    return rounded(ordering.holm(p, [], "p", "user_id")).withColumn("user_id", F.col("user_id"))


@query("SELECT o_orderpriority AS category, o_orderkey AS item, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2 AS \"rank\" FROM orders")
def spearman_ranks(spark, sf_dir):
    o = src.order_items(spark, sf_dir)
    return ordering.average_ranks(o.select("category", "item", "subject"), ["category"], "subject", "rank").select("category", "item", "rank")


@query("WITH p AS (SELECT s_nationkey AS k, round(avg(s_acctbal::DOUBLE), 4) AS harm, count(*) AS gain FROM supplier GROUP BY s_nationkey) SELECT k, NOT EXISTS (SELECT 1 FROM p b WHERE b.harm <= p.harm AND b.gain >= p.gain AND (b.harm < p.harm OR b.gain > p.gain)) AS efficient FROM p")
def pareto(spark, sf_dir):
    g = src.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.avg(F.col("s_acctbal").cast("double")), 4).alias("harm"), F.count("*").alias("gain"))
    return ordering.pareto(g, "harm", "gain").select("k", "efficient")


# --- resampling --------------------------------------------------------------------------------------------------

_DRAWS = f""", un AS (SELECT subject, row_number() OVER (ORDER BY subject) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT unnest([subject_l, subject_r]) AS subject FROM {{t}})),
dr AS (SELECT rep AS replicate, idx, count(*) AS m FROM (SELECT rep, {_draw('rep', 'k', 'n')} AS idx FROM (SELECT max(n) AS n FROM un) CROSS JOIN range({REPLICATES}) r(rep) CROSS JOIN LATERAL (SELECT unnest(range(n)) AS k)) GROUP BY ALL),
ws AS (SELECT replicate, subject, m FROM dr JOIN un USING (idx)),
pw AS (SELECT p.*, l.replicate, CASE WHEN subject_l = subject_r THEN l.m ELSE l.m * r.m END AS m FROM {{t}} p JOIN ws l ON l.subject = subject_l JOIN ws r ON r.subject = subject_r AND r.replicate = l.replicate)"""
_DRAWS = _DRAWS.replace("AS idx FROM (SELECT max(n) AS n FROM un)", "AS idx FROM (SELECT max(n) AS n FROM un)").replace("GROUP BY ALL", "GROUP BY rep, idx")
_WMED = """, cm AS (SELECT replicate, stratum, arm, distance, sum(m) OVER (PARTITION BY replicate, stratum, arm ORDER BY distance) AS c, sum(m) OVER (PARTITION BY replicate, stratum, arm) AS t FROM pw),
md AS (SELECT replicate, stratum, arm, min(distance) AS md FROM cm WHERE c >= t / 2 GROUP BY replicate, stratum, arm),
re AS (SELECT replicate, stratum, max(md) FILTER (arm = 'B') - max(md) FILTER (arm = 'A') AS e FROM md GROUP BY replicate, stratum HAVING count(*) = 2)"""


@query(_PAIRS + _DRAWS.format(t="pairs") + _WMED + ", ow AS (SELECT stratum, a * b / (a + b) AS w FROM (SELECT stratum, count(*) FILTER (arm = 'A') AS a, count(*) FILTER (arm = 'B') AS b FROM pairs GROUP BY stratum) WHERE a > 0 AND b > 0) SELECT replicate, round(sum(w * e) / sum(w), 6) AS estimate, count(*) AS strata FROM re JOIN ow USING (stratum) GROUP BY replicate")
def dyadic_bootstrap_global(spark, sf_dir):
    return rounded(resample.global_dyadic(evaluation_pairs(spark, sf_dir), REPLICATES, SEED))


_DRAWS_S = f""", un AS (SELECT stratum, subject, row_number() OVER (PARTITION BY stratum ORDER BY subject) - 1 AS idx FROM (SELECT DISTINCT stratum, unnest([subject_l, subject_r]) AS subject FROM pairs)), sz AS (SELECT stratum, count(*) AS n FROM un GROUP BY stratum),
dr AS (SELECT rep AS replicate, stratum, idx, count(*) AS m FROM (SELECT rep, stratum, {_draw('rep', 'k', 'n', _own_seed('stratum'))} AS idx FROM sz CROSS JOIN range({REPLICATES}) r(rep) CROSS JOIN LATERAL (SELECT unnest(range(n)) AS k)) GROUP BY rep, stratum, idx),
ws AS (SELECT replicate, stratum, subject, m FROM dr JOIN un USING (stratum, idx)),
pw AS (SELECT p.*, l.replicate, CASE WHEN subject_l = subject_r THEN l.m ELSE l.m * r.m END AS m FROM pairs p JOIN ws l ON l.subject = subject_l AND l.stratum = p.stratum JOIN ws r ON r.subject = subject_r AND r.stratum = p.stratum AND r.replicate = l.replicate)"""


@query(_PAIRS + _DRAWS_S + _WMED + " SELECT replicate, round(median(e), 6) AS estimate, count(*) AS strata FROM re GROUP BY replicate")
def dyadic_bootstrap_strata(spark, sf_dir):
    return rounded(resample.stratum_dyadic(evaluation_pairs(spark, sf_dir), REPLICATES, SEED))


@query(_SCORED + _DRAWS.format(t="scored") + """, pe AS (SELECT *, unnest(CASE WHEN subject_l = subject_r THEN [subject_l] ELSE [subject_l, subject_r] END) AS subject FROM pw),
s1 AS (SELECT replicate, subject, sum(m * base_error) / sum(m) AS b, sum(m * error) / sum(m) AS e FROM pe GROUP BY replicate, subject),
r1 AS (SELECT replicate, sum(m * base_error) / sum(m) AS b, sum(m * error) / sum(m) AS e FROM pw GROUP BY replicate, least(category_l, category_r), greatest(category_l, category_r)), t1 AS (SELECT replicate, sum(m * base_error) / sum(m) AS b, sum(m * error) / sum(m) AS e FROM pw GROUP BY replicate, stratum)
SELECT replicate, 'pair' AS weighting, round((sum(m * base_error) - sum(m * error)) / sum(m * base_error), 6) AS gain FROM pw GROUP BY replicate
UNION ALL SELECT replicate, 'endpoint_subject', round((sum(m * b) - sum(m * e)) / sum(m * b), 6) FROM s1 JOIN ws USING (replicate, subject) GROUP BY replicate
UNION ALL SELECT replicate, 'category_relation', round((avg(b) - avg(e)) / avg(b), 6) FROM r1 GROUP BY replicate UNION ALL SELECT replicate, 'stratum', round((avg(b) - avg(e)) / avg(b), 6) FROM t1 GROUP BY replicate""")
def dyadic_bootstrap_weighting(spark, sf_dir):
    return rounded(resample.weighted_gains(settled(scored_pairs(spark, sf_dir)), REPLICATES, SEED))


@query(_PAIRS + """, eff AS (SELECT category, count(*) FILTER (arm = 'A') * count(*) FILTER (arm = 'B') / count(*) AS weight, median(distance) FILTER (arm = 'B') - median(distance) FILTER (arm = 'A') AS effect FROM pairs GROUP BY category HAVING count(*) FILTER (arm = 'A') > 0 AND count(*) FILTER (arm = 'B') > 0),
o AS (SELECT row_number() OVER (ORDER BY category) - 1 AS i, effect * weight / sum(weight) OVER () AS t FROM eff), k AS (SELECT count(*) AS k, sum(t) AS s FROM o),
v AS (SELECT id, sum(CASE WHEN (id >> i) & 1 = 1 THEN -t ELSE t END) AS x FROM (SELECT unnest(range(0, (1 << k)::BIGINT)) AS id FROM k) CROSS JOIN o GROUP BY id)
SELECT (SELECT k FROM k) AS strata, count(*) AS vectors, round((SELECT s FROM k), 6) AS observed, count(*) FILTER (abs(x) >= abs((SELECT s FROM k)) - 1e-12) AS extreme, round(count(*) FILTER (abs(x) >= abs((SELECT s FROM k)) - 1e-12) / count(*), 6) AS p FROM v""")
def exact_sign_flip(spark, sf_dir):
    """All evaluation pairs, stratified by category: every sign vector of the ten strata."""
    p = evaluation_pairs(spark, sf_dir).withColumn("stratum", F.concat_ws("|", "split", "category"))
    return rounded(resample.exact_sign_flip(estimators.stratum_effects(p)))


@query(_PAIRS + _ENDS.format(t="pairs") + f""", se AS (SELECT *, row_number() OVER (ORDER BY stratum, subject) AS u FROM (SELECT stratum, subject, avg(distance) FILTER (arm = 'B') - avg(distance) FILTER (arm = 'A') AS e FROM ends GROUP BY stratum, subject) WHERE e IS NOT NULL),
nu AS (SELECT rep, median(s) AS t FROM (SELECT rep, stratum, median(e * (1 - 2 * {_draw('rep', 'u', '2')})) AS s FROM se CROSS JOIN range({REPLICATES}) r(rep) GROUP BY rep, stratum) GROUP BY rep), ob AS (SELECT median(s) AS o FROM (SELECT median(e) AS s FROM se GROUP BY stratum))
SELECT round(max(o), 6) AS observed, round((count(*) FILTER (t >= o) + 1) / (count(*) + 1), 6) AS p FROM nu CROSS JOIN ob""")
def cluster_sign_flip(spark, sf_dir):
    return rounded(resample.cluster_sign_flip(resample.subject_effects(evaluation_pairs(spark, sf_dir)), REPLICATES, SEED))


_OVERLAP = ", ow AS (SELECT stratum, a * b / (a + b) AS w FROM (SELECT stratum, count(*) FILTER (arm = 'A') AS a, count(*) FILTER (arm = 'B') AS b FROM pairs GROUP BY stratum) WHERE a > 0 AND b > 0)"
_ITEM_DRAWS = f""", un AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT unnest([arm || '#' || item_l, arm || '#' || item_r]) AS unit FROM pairs)),
dr AS (SELECT rep AS replicate, idx, count(*) AS m FROM (SELECT rep, {_draw('rep', 'k', 'n')} AS idx FROM (SELECT max(n) AS n FROM un) CROSS JOIN range({REPLICATES}) r(rep) CROSS JOIN LATERAL (SELECT unnest(range(n)) AS k)) GROUP BY rep, idx),
ws AS (SELECT replicate, unit, m FROM dr JOIN un USING (idx)),
pw AS (SELECT p.*, l.replicate, l.m * r.m AS m FROM pairs p JOIN ws l ON l.unit = arm || '#' || item_l JOIN ws r ON r.unit = arm || '#' || item_r AND r.replicate = l.replicate)"""


@query(_PAIRS + _ITEM_DRAWS + _WMED + _OVERLAP + " SELECT replicate, round(sum(w * e) / sum(w), 6) AS estimate, count(*) AS strata FROM re JOIN ow USING (stratum) GROUP BY replicate")
def item_block_bootstrap(spark, sf_dir):
    return rounded(resample.arm_items(evaluation_pairs(spark, sf_dir), REPLICATES, SEED, independent=True))


_NESTED = f""", u AS (SELECT {{g}}, subject, row_number() OVER (PARTITION BY {{g}} ORDER BY subject) - 1 AS s, count(*) OVER (PARTITION BY {{g}}) AS z FROM (SELECT DISTINCT {{g}}, subject FROM ends)),
er AS (SELECT *, row_number() OVER (PARTITION BY {{g}}, subject ORDER BY item_l, item_r) - 1 AS i, count(*) OVER (PARTITION BY {{g}}, subject) AS n FROM ends),
o AS (SELECT rep, {{g}}, j, {_draw('rep', 'j', 'z', '{outer}')} AS s FROM (SELECT DISTINCT {{g}}, z FROM u) CROSS JOIN range({REPLICATES}) r(rep) CROSS JOIN LATERAL (SELECT unnest(range(z)) AS j)),
d AS (SELECT rep, {{g}}, j, subject, {_draw('rep', 'k', 'n', '{inner}')} AS i FROM o JOIN u USING ({{g}}, s) JOIN (SELECT DISTINCT {{g}}, subject, n FROM er) USING ({{g}}, subject) CROSS JOIN LATERAL (SELECT unnest(range(n)) AS k))"""


def _nested(*group: str) -> str:
    return _NESTED.format(g=", ".join(group), outer=_own_seed(*group), inner=_own_seed(*group, "j", seed=SEED + 1))


@query(_PAIRS + _ENDS.format(t="pairs") + _nested("stratum", "arm") + """, md AS (SELECT rep, stratum, arm, median(distance) AS m FROM d JOIN er USING (stratum, arm, subject, i) GROUP BY rep, stratum, arm)
SELECT rep AS replicate, round(median(e), 6) AS estimate FROM (SELECT rep, stratum, max(m) FILTER (arm = 'B') - max(m) FILTER (arm = 'A') AS e FROM md GROUP BY rep, stratum HAVING count(*) = 2) GROUP BY rep""")
def nested_cluster_bootstrap(spark, sf_dir):
    return rounded(resample.nested_cluster(evaluation_pairs(spark, sf_dir), REPLICATES, SEED))


@query(_PAIRS + _ENDS.format(t="pairs") + f""", us AS (SELECT category, subject FROM ends GROUP BY category, subject HAVING count(DISTINCT arm) = 2), us2 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY subject) - 1 AS s, count(*) OVER (PARTITION BY category) AS z FROM us),
er AS (SELECT category, subject, arm, distance, row_number() OVER (PARTITION BY category, subject, arm ORDER BY item_l, item_r) - 1 AS i, count(*) OVER (PARTITION BY category, subject, arm) AS n FROM ends JOIN us USING (category, subject)),
ca AS (SELECT category, z, row_number() OVER (ORDER BY category) - 1 AS c, count(*) OVER () AS cs FROM (SELECT DISTINCT category, z FROM us2)),
o AS (SELECT rep, a, {_draw('rep', 'a', 'cs')} AS c FROM (SELECT max(cs) AS cs FROM ca) CROSS JOIN range({REPLICATES}) r(rep) CROSS JOIN LATERAL (SELECT unnest(range(cs)) AS a)),
m AS (SELECT rep, a, b, category, {_draw('rep', 'b', 'z', _own_seed('a', seed=SEED + 1))} AS s FROM o JOIN ca USING (c) CROSS JOIN LATERAL (SELECT unnest(range(z)) AS b)),
d AS (SELECT rep, a, b, category, subject, arm, {_draw('rep', 'k', 'n', _own_seed('a', 'b', 'arm', seed=SEED + 2))} AS i FROM m JOIN us2 USING (category, s) JOIN (SELECT DISTINCT category, subject, arm, n FROM er) USING (category, subject) CROSS JOIN LATERAL (SELECT unnest(range(n)) AS k)),
e AS (SELECT rep, a, b, avg(distance) FILTER (arm = 'B') - avg(distance) FILTER (arm = 'A') AS e FROM d JOIN er USING (category, subject, arm, i) GROUP BY rep, a, b)
SELECT rep AS replicate, round(avg(e), 6) AS estimate FROM e GROUP BY rep""")
def hierarchical_bootstrap(spark, sf_dir):
    return rounded(resample.hierarchical(evaluation_pairs(spark, sf_dir), REPLICATES, SEED))


@query(_PAIRS + f""", us AS (SELECT category FROM pairs GROUP BY category HAVING count(DISTINCT arm) = 2),
er AS (SELECT category, arm, distance, row_number() OVER (PARTITION BY category, arm ORDER BY item_l, item_r) - 1 AS i, count(*) OVER (PARTITION BY category, arm) AS n FROM pairs JOIN us USING (category)),
ca AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS c, count(*) OVER () AS cs FROM us),
o AS (SELECT rep, j, {_draw('rep', 'j', 'cs')} AS c FROM (SELECT max(cs) AS cs FROM ca) CROSS JOIN range({REPLICATES}) r(rep) CROSS JOIN LATERAL (SELECT unnest(range(cs)) AS j)),
d AS (SELECT rep, j, category, arm, {_draw('rep', 'k', 'n', _own_seed('j', 'arm', seed=SEED + 1))} AS i FROM o JOIN ca USING (c) JOIN (SELECT DISTINCT category, arm, n FROM er) USING (category) CROSS JOIN LATERAL (SELECT unnest(range(n)) AS k)),
e AS (SELECT rep, j, avg(distance) FILTER (arm = 'B') - avg(distance) FILTER (arm = 'A') AS e FROM d JOIN er USING (category, arm, i) GROUP BY rep, j)
SELECT rep AS replicate, round(avg(e), 6) AS estimate FROM e GROUP BY rep""")
def stratified_mean_bootstrap(spark, sf_dir):
    return rounded(resample.stratified_mean(evaluation_pairs(spark, sf_dir), REPLICATES, SEED))


@query(_PAIRS + _DRAWS.format(t="pairs") + _WMED + """, k AS (SELECT replicate, stratum, arm, subject, sum(m) AS k FROM (SELECT *, unnest(CASE WHEN subject_l = subject_r THEN [subject_l] ELSE [subject_l, subject_r] END) AS subject FROM pw) GROUP BY replicate, stratum, arm, subject),
su AS (SELECT replicate, stratum, arm, count(*) AS s, sum(k) * sum(k) / sum(k * k) AS e FROM k GROUP BY replicate, stratum, arm), np AS (SELECT replicate, stratum, arm, sum(m) AS p FROM pw GROUP BY replicate, stratum, arm),
w AS (SELECT replicate, stratum, max(p) FILTER (arm = 'A') AS pa, max(p) FILTER (arm = 'B') AS pb, max(s) FILTER (arm = 'A') AS sa, max(s) FILTER (arm = 'B') AS sb, max(su.e) FILTER (arm = 'A') AS ea, max(su.e) FILTER (arm = 'B') AS eb FROM su JOIN np USING (replicate, stratum, arm) GROUP BY replicate, stratum HAVING count(*) = 2)
SELECT replicate, round(sum(pa * pb / (pa + pb) * e) / sum(pa * pb / (pa + pb)), 6) AS by_pairs, round(sum(sa * sb / (sa + sb) * e) / sum(sa * sb / (sa + sb)), 6) AS by_subjects, round(sum(ea * eb / (ea + eb) * e) / sum(ea * eb / (ea + eb)), 6) AS by_ess
FROM w JOIN re USING (replicate, stratum) GROUP BY replicate""")
def support_bootstrap(spark, sf_dir):
    return rounded(resample.support_bootstrap(evaluation_pairs(spark, sf_dir), REPLICATES, SEED))


_QUANTS = "round(quantile_cont({v}, 0.025), 6) AS lower, round(quantile_cont({v}, 0.975), 6) AS upper, round(stddev_samp({v}), 6) AS sd, count({v}) AS replicates"


@query(_SCORED + f""", s AS (SELECT item_l || '-' || item_r AS pair_id, base_error, error FROM scored WHERE grp IN ('A', 'C')), un AS (SELECT pair_id, row_number() OVER (ORDER BY pair_id) - 1 AS idx FROM s), sz AS (SELECT count(*) AS n FROM un),
dr AS (SELECT rep, idx, count(*) AS m FROM (SELECT rep, {_draw('rep', 'k', 'n')} AS idx FROM sz CROSS JOIN range({REPLICATES}) r(rep) CROSS JOIN LATERAL (SELECT unnest(range(n)) AS k)) GROUP BY rep, idx),
g AS (SELECT rep, sum(m * base_error) / sum(m) AS b, sum(m * error) / sum(m) AS e FROM dr JOIN un USING (idx) JOIN s USING (pair_id) GROUP BY rep), h AS (SELECT CASE WHEN b <= 0 THEN 0.0 ELSE (b - e) / b END AS gain FROM g)
SELECT {_QUANTS.format(v='gain')} FROM h""")
def row_gain_interval(spark, sf_dir):
    s = scored_pairs(spark, sf_dir).withColumn("pair_id", F.concat_ws("-", "item_l", "item_r")).where("grp IN ('A', 'C')")
    return rounded(resample.interval(resample.row_gain(s, REPLICATES, "pair_id", SEED), "gain"))


_CLUSTERED = _SCORED + _ENDS.format(t="scored") + _nested("stratum") + """, cl AS (SELECT rep, stratum, j, avg(base_error - error) AS x FROM d JOIN er USING (stratum, subject, i) GROUP BY rep, stratum, j),
al AS (SELECT rep, avg(x) AS delta FROM (SELECT rep, stratum, avg(x) AS x FROM cl GROUP BY rep, stratum) GROUP BY rep
 UNION ALL SELECT -1, avg(x) FROM (SELECT stratum, avg(x) AS x FROM (SELECT stratum, subject, avg(base_error - error) AS x FROM ends GROUP BY stratum, subject) GROUP BY stratum))"""


@query(_CLUSTERED + " SELECT rep AS replicate, round(delta, 6) AS delta FROM al")
def clustered_delta_bootstrap(spark, sf_dir):
    s = scored_pairs(spark, sf_dir).withColumn("delta", F.col("base_error") - F.col("error"))
    return rounded(resample.clustered_delta(s, REPLICATES, SEED))


@query()
def ranking_bootstrap(spark, sf_dir):
    """Ranking metrics in each replicate of a shared draw of subjects."""
    rel = resample.relation_means(scored_pairs(spark, sf_dir), "distance", REPLICATES, SEED)
    named = rel.select("replicate", (F.col("rel_l") * 1000 + F.col("rel_r")).alias("relation"), F.abs(F.col("rel_l") - F.col("rel_r")).cast("double").alias("reference"), F.round("mean", 9).alias("predicted"))
    return rounded(estimators.ranking_metrics(named, ["replicate"]))


@query(_SCORED + _ENDS.format(t="scored") + f""", sg AS (SELECT subject, avg(base_error - error) AS d FROM ends GROUP BY subject), un AS (SELECT *, row_number() OVER (ORDER BY subject) - 1 AS idx, count(*) OVER () AS n FROM sg),
qs AS (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS q), dr AS (SELECT rep, q, idx, count(*) AS m FROM (SELECT rep, q, {_draw('rep', 'k', 'n', _own_seed('q'))} AS idx FROM (SELECT max(n) AS n FROM un) CROSS JOIN qs CROSS JOIN range({REPLICATES}) r(rep) CROSS JOIN LATERAL (SELECT unnest(range(n)) AS k)) GROUP BY rep, q, idx),
mg AS (SELECT rep, mode, q, sum(m * d * (1 + f * q)) / sum(m) AS g FROM dr JOIN un USING (idx) CROSS JOIN (VALUES ('ordinary', 1.0::DOUBLE), ('balanced', 0.4)) AS a(mode, f) GROUP BY rep, mode, q), sl AS (SELECT rep, mode, regr_slope(g, q) AS s FROM mg GROUP BY rep, mode)
SELECT rep AS replicate, round(max(s) FILTER (mode = 'ordinary') - max(s) FILTER (mode = 'balanced'), 6) AS contrast FROM sl GROUP BY rep""")
def slope_bootstrap(spark, sf_dir):
    s = estimators.endpoints(scored_pairs(spark, sf_dir)).groupBy("subject").agg(F.avg(F.col("base_error") - F.col("error")).alias("d"))
    arm = lambda m, f: F.struct(F.lit(m).alias("mode"), F.lit(f).alias("f"))
    g = s.select("subject", "d", F.explode(F.array(arm("ordinary", 1.0), arm("balanced", 0.4))).alias("a")).select("subject", "d", "a.*", F.explode(F.array(*map(F.lit, pools.Q_GRID))).alias("q"))
    return rounded(resample.slope_bootstrap(g.select("mode", "q", "subject", (F.col("d") * (1 + F.col("f") * F.col("q"))).alias("gain")), REPLICATES, SEED))


# --- fits on cells, heads ----------------------------------------------------------------------------------------


@query()
def subject_component_removal(spark, sf_dir):
    """Mean distance of evaluation pairs after taking out the k directions that part calibration subjects most."""
    items = src.vector_items(spark, sf_dir)
    mean, dirs = corrections.subject_components(items.where("split = 'calibration'"), 10)
    p = pairs.matched_pairs(items.where("split = 'evaluation'"))
    out = None
    for k in (0, 1, 2, 5, 10):
        d = scoring.distances(p, corrections.without(items, mean, dirs[:k]), "distinct").groupBy("arm").agg(F.count("*").alias("n"), F.avg("distance").alias("mean")).withColumn("k", F.lit(k))
        out = d if out is None else out.unionByName(d)
    return rounded(out)


@query(_ITEMS + """, u AS (SELECT subject, category, condition, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS k FROM items),
c AS (SELECT *, x - avg(x) OVER (PARTITION BY k, category) AS xt, condition - avg(condition) OVER (PARTITION BY k, category) AS dt FROM u),
b AS (SELECT k, CASE WHEN sum(dt * dt) > 0 THEN sum(dt * xt) / sum(dt * dt) ELSE 0 END AS b FROM c GROUP BY k), r AS (SELECT k, subject, xt - b.b * dt AS z FROM c JOIN b USING (k)),
s AS (SELECT k, subject, count(*) AS n, sum(z) AS s, sum(z * z) AS q FROM r GROUP BY k, subject), t AS (SELECT k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b, count(*) AS g FROM s GROUP BY k)
SELECT k, round(((b - s * s / n) / (g - 1)) / ((q - b) / (n - g)), 6) AS f FROM t""")
def subject_f_residual(spark, sf_dir):
    """F of subject on every coordinate, less what category and condition explain. The SQL's closed form is that of two conditions, which the tables of the small scales have."""
    t = corrections.f_sums(src.vector_items(spark, sf_dir).withColumn("z", F.col("vec")), ("category", "condition"))
    f = ((F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("g") - 1)) / ((F.col("q") - F.col("b")) / (F.col("n") - F.col("g")))
    return rounded(t.select("k", f.alias("f")))


@query()
def principal_baseline(spark, sf_dir):
    """The baseline of the 16 strongest directions of the calibration split, by block power iteration: the clamped fit on calibration pairs and the errors on evaluation pairs. No SQL: it is
    iterative (held against a dense solution in the tests)."""
    items = src.vector_items(spark, sf_dir)
    mean, dirs = corrections.principal_directions(items.where("split = 'calibration'"), 16)
    shown = heads.projected(items, mean, dirs)
    p = all_pairs(spark, sf_dir).drop("distance")
    d = scoring.distances(p, shown, "distinct", 16)
    fit = scoring.affine(d.where("split = 'calibration'"), "distance", "target", clamped=True)
    s = scoring.scored(d.where("split = 'evaluation'"), fit)
    return rounded(s.groupBy("grp").agg(F.count("*").alias("n"), F.avg("distance").alias("distance"), F.avg("error").alias("mae")))


@query()
def ridge_correction(spark, sf_dir):
    """Cell offsets predicted from subjects' centroids in the second view by ridge regression, taken from the vectors; mean distance by arm. No SQL: it is a fit (held against a dense one in the tests)."""
    items = src.proxy_items(spark, sf_dir, "evaluation")
    centred = regression.centroids(items)
    fixed = regression.cleaned(items, centred, regression.fit(regression.blocks(regression.cells(items, centred))))
    return rounded(scoring.distances(pairs.matched_pairs(fixed), fixed, "distinct").groupBy("arm").agg(F.count("*").alias("n"), F.avg("distance").alias("mean")))


@query()
def rank_one_modulation(spark, sf_dir):
    """The block-regularised rank-one term of the calibration split: its strength in every category."""
    items = src.proxy_items(spark, sf_dir, "calibration")
    fit = regression.fit(regression.blocks(regression.cells(items, regression.centroids(items))), penalty=regression.BLOCK_PENALTIES, rank_one=True)
    return rounded(spark.createDataFrame([(int(c), float(abs(x)), float(fit.r2)) for c, x in sorted(fit.strength.items())], "category long, strength double, r2 double"))


@query()
def canonical_correlations(spark, sf_dir):
    """Canonical correlations of the cells' mean vectors with their subjects' centroids in the second view."""
    items = src.proxy_items(spark, sf_dir, "evaluation")
    rho = corrections.canonical_correlations(regression.cells(items, regression.centroids(items)), "y", "x")
    return rounded(spark.createDataFrame([(k, float(x)) for k, x in enumerate(rho)], "k long, correlation double"))


@query()
def linear_probe(spark, sf_dir):
    items = src.vector_items(spark, sf_dir)
    return rounded(spark.createDataFrame([("category", corrections.probe_accuracy(items, "category"))], "label string, accuracy double"))


@query()
def identity_head_scores(spark, sf_dir):
    """Distances under the standardised principal head, fitted on the calibration split."""
    items = src.vector_items(spark, sf_dir)
    w = corrections.identity_head(items.where("split = 'calibration'"), 16)
    t = heads.transform(items.where("split = 'evaluation'"), {"w1": w})
    return rounded(scoring.distances(pairs.matched_pairs(t), t, "distinct", 16).groupBy("arm").agg(F.count("*").alias("n"), F.avg("distance").alias("mean")))


@query()
def component_control(spark, sf_dir):
    """As many random directions taken out instead: mean distance by arm."""
    items = src.vector_items(spark, sf_dir)
    mean, _ = corrections.components(items.where("split = 'calibration'"))
    p = pairs.matched_pairs(items.where("split = 'evaluation'"))
    changed = corrections.without(items, mean, corrections.random_directions(src.DIM, 5, SEED))
    return rounded(scoring.distances(p, changed, "distinct").groupBy("arm").agg(F.count("*").alias("n"), F.avg("distance").alias("mean")))


@query(_SCORED + _ENDS.format(t="scored") + " SELECT subject, round(avg(base_error - error), 6) AS gain FROM ends GROUP BY subject")
def subject_gains(spark, sf_dir):
    return rounded(resample.subject_gains(scored_pairs(spark, sf_dir)))


@query(_CLUSTERED + """ SELECT round(max(delta) FILTER (rep = -1), 6) AS observed, round(quantile_cont(delta, 0.025) FILTER (rep >= 0), 6) AS lower, round(quantile_cont(delta, 0.975) FILTER (rep >= 0), 6) AS upper,
round((count(*) FILTER (rep >= 0 AND delta <= 0) + 1) / (count(*) FILTER (rep >= 0) + 1), 6) AS p, quantile_cont(delta, 0.025) FILTER (rep >= 0) > 0 AS passed FROM al""")
def paired_contrast(spark, sf_dir):
    s = scored_pairs(spark, sf_dir).withColumn("delta", F.col("base_error") - F.col("error"))
    return rounded(resample.contrast(s, REPLICATES, SEED))


@query()
def interaction_bootstrap(spark, sf_dir):
    g = resample.subject_gains(scored_pairs(spark, sf_dir))
    grid = g.withColumn("ratio", F.explode(F.array(*map(F.lit, (1.0, 2.0, 4.0, 8.0))))).withColumn("strength", F.explode(F.array(*map(F.lit, (0.0, 0.5, 1.0)))))
    return rounded(resample.interaction_bootstrap(grid.withColumn("gain", F.col("gain") * (1 + F.col("strength") * F.ln("ratio"))), REPLICATES, SEED))


@query("SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) AS h FROM documents")
def content_hashes(spark, sf_dir):
    """SHA-256 of NFKC text; the driver's texts have no compatibility characters, so NFC in the SQL is the same."""
    from pairlens.functions.text import content_hash

    return src.table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("h"))


# --- gates -------------------------------------------------------------------------------------------------------


@query(_EFFECTS + ", g AS (SELECT count(*) AS k, sum(contribution) / sum(weight) AS e, min(n_a) AS a FROM eff) SELECT k >= 4 AS enough_strata, a >= 1 AS both_arms, abs(e) >= 0.05 AS large_effect, k >= 4 AND a >= 1 AND abs(e) >= 0.05 AS passed FROM g")
def effect_gate(spark, sf_dir):
    e = estimators.stratum_effects(evaluation_pairs(spark, sf_dir)).agg(F.count("*").alias("k"), (F.sum("contribution") / F.sum("weight")).alias("e"), F.min("n_a").alias("a"))
    return gates.gate(e, {"enough_strata": F.col("k") >= 4, "both_arms": F.col("a") >= 1, "large_effect": F.abs("e") >= 0.05})


@query(_SCORED + ", g AS (SELECT grp AS name, avg(error) < avg(base_error) AS passed FROM scored GROUP BY grp) SELECT count(*) AS gates, list_sort(list(name) FILTER (NOT passed)) AS failed, bool_and(passed) AS passed FROM g".replace("list_sort(list(name) FILTER (NOT passed))", "coalesce(array_to_string(list_sort(list(name) FILTER (NOT passed)), ','), '')"))
def consolidated_gate(spark, sf_dir):
    g = estimators.group_report(scored_pairs(spark, sf_dir), "grp").select(F.col("grp").alias("name"), (F.col("mae") < F.col("base_mae")).alias("passed"))
    return gates.consolidated(g).select("gates", F.array_join("failed", ",").alias("failed"), "passed")


@query("SELECT CASE WHEN a::INT + b::INT + c::INT = 1 THEN 'unique' WHEN a::INT + b::INT + c::INT > 1 THEN 'multiple' ELSE 'unresolved' END AS status, concat_ws(',', CASE WHEN a THEN 'a' END, CASE WHEN b THEN 'b' END, CASE WHEN c THEN 'c' END) AS mechanisms FROM (SELECT count(*) > 10 AS a, avg(value) > 1e9 AS b, max(value) > min(value) AS c FROM events)")
def mechanism_classifier(spark, sf_dir):
    e = src.table(spark, sf_dir, "events").agg((F.count("*") > 10).alias("a"), (F.avg("value") > 1e9).alias("b"), (F.max("value") > F.min("value")).alias("c"))
    return gates.mechanism(e, ["a", "b", "c"])


# --- extensions: nothing of the kind in the reference workload ----------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, 2"))
def ext_tumbling(spark, sf_dir):
    t = ev.tumbling(src.table(spark, sf_dir, "events"))
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts::TIMESTAMP AS ts, CASE WHEN ts::TIMESTAMP - lag(ts::TIMESTAMP) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def ext_sessions(spark, sf_dir):
    s = ev.sessions(src.table(spark, sf_dir, "events"))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity::DOUBLE), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark, sf_dir):
    return src.table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity").cast("double")), 2).alias("quantity"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY sha256(lower(trim(text))) HAVING count(*) > 1")
def ext_exact_copies(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents")
    return d.groupBy(F.sha2(F.lower(F.trim("text")), 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1").select("doc_id", "n")


@query("SELECT coalesce(l.quality, -1)::BIGINT AS quality, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def ext_label_balance(spark, sf_dir):
    d, lab = src.table(spark, sf_dir, "documents"), src.table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").groupBy(F.coalesce("quality", F.lit(-1)).cast("long").alias("quality")).agg(F.count("*").alias("n"))


del scalars

from pairlens.plans import reports, studies  # noqa: E402, F401  (they register their queries here)
