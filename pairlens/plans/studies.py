"""Registered studies that train: prevalence, pool ratios, gradient isolation, pair diversity, heads by references, and the gates over what was trained.

Every study is a grid of cells over one written table of examples (``training``); seeds, controls and references are cells of their own. No SQL: training is iterative;
the tests hold it against training in one place, and the rules over its results have SQL as queries of their own elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.functions.ordering import holm
from pairlens.operators import gates, pools, resample, training
from pairlens.plans.catalogue import REPLICATES, SEED, all_pairs, query, rounded
from pairlens.plans.scan import Run, scan
from pairlens.plans.storage import settled
from pairlens.sources import items as src

#: Width of the heads, steps of the training, and the share of the examples in a step's batch.
OUT, STEPS, SHARE = 16, 10, 0.5
SEEDS = [1, 2, 3, 4, 5]


def _material(spark: SparkSession, sf_dir: str, view: str = "vec", also: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calibration pairs with kind, targets and their place, calibration items, blocks of evaluation pairs, with the columns of ``also``) under one view. Calibration pairs of one category are pair
    examples or, by half, check pairs; those across categories are cross examples. No row of a pair carries a vector."""
    items = settled(src.proxy_items(spark, sf_dir).withColumn("vec", F.col(view)).select("item", "subject", "category", "split", "vec"))
    every = all_pairs(spark, sf_dir).select(F.col("stratum").alias("place"), "item_l", "item_r", "subject_l", "subject_r", "category_l", "category_r", "split", "grp", "target", (F.col("gap") / 9).alias("target_gap"))
    half = F.xxhash64("item_l", "item_r").bitwiseAND(1) == 1
    kind = F.when(half & F.col("grp").isin("A", "B", "C"), "check").when(F.col("grp").isin("A", "B"), "pair").otherwise("cross")
    pairs = settled(every.where("split = 'calibration'").drop("split").withColumn("kind", kind))
    scored = every.where("split = 'evaluation'").select("place", "item_l", "item_r", "subject_l", "subject_r", "target", "target_gap", *(c.alias(n) for n, c in (also or {}).items()))
    return pairs, items.where("split = 'calibration'"), training.blocks(scored, items)


def _made(pairs: DataFrame, items: DataFrame, masks: bool = True) -> DataFrame:
    """The blocks of the examples, with what training reads of them."""
    return training.blocks(training.ranked(pairs.drop("subject_l", "subject_r", "category_l", "category_r", "grp"), masks=masks), items)


def _gains(trained: DataFrame, made: DataFrame, scored: DataFrame) -> DataFrame:
    """(cell, settings, loss, subject, n, error, base_error, gain), written."""
    got = training.subject_gains(trained, made, scored, OUT)
    return settled(trained.drop("weights", "log").join(got, "cell"))


def _whole(gains: DataFrame, *keys: str) -> DataFrame:
    """(keys, gain): the relative gain over all ends of pairs."""
    g = gains.groupBy(*keys).agg((F.sum(F.col("n") * F.col("error")) / F.sum("n")).alias("e"), (F.sum(F.col("n") * F.col("base_error")) / F.sum("n")).alias("b"))
    return g.select(*keys, F.when(F.col("b") <= 0, 0.0).otherwise((F.col("b") - F.col("e")) / F.col("b")).alias("gain"))


# --- prevalence ----------------------------------------------------------------------------------------------------


def _prevalence(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    pairs, items, scored = _material(spark, sf_dir, view)
    made = _made(pairs, items)
    cells = training.grid(spark, q=list(pools.Q_GRID), mode=["ordinary", "balanced"], seed=SEEDS[:2], hidden=[0], strength=[0.5])
    return _gains(training.train_grid(made, cells, OUT, STEPS, SHARE), made, scored)


def _prevalence_evidence(gains: DataFrame) -> DataFrame:
    """One row: the slope contrast at inner q with its interval, the mean gain contrast's interval, and whether every seed's slope contrast is positive."""
    inner = gains.where("q > 0 AND q < 1")
    rows = settled(inner.groupBy("mode", "q", "subject").agg(F.avg("gain").alias("gain")))
    contrast = pools.slope_contrast(rows).select(F.col("contrast").alias("slope_contrast"))
    slope = resample.interval(resample.slope_bootstrap(rows, REPLICATES, SEED), "contrast").select(F.col("lower").alias("slope_lower"), F.col("upper").alias("slope_upper"))
    arms = rows.groupBy("subject").agg(*(F.avg(F.when(F.col("mode") == m, F.col("gain"))).alias(m) for m in ("ordinary", "balanced")))
    mean = resample.interval(resample.subject_mean(arms.withColumn("delta", F.col("balanced") - F.col("ordinary")), "delta", REPLICATES, SEED), "estimate").select(F.col("lower").alias("mean_lower"), F.col("upper").alias("mean_upper"))
    means = inner.groupBy("seed", "mode", "q").agg(F.avg("gain").alias("g")).groupBy("seed", "mode").agg(F.regr_slope("g", "q").alias("s"))
    by_seed = means.groupBy("seed").agg((F.max(F.when(F.col("mode") == "ordinary", F.col("s"))) - F.max(F.when(F.col("mode") == "balanced", F.col("s")))).alias("d"))
    return contrast.crossJoin(slope).crossJoin(mean).crossJoin(by_seed.agg(F.bool_and(F.col("d") > 0).alias("seeds_positive"), F.count("*").alias("seeds")))


@query()
def prevalence_mechanism(spark, sf_dir):
    """Heads trained on nested masks of target prevalence, ordinary and balanced losses, several seeds: slopes of the gain on prevalence and their intervals."""
    return rounded(_prevalence_evidence(_prevalence(spark, sf_dir, "vec")))


def _both_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [_prevalence_evidence(_prevalence(spark, sf_dir, view)).withColumn("condition", F.lit(name)) for name, view in (("primary", "vec"), ("second_view", "proxy"))]
    return gates.prevalence(rows[0].unionByName(rows[1]))


@query()
def prevalence_transfer_trained(spark, sf_dir):
    """The prevalence checks on either view of the items, and whether the balancing transfers."""
    checked = settled(_both_views(spark, sf_dir))
    return checked.crossJoin(gates.transfer(checked).select("transfer_supported"))


# --- pool ratio ----------------------------------------------------------------------------------------------------


@query()
def pool_ratio_trained(spark, sf_dir):
    """Exposure of cross examples by strength: the strength of the least check loss at each exposure, the interaction of strength and log exposure when subjects are drawn, losses mixed at the chosen
    strengths, a plain penalty as placebo, the pair loss's share of the gradient, and which explanation holds."""
    pairs, items, scored = _material(spark, sf_dir)
    made = _made(pairs, items)
    fit = lambda cells: settled(training.train_grid(made, cells, OUT, STEPS, SHARE))
    apart = fit(training.grid(spark, exposure=[0.5, 1.0, 2.0], strength=[0.0, 0.25, 0.5, 1.0], seed=SEEDS[:2], hidden=[0], q=[0.5]))
    by = apart.groupBy("exposure", "strength").agg(F.median("loss").alias("loss"))
    star = settled(by.groupBy("exposure").agg(F.min_by("strength", F.struct("loss", "strength")).alias("star")))
    gains = _gains(apart, made, scored)
    chosen = gains.join(star, "exposure").where("strength = star")
    mixed_cells = star.withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS[:2])))).withColumn("cell", (F.row_number().over(Window.orderBy("exposure", "seed"))).cast("int"))
    mixed = _gains(fit(mixed_cells.select("cell", "exposure", F.col("star").alias("strength"), F.col("seed").cast("long").alias("seed"), F.lit("mixed").alias("together"), F.lit(0.5).alias("q"))), made, scored)
    placebo = fit(training.grid(spark, penalty=[0.0, 1e-4, 1e-3, 1e-2], seed=SEEDS[:2], hidden=[0]))
    least = placebo.groupBy("penalty").agg(F.median("loss").alias("loss")).agg(F.min_by("penalty", F.struct("loss", "penalty")).alias("least"))
    plain = _gains(placebo.crossJoin(F.broadcast(least)).where("penalty = least").drop("least"), made, scored)
    value = lambda g: g.groupBy("subject").agg(F.avg("gain").alias("value"))
    against = resample.interval(resample.paired_mean(value(plain), value(chosen.where("exposure = 1.0")), REPLICATES, SEED), "estimate").select(F.col("lower").alias("placebo_lower"), F.col("upper").alias("placebo_upper"))
    rows = gains.select("subject", F.col("exposure").alias("ratio"), "strength", "gain")
    product = resample.interval(resample.interaction_bootstrap(rows, REPLICATES, SEED), "product").select(F.col("lower").alias("interaction_lower"), F.col("upper").alias("interaction_upper"))
    # The cross loss's share of the two gradients, in the chosen cells.
    log = apart.join(star, "exposure").where("strength = star").select(F.explode("log").alias("l")).where("l.layer = 'all' AND l.pair + l.cross > 0").select((F.col("l.cross") / (F.col("l.pair") + F.col("l.cross"))).alias("eta"))
    budget = log.agg(F.median("eta").alias("eta"), (F.stddev_pop("eta") / F.greatest(F.abs(F.avg("eta")), F.lit(1e-12))).alias("eta_cv"))
    told = star.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("exposure", "star"))), lambda x: x["star"].cast("string")), ",").alias("chosen"), F.count_distinct("star").alias("strengths"))
    evidence = told.crossJoin(budget).crossJoin(product).crossJoin(against).crossJoin(_whole(chosen).select(F.col("gain").alias("apart"))).crossJoin(_whole(mixed).select(F.col("gain").alias("mixed")))
    away = ~((F.col("interaction_lower") <= 0) & (F.col("interaction_upper") >= 0))
    evidence = settled(evidence.withColumn("gradient_budget", (F.col("strengths") > 1) & (F.col("eta_cv") <= 0.2) & away).withColumn("regularisation", (F.col("placebo_lower") <= 0) & (F.col("placebo_upper") >= 0)))
    return rounded(evidence.crossJoin(gates.mechanism(evidence, ["gradient_budget", "regularisation"])))


# --- gradient isolation ----------------------------------------------------------------------------------------------


def _matched(pairs: DataFrame) -> DataFrame:
    """Cross examples with their ``pools``: own (one subject), and independent, as many pairs of two subjects of every target, by a random order."""
    cross = pairs.where("kind = 'cross'")
    sizes = cross.where("grp = 'C'").groupBy(F.col("target").alias("of")).agg(F.count("*").alias("most"))
    ranked = scan(cross.where("grp = 'D'").select("item_l", "item_r", "target"), ["target"], [F.xxhash64(F.lit(SEED), "item_l", "item_r")], {"place": Run("count")})
    kept = ranked.join(sizes, F.col("target") == F.col("of")).where("place <= most").select("item_l", "item_r", F.lit(True).alias("kept"))
    names = F.array_compact(F.array(F.when(F.col("grp") == "C", "own"), F.when(F.col("kept"), "independent")))
    return pairs.join(kept, ["item_l", "item_r"], "left").withColumn("pools", F.when(F.col("kind") == "cross", names)).drop("kept")


@query()
def gradient_isolation_trained(spark, sf_dir):
    """Dose response of the cross loss, the same loss on target-matched pairs of other subjects as control, and how the two gradients conflict by layer; one row a strength and pool, with the gate's checks."""
    pairs, items, scored = _material(spark, sf_dir)
    made = _made(_matched(pairs), items, masks=False)
    cells = training.grid(spark, pool=["own", "independent"], strength=[0.0, 0.25, 0.5, 1.0, 2.0], seed=SEEDS[:2], hidden=[8])
    trained = settled(training.train_grid(made, cells, OUT, STEPS, SHARE))
    gains = _gains(trained, made, scored)
    seen = _whole(gains, "pool", "strength", "seed").groupBy("pool", "strength").agg(F.median("gain").alias("gain"))
    log = trained.select("pool", "strength", F.explode("log").alias("l")).select("pool", "strength", "l.*")
    probes = log.groupBy("pool", "strength").agg(*(F.avg(F.when(F.col("layer") == x, F.col("cosine"))).alias(f"cosine_{x}") for x in ("all", "w1", "w2")), F.avg(F.when(F.col("layer") == "all", F.col("cross") / (F.col("pair") + F.col("cross")))).alias("cross_share"))
    rows = settled(seen.join(probes, ["pool", "strength"]))
    dose = rows.where("pool = 'own'").agg((F.corr("strength", "gain") > 0).alias("dose_response"))
    best = lambda pool: F.max(F.when((F.col("pool") == pool) & (F.col("strength") > 0), F.col("gain")))
    control = rows.agg((best("own") > best("independent")).alias("independent_control"), (F.min(F.when((F.col("pool") == "own") & (F.col("strength") > 0), F.col("cosine_all"))) < 0).alias("gradient_probe"))
    checks = gates.gate(dose.crossJoin(control), {n: F.col(n) for n in ("dose_response", "independent_control", "gradient_probe")})
    return rounded(rows).crossJoin(checks)


# --- diversity -------------------------------------------------------------------------------------------------------


@query()
def diversity_gate_trained(spark, sf_dir):
    """Cross losses on pools of one size, of one subject's pairs and of two subjects' pairs: sizes, relations, the gain's contrast when subjects are drawn, and seeds in its direction."""
    pairs, items, scored = _material(spark, sf_dir)
    marked = settled(_matched(pairs))
    made = _made(marked, items, masks=False)
    gains = _gains(training.train_grid(made, training.grid(spark, pool=["own", "independent"], seed=SEEDS, hidden=[0], strength=[0.5]), OUT, STEPS, SHARE), made, scored)
    value = lambda p: gains.where(F.col("pool") == p).groupBy("subject").agg(F.avg("gain").alias("value"))
    lower = resample.interval(resample.paired_mean(value("own"), value("independent"), REPLICATES, SEED), "estimate").select("lower")
    by_seed = _whole(gains, "pool", "seed").groupBy("seed").agg((F.max(F.when(F.col("pool") == "independent", F.col("gain"))) - F.max(F.when(F.col("pool") == "own", F.col("gain")))).alias("d"))
    same = by_seed.agg(F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("same"))
    relations = F.count_distinct(F.least("category_l", "category_r"), F.greatest("category_l", "category_r"))
    sizes = marked.where("kind = 'cross'").withColumn("condition", F.explode("pools")).groupBy("condition").agg(F.count("*").alias("pairs"), relations.alias("relations"))
    return gates.diversity(sizes.crossJoin(lower).crossJoin(same), "own", "independent", F.max("lower"), F.max("same"))


# --- heads by references ---------------------------------------------------------------------------------------------

REFERENCES = ("binary", "gap")
PARTNERS = "|partner"


def _factorial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reference, hidden, strength, seed, control, subject, n, error, base_error, gain): two references, two heads, with and without the cross loss, five seeds; the controls are cross
    examples with the targets of others, and with a partner of another subject."""
    pairs, items, scored = _material(spark, sf_dir, also={"target_binary": F.col("target")})
    pairs = pairs.withColumnRenamed("target", "target_binary").withColumn("pair_id", F.monotonically_increasing_id())
    pairs = settled(pairs)
    cross = pairs.where("kind = 'cross'")
    # The same targets, each at another example.
    dealt = {r: pools.rotated(cross.select("pair_id", f"target_{r}"), "pair_id", f"target_{r}", SEED).select("pair_id", F.col("shuffled").alias(f"target_{r}_permuted")) for r in REFERENCES}
    partner = pools.shuffled_partners(cross.select("pair_id", "subject_l", "category_r"), items, SEED)
    other = cross.join(partner.where("partner IS NOT NULL"), "pair_id").withColumn("item_r", F.col("partner")).withColumn("pools", F.array(F.lit("partner"))).drop("partner")
    # Blocks of their own: most of their items are in one pair of a place.
    other = other.withColumn("place", F.concat("place", F.lit(PARTNERS)))
    own = pairs.withColumn("pools", F.when(F.col("kind") == "cross", F.array(F.lit("own"))))
    named = own.unionByName(other)
    for r in REFERENCES:
        named = named.join(dealt[r], "pair_id", "left").withColumn(f"target_{r}_permuted", F.coalesce(f"target_{r}_permuted", f"target_{r}"))
    made = _made(named.withColumn("target", F.col("target_binary")).drop("pair_id"), items, masks=False)
    grid = training.grid(spark, reference=list(REFERENCES), hidden=[0, 8], strength=[0.0, 0.5], seed=SEEDS).withColumn("pool", F.lit("own")).withColumn("control", F.lit("none"))
    controls = training.grid(spark, reference=list(REFERENCES), hidden=[8], strength=[0.5], seed=SEEDS[:2], control=["permuted", "shuffled"])
    controls = controls.withColumn("cell", F.col("cell") + 10_000).withColumn("pool", F.when(F.col("control") == "shuffled", "partner").otherwise("own"))
    cells = grid.unionByName(controls).withColumn("scored_as", F.col("reference")).withColumn("reference", F.when(F.col("control") == "permuted", F.concat("reference", F.lit("_permuted"))).otherwise(F.col("reference")))
    trained = settled(training.train_grid(made, cells, OUT, STEPS, SHARE))
    # Controls are scored against the reference itself.
    judged = trained.withColumn("reference", F.col("scored_as")).drop("scored_as")
    return _gains(judged, made.where(~F.col("place").endswith(PARTNERS)), scored)


@query()
def architecture_factorial(spark, sf_dir):
    """By reference: what the cross loss adds with the deep head less what it adds with the linear one, per subject over seeds, when subjects are drawn; Holm over the references."""
    gains = _factorial(spark, sf_dir).where("control = 'none'")
    of = lambda h, s: F.avg(F.when((F.col("hidden") == h) & (F.col("strength") == s), F.col("gain")))
    rows = settled(gains.groupBy("reference", "subject").agg(((of(8, 0.5) - of(8, 0.0)) - (of(0, 0.5) - of(0, 0.0))).alias("d")))
    out = None
    for name in REFERENCES:
        mine = rows.where(F.col("reference") == name)
        drawn = settled(resample.subject_mean(mine, "d", REPLICATES, SEED))
        one = resample.interval(drawn, "estimate").select("lower", "upper").crossJoin(resample.tail_p(drawn, "estimate")).crossJoin(mine.agg(F.avg("d").alias("interaction"))).withColumn("reference", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(holm(out, [], "p", "reference").select("reference", "interaction", "lower", "upper", "p", "adjusted"))


def _trained_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    gains = _factorial(spark, sf_dir)
    by = settled(_whole(gains, "reference", "control", "hidden", "strength", "seed"))
    of = lambda c, h, s: F.median(F.when((F.col("control") == c) & (F.col("hidden") == h) & (F.col("strength") == s), F.col("gain")))
    best = (F.col("control") == "none") & (F.col("hidden") == 8) & (F.col("strength") == 0.5)
    got = by.groupBy("reference").agg(
        of("none", 8, 0.5).alias("gain"), F.min(F.when(best, F.col("gain"))).alias("least"), of("shuffled", 8, 0.5).alias("shuffled"), of("permuted", 8, 0.5).alias("permuted"),
        of("none", 0, 0.0).alias("linear_alone"), of("none", 0, 0.5).alias("linear_cross"), of("none", 8, 0.0).alias("alone"),
    )
    lowers = None
    for name in REFERENCES:
        mine = gains.where(best & (F.col("reference") == name)).groupBy("subject").agg(F.avg("gain").alias("d"))
        one = resample.interval(resample.subject_mean(mine, "d", REPLICATES, SEED), "estimate").select("lower", F.lit(name).alias("reference"))
        lowers = one if lowers is None else lowers.unionByName(one)
    whole = got.join(lowers, "reference").withColumn("seeds_passed", F.col("least") > 0).withColumn("increment", F.col("gain") > F.col("alone")).withColumn("linear_increment", F.col("linear_cross") > F.col("linear_alone"))
    return gates.boundary(whole, ["gain", "linear_alone", "linear_cross"], ["shuffled", "permuted"])


@query()
def reference_report_trained(spark, sf_dir):
    """By reference: the gain of trained heads over seeds, its bound, controls that were trained too, and the strongest head."""
    got = _trained_results(spark, sf_dir)
    return rounded(got.select("reference", "gain", "lower", "seeds_passed", "shuffled", "permuted", "linear_alone", "linear_cross", "specific", "strongest", "robust"))


@query()
def reference_gate_trained(spark, sf_dir):
    """The gate over that report."""
    return gates.references(_trained_results(spark, sf_dir))


# --- sweeps over all examples ------------------------------------------------------------------------------------------


@query()
def seed_sweep(spark, sf_dir):
    """Heads trained with and without the loss of cross pairs, over seeds and two architectures, on all calibration pairs: the check loss of each and what the cross loss adds."""
    pairs, items, _ = _material(spark, sf_dir)
    got = settled(training.train_grid(_made(pairs, items, masks=False), training.grid(spark, seed=SEEDS, hidden=[0, 16], strength=[0.0, 1.0]), OUT, STEPS, SHARE))
    of = lambda x: F.max(F.when(F.col("strength") == x, F.col("loss")))
    return rounded(got.groupBy("seed", "hidden").agg(of(0.0).alias("alone"), of(1.0).alias("crossed")).withColumn("added", F.col("alone") - F.col("crossed")))


@query()
def linear_head(spark, sf_dir):
    """A linear head trained on all calibration pairs, scored on evaluation pairs under its fit."""
    pairs, items, scored = _material(spark, sf_dir)
    made = _made(pairs, items)
    gains = _gains(training.train_grid(made, training.grid(spark, seed=[1], hidden=[0], strength=[0.5]), OUT, 2 * STEPS, SHARE), made, scored)
    return rounded(gains.agg(F.count("*").alias("subjects"), (F.sum(F.col("n") * F.col("error")) / F.sum("n")).alias("mae"), (F.sum(F.col("n") * F.col("base_error")) / F.sum("n")).alias("base_mae")))


@query()
def grid_search(spark, sf_dir):
    """Strength, layers, penalty and how losses are put together, each candidate over four folds of subjects, with the best of them trained on all."""
    pairs, items, _ = _material(spark, sf_dir)
    made = _made(training.dealt(pairs, 4, SEED), items, masks=False)
    candidates = training.grid(spark, strength=[0.0, 0.5, 1.0], hidden=[0, 8], penalty=[0.0, 0.001], together=["separate", "mixed"]).withColumnRenamed("cell", "candidate")
    scores, best = training.grid_search(made, candidates, 4, OUT, STEPS, share=SHARE)
    chosen = best.select(F.col("cell").alias("candidate"), F.lit(True).alias("chosen"))
    return rounded(scores.join(chosen, "candidate", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False))))


@query()
def diagonal_metric(spark, sf_dir):
    """One scale a dimension fitted to the targets of the calibration pairs: the loss before and after, and the spread of the scales."""
    pairs, items, _ = _material(spark, sf_dir)
    scales, losses = training.diagonal_metric(_made(pairs, items, masks=False), steps=20, rate=5.0)
    return rounded(spark.createDataFrame([(len(scales), losses[0], losses[-1], float(scales.min()), float(scales.max()))], "dimensions long, first_loss double, last_loss double, least double, most double"))


# --- references by their construction ------------------------------------------------------------------------------------


def _variant_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant, seed, weighting, gain): linear heads trained on three constructions of the reference, five seeds each, scored under the four weightings."""
    names = {"": "target", "gap": "target_gap", "square": "target_square"}
    square = F.col("target_gap") * F.col("target_gap")
    relation = F.concat_ws("::", F.least("category_l", "category_r"), F.greatest("category_l", "category_r"))
    pairs, items, rows = _material(spark, sf_dir, also={"target_square": square, "category_relation": relation, "stratum": F.col("grp")})
    made = _made(pairs.withColumn("target_square", square), items, masks=False)
    trained = settled(training.train_grid(made, training.grid(spark, reference=list(names), seed=SEEDS, hidden=[0], strength=[0.5]), OUT, STEPS, SHARE))
    out = None
    for by in ("subject", "category_relation", "stratum"):
        g = settled(training.subject_gains(trained, made, rows, OUT, by).join(trained.select("cell", "reference", "seed"), "cell"))
        weighting = "endpoint_subject" if by == "subject" else by
        mean = g.groupBy("reference", "seed").agg(F.avg("error").alias("e"), F.avg("base_error").alias("b")).withColumn("weighting", F.lit(weighting))
        if by == "stratum":
            whole = g.groupBy("reference", "seed").agg((F.sum(F.col("n") * F.col("error")) / F.sum("n")).alias("e"), (F.sum(F.col("n") * F.col("base_error")) / F.sum("n")).alias("b")).withColumn("weighting", F.lit("pair"))
            mean = mean.unionByName(whole)
        out = mean if out is None else out.unionByName(mean)
    named = F.when(F.col("reference") == "", "binary").otherwise(F.col("reference"))
    return out.select(named.alias("variant"), "seed", "weighting", F.when(F.col("b") <= 0, 0.0).otherwise((F.col("b") - F.col("e")) / F.col("b")).alias("gain"))


@query()
def variant_gate_trained(spark, sf_dir):
    """By construction of the reference: medians over trained seeds under every weighting and its checks, with the status over all."""
    gains = settled(_variant_gains(spark, sf_dir))
    checked = settled(gates.variants(gains))
    medians = gains.groupBy("variant").pivot("weighting", ["pair", "endpoint_subject", "category_relation", "stratum"]).agg(F.median("gain"))
    return rounded(medians.join(checked, "variant").crossJoin(gates.stability(checked).select("status")))
