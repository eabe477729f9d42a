"""Post-hoc corrections of distances and vectors.

Fits are made from sums that tasks add up; only dense problems of the vectors' width reach the driver. Applying is a join and an expression over all items. Fits of cells on
a second view are in ``regression``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.scalars import corrected, improvement
from pairlens.functions.vectors import cosine_from, dot, l2_normalised, mean_vectors, norm
from pairlens.operators.scoring import affine
from pairlens.plans.storage import settled
from pairlens.sources.items import DIM

# The strengths and thresholds that are compared.
STRENGTHS = (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9, 1.0)
ALPHAS = (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9, 1.0)
COMPONENTS = (0, 1, 2, 5, 10, 20, 50, 100)
THRESHOLDS = (0.03, 0.05, 0.10)


def grid(frame: DataFrame, name: str, values: tuple) -> DataFrame:
    return frame.withColumn(name, F.explode(F.array(*map(F.lit, values))))


# Scalar subtraction.


def strength_errors(pairs: DataFrame, strengths: tuple = STRENGTHS) -> DataFrame:
    """(strength, slope, intercept, mae): per strength the corrected distance, its clamped fit to the target and the error; pairs(distance, other, target)."""
    each = grid(pairs, "strength", strengths).withColumn("x", corrected(F.col("distance"), F.col("strength"), F.col("other")))
    fit = affine(each, "x", "target", ["strength"], clamped=True)
    return each.join(F.broadcast(fit), "strength").groupBy("strength", "slope", "intercept").agg(F.avg(F.abs(F.col("slope") * F.col("x") + F.col("intercept") - F.col("target"))).alias("mae"))


def chosen(errors: DataFrame, param: str = "strength") -> DataFrame:
    """One row: the least (error, parameter); errors that differ by rounding alone are equal."""
    return errors.agg(F.min_by(F.struct(*errors.columns), F.struct(F.round("mae", 12), param)).alias("b")).select("b.*")


def frozen_report(pairs: DataFrame, best: DataFrame) -> DataFrame:
    """(n, base_mae, mae, gain) of evaluation pairs under the frozen strength and fits; best has base_slope, base_intercept too."""
    x = pairs.crossJoin(F.broadcast(best)).withColumn("x", corrected(F.col("distance"), F.col("strength"), F.col("other")))
    e = lambda s, c, v: F.avg(F.abs(F.col(s) * F.col(v) + F.col(c) - F.col("target")))
    got = x.agg(F.count("*").alias("n"), e("base_slope", "base_intercept", "distance").alias("base_mae"), e("slope", "intercept", "x").alias("mae"))
    return got.withColumn("gain", improvement(F.col("base_mae"), F.col("mae")))


def thresholds(gains: DataFrame, values: tuple = THRESHOLDS) -> DataFrame:
    """gains(..., gain, lower) at each threshold: passed if the gain reaches it and the lower bound is positive."""
    return grid(gains, "threshold", values).withColumn("passed", (F.col("gain") >= F.col("threshold")) & (F.col("lower") > 0))


# Subject means.


def subject_normalised(items: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``vec`` - alpha (subject mean - global mean), with its norm."""
    one = items.withColumn("__g", F.lit(1))
    subj = mean_vectors(items, ["subject"]).select("subject", F.col("mean").alias("__s"))
    glob = mean_vectors(one, ["__g"]).select("__g", F.col("mean").alias("__m"))
    shift = F.zip_with("__s", "__m", lambda s, m: s - m)
    out = one.join(subj, "subject").join(F.broadcast(glob), "__g").withColumn("vec", F.zip_with("vec", shift, lambda x, d: x - alpha * d))
    return out.drop("__g", "__s", "__m").withColumn("norm", norm("vec", DIM))


def wrong_mean(items: DataFrame, seed: int) -> DataFrame:
    """The ablation: each subject takes another's mean, by a random circle."""
    from pairlens.operators.pools import rotated

    subj = mean_vectors(items, ["subject"]).select("subject", F.col("mean").alias("__s"))
    other = rotated(subj, "subject", "__s", seed).select("subject", F.col("shuffled").alias("__w"))
    glob = F.broadcast(mean_vectors(items.withColumn("__g", F.lit(1)), ["__g"]).select(F.col("mean").alias("__m")))
    out = items.join(other, "subject").crossJoin(glob).withColumn("vec", F.zip_with(F.zip_with("vec", "__w", lambda x, s: x - s), "__m", lambda x, m: x + m))
    return out.drop("__w", "__m").withColumn("norm", norm("vec", DIM))


def leave_pair_out(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """pairs with ``distance`` after taking from each end its subject's mean without the pair's own items (sum less
    the ends, no second aggregation) and ``fallbacks``, the ends whose subject has no other item and keep the full mean."""
    sums = mean_vectors(items, ["subject"]).select("subject", "n", "sums", "mean")
    side = lambda s: items.select(F.col("item").alias(f"item_{s}"), F.col("vec").alias(f"v{s}"), F.col("subject").alias(f"s{s}")).join(sums.select(F.col("subject").alias(f"s{s}"), F.col("n").alias(f"c{s}"), F.col("sums").alias(f"t{s}"), F.col("mean").alias(f"m{s}")), f"s{s}")
    j = pairs.join(side("l"), "item_l").join(side("r"), "item_r")
    same = F.col("sl") == F.col("sr")

    def residual(s: str, o: str) -> F.Column:
        left = F.col(f"c{s}") - F.when(same, 2).otherwise(1)
        without = F.zip_with(F.zip_with(f"t{s}", f"v{s}", lambda t, v: t - v), F.when(same, F.col(f"v{o}")).otherwise(F.transform(f"v{o}", lambda _: F.lit(0.0))), lambda t, v: t - v)
        mean = F.when(left > 0, F.transform(without, lambda t: t / left)).otherwise(F.col(f"m{s}"))
        return F.zip_with(f"v{s}", mean, lambda v, m: v - m)

    r = j.select(*pairs.columns, residual("l", "r").alias("rl"), residual("r", "l").alias("rr"), *((F.col(f"c{s}") - F.when(same, 2).otherwise(1) <= 0).cast("int").alias(f"f{s}") for s in "lr"))
    return r.select(*pairs.columns, cosine_from(dot("rl", "rr", DIM), norm("rl", DIM), norm("rr", DIM), "distinct").alias("distance"), (F.col("fl") + F.col("fr")).cast("long").alias("fallbacks"))


def alpha_sweep(pairs: DataFrame, items: DataFrame, alphas: tuple = ALPHAS) -> DataFrame:
    """(alpha, group, n, mean): mean distance of each group at each alpha. The distance is a ratio of quadratics in alpha, so a
    pair needs the inner products of vectors and offsets once, and no vector per alpha."""
    one = items.withColumn("__g", F.lit(1))
    subj = mean_vectors(items, ["subject"]).select("subject", F.col("mean").alias("__s"))
    glob = mean_vectors(one, ["__g"]).select("__g", F.col("mean").alias("__m"))
    off = one.join(subj, "subject").join(F.broadcast(glob), "__g").select("item", "vec", F.zip_with("__s", "__m", lambda s, m: s - m).alias("off"))
    side = lambda s: off.select(F.col("item").alias(f"item_{s}"), F.col("vec").alias(f"v{s}"), F.col("off").alias(f"o{s}"))
    d = lambda a, b: dot(a, b, DIM)
    j = pairs.join(side("l"), "item_l").join(side("r"), "item_r").select("group", d("vl", "vr").alias("vv"), (d("vl", "or") + d("ol", "vr")).alias("vo"), d("ol", "or").alias("oo"), *(d(f"{x}{s}", f"{y}{s}").alias(f"{x}{y}{s}") for s in "lr" for x, y in ("vv", "vo", "oo")))
    g = grid(j, "alpha", alphas)
    a = F.col("alpha")
    n = lambda s: F.sqrt(F.greatest(F.lit(0.0), F.col(f"vv{s}") - 2 * a * F.col(f"vo{s}") + a * a * F.col(f"oo{s}")))
    dist = cosine_from(F.col("vv") - a * F.col("vo") + a * a * F.col("oo"), n("l"), n("r"), "distinct")
    return g.withColumn("d", dist).groupBy("alpha", "group").agg(F.count("*").alias("n"), F.avg("d").alias("mean"))


def alpha_tradeoff(sweep: DataFrame) -> DataFrame:
    """(alpha, harm, gain, efficient): relative change of the same-category group A and of the cross-category group C from alpha 0."""
    from pairlens.functions.ordering import pareto

    wide = sweep.groupBy("alpha").agg(*(F.max(F.when(F.col("group") == g, F.col("mean"))).alias(g.lower()) for g in "AC"))
    zero = wide.where("alpha = 0").select(F.col("a").alias("a0"), F.col("c").alias("c0"))
    r = wide.crossJoin(F.broadcast(zero)).select("alpha", F.round(F.abs(F.try_divide(F.col("a") - F.col("a0"), F.col("a0"))), 9).alias("harm"), F.round(F.try_divide(F.col("c0") - F.col("c"), F.col("c0")), 9).alias("gain"))
    return pareto(r, "harm", "gain")


def category_residuals(items: DataFrame) -> DataFrame:
    """(subject, category, n, ratio): of subjects with two categories or more, the norm of the cell mean less the subject mean over the norm of the cell mean."""
    cells = mean_vectors(items, ["subject", "category"]).select("subject", "category", "n", "mean")
    many = cells.groupBy("subject").agg(F.count("*").alias("k")).where("k >= 2").select("subject")
    subj = mean_vectors(items, ["subject"]).select("subject", F.col("mean").alias("s"))
    j = cells.join(many, "subject").join(subj, "subject").withColumn("d", F.zip_with("mean", "s", lambda a, b: a - b))
    return j.select("subject", "category", "n", F.try_divide(norm("d", DIM), norm("mean", DIM)).alias("ratio"))


def residual_cosines(items: DataFrame) -> DataFrame:
    """(category_l, category_r, n, mean): cosine similarity of a subject's residuals in two categories, by category pair; 0 for a zero vector."""
    cells = mean_vectors(items, ["subject", "category"]).select("subject", "category", "mean")
    subj = mean_vectors(items, ["subject"]).select("subject", F.col("mean").alias("s"))
    r = cells.join(subj, "subject").select("subject", "category", F.zip_with("mean", "s", lambda a, b: a - b).alias("d")).withColumn("n", norm("d", DIM))
    a = r.select("subject", F.col("category").alias("category_l"), F.col("d").alias("dl"), F.col("n").alias("nl"))
    b = r.select("subject", F.col("category").alias("category_r"), F.col("d").alias("dr"), F.col("n").alias("nr"))
    p = a.join(b, "subject").where("category_l < category_r").withColumn("c", 1 - cosine_from(dot("dl", "dr", DIM), F.col("nl"), F.col("nr"), "orthogonal"))
    return p.groupBy("category_l", "category_r").agg(F.count("*").alias("n"), F.avg("c").alias("mean"))


# Fits on sums.


def covariance(items: DataFrame, vec: str = "vec") -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance) of the vectors, from sums and products added up by partition: one row of dim squared per partition."""

    def part(batches):
        import pandas as pd

        n, s, p = 0, None, None
        for pdf in batches:
            x = np.stack(pdf[vec].to_numpy()) if len(pdf) else np.empty((0, 0))
            if not len(x):
                continue
            n, s, p = n + len(x), x.sum(0) if s is None else s + x.sum(0), x.T @ x if p is None else p + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "p": [p.ravel().tolist()]})

    shape = "n long, s array<double>, p array<double>"
    rows = added(items.select(vec).mapInPandas(part, shape), ["s", "p"])
    total, s, p = sum(r["n"] for r in rows), np.sum([r["s"] for r in rows], axis=0), np.sum([r["p"] for r in rows], axis=0)
    mean = s / total
    return total, mean, p.reshape(len(s), -1) / total - np.outer(mean, mean)


def added(parts: DataFrame, arrays: list[str], buckets: int = 16) -> list:
    """Rows (n, arrays) of tasks added up to at most so many rows, read once: what reaches the driver does not grow with the tasks."""

    def total(pdf):
        import pandas as pd

        return pd.DataFrame({"n": [pdf["n"].sum()], **{a: [np.sum(np.stack(pdf[a].to_numpy()), axis=0)] for a in arrays}})[[c for c in pdf.columns if c != "bucket"]]

    shape = ", ".join(f"{n} {t}" for n, t in parts.dtypes)
    return parts.withColumn("bucket", F.spark_partition_id() % buckets).groupBy("bucket").applyInPandas(lambda p: total(p), shape).collect()


def principal_directions(items: DataFrame, k: int, rounds: int = 60, tol: float = 1e-9, more: int = 8, seed: int = 20260829) -> tuple[np.ndarray, np.ndarray]:
    """(mean, the k strongest principal directions as rows): block power iteration on k + ``more`` directions. Each round is one pass, in which every task multiplies its vectors with the block
    and back; no product of dim squared is made. Ends when none of the k variances along them grows by more than ``tol`` of the largest."""
    spark = items.sparkSession
    dim = len(items.select("vec").first()[0])
    wide = min(k + more, dim)
    basis, mean, last, k = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, wide)))[0], np.zeros(dim), np.zeros(min(k, dim)), min(k, dim)
    found = basis[:, :k]
    kept = items.select("vec").persist()
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(basis)

        def part(batches, sent=sent):
            import pandas as pd

            n, s, p = 0, np.zeros(dim), np.zeros((dim, wide))
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["vec"].to_numpy())
                    n, s, p = n + len(x), s + x.sum(0), p + x.T @ (x @ sent.value)
            if n:
                yield pd.DataFrame({"n": [n], "s": [s], "p": [p.ravel()]})

        rows = added(kept.mapInPandas(part, "n long, s array<double>, p array<double>"), ["s", "p"])
        n, s, p = sum(r["n"] for r in rows), np.sum([r["s"] for r in rows], axis=0), np.sum([r["p"] for r in rows], axis=0).reshape(dim, wide)
        sent.unpersist()
        mean = s / n
        moved = p / n - np.outer(mean, mean @ basis)
        # Inside the block's span the directions follow from a problem of its width.
        values, turn = np.linalg.eigh(basis.T @ moved)
        found, now = (basis @ turn[:, ::-1])[:, :k], values[::-1][:k]
        if (now - last).max() <= tol * max(now[0], 1e-300):
            break
        basis, last = np.linalg.qr(moved)[0], now
    kept.unpersist()
    return mean, found.T


def two_way_effects(cells: DataFrame, a: str, b: str, tol: float = 1e-10, sweeps: int = 4, rounds: int = 200) -> DataFrame:
    """(a, b, k, effect): the least-squares fit of a term a level of ``a`` plus one a level of ``b``, of cells(a, b, k, n, s) with counts and sums. By alternating projections:
    each level's term is the mean of what the other terms leave, over the cells and never over rows, until no term moves by more than ``tol``."""
    fit = cells.withColumn("ea", F.lit(0.0)).withColumn("eb", F.lit(0.0))
    for _ in range(rounds):
        for _ in range(sweeps):
            before = fit.withColumn("ob", F.col("eb"))
            ta = before.groupBy(a, "k").agg((F.sum(F.col("s") - F.col("n") * F.col("eb")) / F.sum("n")).alias("ea"))
            fit = before.drop("ea").join(ta, [a, "k"])
            tb = fit.groupBy(b, "k").agg((F.sum(F.col("s") - F.col("n") * F.col("ea")) / F.sum("n")).alias("eb"))
            fit = fit.drop("eb").join(tb, [b, "k"])
        fit = settled(fit)
        if (fit.agg(F.max(F.abs(F.col("eb") - F.col("ob")))).first()[0] or 0.0) <= tol:
            return fit.select(a, b, "k", (F.col("ea") + F.col("eb")).alias("effect"))
        fit = fit.drop("ob")
    raise RuntimeError("the terms did not settle")


def components(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(mean, principal directions as rows, the strongest first)."""
    _, mean, cov = covariance(items)
    values, vectors = np.linalg.eigh(cov)
    return mean, vectors[:, np.argsort(-values)].T


def without(items: DataFrame, mean: np.ndarray, directions: np.ndarray) -> DataFrame:
    """Vectors with the given directions (orthonormal rows) taken out about the mean."""

    def part(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["vec"].to_numpy()) - mean
                pdf["vec"] = list(x - (x @ directions.T) @ directions + mean)
            yield pdf

    return items.drop("norm").mapInPandas(part, items.drop("norm").schema).withColumn("norm", norm("vec", DIM))


def subject_f(items: DataFrame, mean: np.ndarray, directions: np.ndarray, within: tuple[str, str] | None = ("category", "condition")) -> list[float]:
    """F statistic of subject on each component's scores, less what category and condition explain, from grouped sums."""

    def project(batches):
        for pdf in batches:
            if len(pdf):
                z = (np.stack(pdf["vec"].to_numpy()) - mean) @ directions.T
                yield pdf[columns].assign(z=list(z))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema if f.name in ("subject", "category", "condition"))
    columns = [c for c in items.columns if c in ("subject", "category", "condition")]
    scores = items.select(*columns, "vec").mapInPandas(project, f"{shape}, z array<double>")
    t = f_sums(scores, within)
    return [f_of(r) for r in t.orderBy("k").collect()]


def f_of(r) -> float:
    """F of the sums of ``f_sums``; 0 where there is one subject or nothing inside subjects varies from nothing."""
    if r["g"] < 2:
        return 0.0
    between, inside = (r["b"] - r["s"] ** 2 / r["n"]) / (r["g"] - 1), (r["q"] - r["b"]) / max(r["n"] - r["g"], 1)
    return between / inside if inside > 0 else 0.0


def f_sums(scores: DataFrame, within: tuple[str, str] | None = None) -> DataFrame:
    """(k, n, s, q, b, g) of scores(subject, z, ...): sums for the F statistic of subject; with ``within`` of what the two labels' terms leave."""
    long = scores.select("subject", *(within or ()), F.posexplode("z").alias("k", "z"))
    if within:
        cells = settled(long.groupBy(*within, "k").agg(F.count("*").alias("n"), F.sum("z").alias("s")))
        long = long.join(two_way_effects(cells, *within), [*within, "k"]).withColumn("z", F.col("z") - F.col("effect"))
    per = long.groupBy("k", "subject").agg(F.count("*").alias("n"), F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q"))
    return per.groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.count("*").alias("g"))


def subject_components(items: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, the k directions that part subjects most, by (-F, index))."""
    mean, dirs = components(items)
    f = subject_f(items, mean, dirs)
    return mean, dirs[sorted(range(len(dirs)), key=lambda i: (-f[i], i))[:k]]


def identity_head(items: DataFrame, k: int) -> np.ndarray:
    """Standardiser and the top k right singular vectors of the standardised vectors, as one matrix (dim x k)."""
    _, mean, cov = covariance(items)
    sd = np.sqrt(np.diag(cov))
    sd = np.where(sd == 0, 1e-6, sd)
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    return (vectors[:, np.argsort(-values)[:k]].T / sd).T


def canonical_correlations(rows: DataFrame, first: str, second: str, eps: float = 1e-9) -> np.ndarray:
    """Correlations between two views of the same rows, columns of vectors, from the covariance of both together: no row reaches the driver."""
    wide = len(rows.select(first).first()[0])
    _, _, cov = covariance(rows.select(F.concat(first, second).alias("both")), "both")

    def whitener(c: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(c)
        kept = values > eps * max(values.max(), 0)
        return vectors[:, kept] / np.sqrt(values[kept])

    x, y = whitener(cov[:wide, :wide]), whitener(cov[wide:, wide:])
    return np.clip(np.linalg.svd(x.T @ cov[:wide, wide:] @ y, compute_uv=False), 0, 1)


def probe_accuracy(items: DataFrame, label: str, test_fraction_mod: int = 5) -> float:
    """Accuracy of a linear classifier of ``label`` on vectors, on the items whose id the modulus divides."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    f = items.select((F.col("item") % test_fraction_mod == 0).alias("test"), F.col(label).cast("double").alias("label"), array_to_vector("vec").alias("features"))
    model = LogisticRegression(maxIter=50, regParam=0.01).fit(f.where(~F.col("test")))
    return float(model.transform(f.where("test")).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] or 0.0)


def pair_report(rows: DataFrame) -> DataFrame:
    """(model, reference, group, n, base_mae, mae, change): per-pair rows rolled up."""
    g = rows.groupBy("model", "reference", "group").agg(F.count("*").alias("n"), F.avg("base_error").alias("base_mae"), F.avg("error").alias("mae"))
    return g.withColumn("change", F.col("mae") - F.col("base_mae"))


def normalised_vectors(items: DataFrame) -> DataFrame:
    return items.withColumn("vec", l2_normalised(F.col("vec"), DIM)).withColumn("norm", F.lit(1.0))


def shuffled_other(pairs: DataFrame, unit: str, seed: int) -> DataFrame:
    """The control: ``other`` dealt to other pairs, none keeping its own."""
    from pairlens.operators.pools import rotated

    return rotated(pairs, unit, "other", seed).drop("other").withColumnRenamed("shuffled", "other")


def random_directions(dim: int, k: int, seed: int) -> np.ndarray:
    """k orthonormal directions drawn at random: the control of a removal."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, k)))[0].T


def joined_distances(pairs: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs (pair_id, distance, target) with ``other``, a second distance of the same pair; pairs without one are left out."""
    return pairs.join(other.select("pair_id", F.col("distance").alias("other")), "pair_id")


def mechanism_gate(report: DataFrame, least_gain: float = 0.05, largest_harm: float = 0.01) -> DataFrame:
    """report(gain, lower, harm, best_control): enough gain, a positive lower bound, little harm to matched pairs, and every control lower."""
    from pairlens.operators.gates import gate

    return gate(report, {"gain": F.col("gain") >= least_gain, "positive": F.col("lower") > 0, "harmless": F.abs("harm") <= largest_harm, "controls": F.col("best_control") < F.col("gain")})
