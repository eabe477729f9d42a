"""Quality classifier: Bradley-Terry ranking of texts from preference pairs.

A text of label 1 is preferred to one of label 0. The chance that a beats b is the logistic function of
s(a) - s(b), s linear in features of the text; the weights minimise the logistic loss on feature
differences of such pairs, with a small ridge. A quantile of the learned scores (the share of label 0
in the sample) is the threshold; the reported score is the logistic function of the distance to it,
shifted so that the threshold lies at CUT.

The fit takes at most SAMPLE labelled ids, those of the least hash (a documented bound: the
model has a dozen weights); everything else covers all rows. Features are native columns.

Defined cases: null and empty texts have zero features and a score; labels that are null or belong to
held-out or absent ids are not learned from; an id that is labelled more than once counts once, and not at all if its labels differ;
of documents that share an id the one of the least features is learned from and all are scored; ties of the hash go by id, and equal
scores at the threshold lie on its upper side; with one class only, or none, all scores are 0.5; repeated rows
repeat; a null id is scored and held out by the remainder of the empty text's crc; a long text is one row of a dozen numbers; empty
tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import measurements

SAMPLE, PAIRS, RIDGE, CUT, FOLDS = 20_000, 60_000, 1e-3, 0.3, 5


def held_out(id_col: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the features, each within about 0 to 1."""
    found = measurements(docs, id_col, text_col)
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    capped = lambda x: F.least(x, F.lit(1.0))
    return found.select(
        "doc_id",
        F.array(
            capped(F.col("n_symbols") / words),
            capped(F.col("n_exclaim") / words),
            capped(F.col("n_upper") / chars),
            capped(F.col("n_repeat_words") / words),
            capped(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
            capped(F.log10(words) / 5),
            capped(chars / words / 20),
            (F.col("n_symbols") * 20 > F.col("n_words")).cast("double"),
            (F.col("n_repeat_words") * 5 > F.col("n_words")).cast("double"),
            (F.col("n_exclaim") * 10 > F.col("n_words")).cast("double"),
            capped(F.col("n_stutter") / words),
            (F.col("n_stutter") * 5 > F.col("n_words")).cast("double"),
        ).alias("x"),
    )


def fit(x: np.ndarray, y: np.ndarray, seed: int = 20260829) -> tuple[np.ndarray, float]:
    """(weights, threshold) of the Bradley-Terry model."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1] if x.ndim == 2 else 0), 0.0
    rng = np.random.default_rng(seed)
    d = good[rng.integers(0, len(good), PAIRS)] - bad[rng.integers(0, len(bad), PAIRS)]
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's method on the convex loss
        p = 1 / (1 + np.exp(-d @ w))
        grad = d.T @ (p - 1) / PAIRS + RIDGE * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / PAIRS + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    # The quantile that parts the sample in its own shares; between the two neighbours there.
    s = np.sort(x @ w)
    k = min(max(len(bad), 1), len(s) - 1)
    return w, float((s[k - 1] + s[k]) / 2)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per text."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    agreed = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    # At most ``sample`` rows of two numbers, each id once: small by construction.
    picked = F.broadcast(agreed.orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = features(docs.join(picked, docs[id_col] == picked["id"], "left_semi"), id_col, text_col)
    learned = rows.groupBy("doc_id").agg(F.min("x").alias("x")).join(picked, F.col("doc_id") == F.col("id")).select("doc_id", "x", "y").toPandas().sort_values("doc_id")
    x = np.array(learned["x"].tolist(), float) if len(learned) else np.zeros((0, 0))
    w, threshold = fit(x, learned["y"].to_numpy())
    scored = features(docs, id_col, text_col)
    rank = sum((F.lit(float(a)) * F.get("x", F.lit(k)) for k, a in enumerate(w)), F.lit(0.0)) if w.any() else F.lit(None).cast("double")
    shift = float(np.log(CUT / (1 - CUT)))
    p = F.coalesce(1 / (1 + F.exp(-(rank - threshold + shift))), F.lit(0.5))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), p.alias("score"), (p >= CUT).cast("int").alias("predicted"))
