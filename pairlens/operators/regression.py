"""Corrections predicted from a second view: ridge with category terms, and a rank-one term whose strength differs by category.

A subject's mean in the second view (its centroid) predicts what its cells add to the category's mean vector. Everything that a fit needs are sums by fold and category: of
centroids, of offsets and of their products. They are added up in one pass over the cells, wherever these lie; the driver holds folds x categories of them and no cell.
The normal equations of a training set are the whole's less a fold's (a downdate, not a second pass), its standardisation follows from the same sums, and so do
the error on the fold left out, the alternating least squares of the rank-one term and its score. Each block of coefficients (centroid, category, rank one) has a
penalty of its own. Applying a fit is a join by subject and a product with small matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.vectors import cosine_from, dot, mean_vectors, norm
from pairlens.operators.pools import order_of, rotated
from pairlens.plans.scan import Run, scan
from pairlens.plans.storage import settled

# The penalties that are compared, and the block penalties of the regularised form.
ALPHAS = (1.0, 3.0, 10.0, 30.0)
BLOCK_PENALTIES = {"centroid": 100.0, "category": 10.0, "rank_one": 1.0}
FOLDS = 5


def centroids(items: DataFrame) -> DataFrame:
    """(subject, n, sums, x) of items(subject, proxy)."""
    return mean_vectors(items, ["subject"], "proxy").withColumnRenamed("mean", "x")


def shuffled(centred: DataFrame, seed: int, wrong: bool = False) -> DataFrame:
    """Centroids dealt to other subjects: at random, or with ``wrong`` so that no subject keeps its own."""
    if wrong:
        return rotated(centred.select("subject", "x"), "subject", "x", seed).select("subject", F.col("shuffled").alias("x"))
    place = lambda s, name: settled(scan(centred.select("subject", "x"), [], [order_of(s, "subject"), "subject"], {name: Run("count")}))
    return place(seed, "i").select("subject", "i").join(place(seed + 1, "i").select("x", "i"), "i").select("subject", "x")


def cells(items: DataFrame, centred: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(subject, category, fold, x, y): cell means of items(subject, category, vec) with the subject's centroid; folds by hash."""
    return cell_means(items, folds).join(centred.select("subject", "x"), "subject").select("subject", "category", "fold", "x", "y")


def cell_means(items: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(subject, category, fold, y) of ``cells``: what does not depend on the centroids."""
    means = mean_vectors(items, ["subject", "category"]).select("subject", "category", F.col("mean").alias("y"))
    return means.withColumn("fold", F.pmod(F.xxhash64("subject", "category"), F.lit(folds)).cast("int"))


@dataclass
class Sums:
    """Counts, sums and products of rows (x, y)."""

    n: float
    sx: np.ndarray
    sy: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    def __add__(self, o: Sums) -> Sums:
        return Sums(self.n + o.n, self.sx + o.sx, self.sy + o.sy, self.xx + o.xx, self.xy + o.xy, self.yy + o.yy)

    def __sub__(self, o: Sums) -> Sums:
        return Sums(self.n - o.n, self.sx - o.sx, self.sy - o.sy, self.xx - o.xx, self.xy - o.xy, self.yy - o.yy)

    def about(self, m: np.ndarray) -> Sums:
        """The sums of (x, y - m)."""
        return Sums(self.n, self.sx, self.sy - self.n * m, self.xx, self.xy - np.outer(self.sx, m), self.yy - 2 * m @ self.sy + self.n * m @ m)

    def standardised(self, mu: np.ndarray, sd: np.ndarray) -> Sums:
        """The sums of ((x - mu) / sd, y)."""
        xx = (self.xx - np.outer(self.sx, mu) - np.outer(mu, self.sx) + self.n * np.outer(mu, mu)) / np.outer(sd, sd)
        return Sums(self.n, (self.sx - self.n * mu) / sd, self.sy, xx, (self.xy - np.outer(mu, self.sy)) / sd[:, None], self.yy)


def blocks(made: DataFrame) -> dict[tuple[int, object], Sums]:
    """{(fold, category): sums} of ``cells``: one row of sums a task and group, added up by group."""
    return blocks_by(made.withColumn("name", F.lit("")))[""]


def blocks_by(made: DataFrame) -> dict[str, dict[tuple[int, object], Sums]]:
    """``blocks`` of every ``name`` of the cells, in one job."""
    kind, keys = made.schema["category"].dataType.simpleString(), ["name", "fold", "category"]
    shape = f"name string, fold int, category {kind}, n double, sx array<double>, sy array<double>, xx array<double>, xy array<double>, yy double"

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (name, fold, category), g in pdf.groupby(keys):
                x, y = np.stack(g["x"].to_numpy()), np.stack(g["y"].to_numpy())
                yield pd.DataFrame({"name": [name], "fold": [fold], "category": [category], "n": [float(len(g))], "sx": [x.sum(0)], "sy": [y.sum(0)], "xx": [(x.T @ x).ravel()], "xy": [(x.T @ y).ravel()], "yy": [float((y * y).sum())]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        added = {c: [np.sum(np.stack(pdf[c].to_numpy()), axis=0)] for c in ("sx", "sy", "xx", "xy")}
        return pd.DataFrame({**{k: pdf[k].iloc[:1] for k in keys}, "n": [pdf["n"].sum()], **added, "yy": [pdf["yy"].sum()]})

    parts = made.select(*keys, "x", "y").mapInPandas(part, shape)
    out: dict = {}
    for r in parts.groupBy(*keys).applyInPandas(total, shape).collect():
        p, q = len(r["sx"]), len(r["sy"])
        out.setdefault(r["name"], {})[r["fold"], r["category"]] = Sums(r["n"], np.array(r["sx"]), np.array(r["sy"]), np.array(r["xx"]).reshape(p, p), np.array(r["xy"]).reshape(p, q), r["yy"])
    return out


def _scale(by: dict[object, Sums]) -> tuple[np.ndarray, np.ndarray]:
    whole = sum(list(by.values())[1:], list(by.values())[0])
    mu = whole.sx / whole.n
    var = np.maximum(np.diag(whole.xx) / whole.n - mu * mu, 0)
    sd = np.sqrt(var)
    return mu, np.where(sd <= 1e-12 * np.maximum(1.0, np.abs(mu)), 1.0, sd)


def _equations(by: dict[object, Sums], names: list) -> tuple[np.ndarray, np.ndarray, float]:
    """Products of the design (standardised centroid, one column a category) with itself and with the offsets, and the offsets' squares."""
    one = next(iter(by.values()))
    p, q, c = len(one.sx), len(one.sy), len(names)
    a, b, yy = np.zeros((p + c, p + c)), np.zeros((p + c, q)), 0.0
    for k, name in enumerate(names):
        if name in by:
            s = by[name]
            a[:p, :p] += s.xx
            a[:p, p + k] = a[p + k, :p] = s.sx
            a[p + k, p + k] = s.n
            b[:p] += s.xy
            b[p + k] = s.sy
            yy += s.yy
    return a, b, yy


@dataclass
class Fit:
    """A fitted correction: ``component`` of a centroid and category is taken from vectors, ``anchor`` put back."""

    mu: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    bias: dict[object, np.ndarray]
    alpha: float
    anchor: np.ndarray
    r2: float
    u: np.ndarray | None = None
    v: np.ndarray | None = None
    strength: dict[object, float] = field(default_factory=dict)

    def component(self, x: np.ndarray, category: list) -> np.ndarray:
        if unknown := set(category) - set(self.bias):
            raise ValueError(f"unknown category: {sorted(map(str, unknown))[0]}")
        z = (x - self.mu) / self.sd
        out = z @ self.weights + np.stack([self.bias[c] for c in category])
        if self.u is not None:
            out += np.outer((z @ self.v) * np.array([self.strength[c] for c in category]), self.u)
        return out

    def with_bias_of_the_next(self) -> Fit:
        """The control: every category has the next one's term."""
        names = sorted(self.bias)
        return Fit(**{**self.__dict__, "bias": {c: self.bias[d] for c, d in zip(names, names[1:] + names[:1], strict=True)}})

    def with_strength_of_the_next(self) -> Fit:
        """The control: every category has the next one's strength."""
        names = sorted(self.strength)
        return Fit(**{**self.__dict__, "strength": {c: self.strength[d] for c, d in zip(names, names[1:] + names[:1], strict=True)}})


def _solve(a: np.ndarray, b: np.ndarray, p: int, alpha: float, penalty: dict[str, float]) -> np.ndarray:
    return np.linalg.solve(a + alpha * np.diag([penalty["centroid"]] * p + [penalty["category"]] * (len(a) - p)), b)


def fit(sums: dict[tuple[int, object], Sums], alphas: tuple[float, ...] = ALPHAS, penalty: dict[str, float] | None = None, rank_one: bool = False, restarts: int = 5, rounds: int = 200, tol: float = 1e-6, patience: int = 20, seed: int = 20260829) -> Fit:
    """The ridge of the least cross-validated error, and with ``rank_one`` the rank-one term of what it leaves."""
    penalty = penalty or {"centroid": 1.0, "category": 1.0, "rank_one": 1.0}
    names = sorted({c for _, c in sums})
    folds = sorted({f for f, _ in sums})
    whole: dict[object, Sums] = {}
    for (_, c), s in sums.items():
        whole[c] = whole[c] + s if c in whole else s
    # Offsets: cell means less the mean of the category's cells.
    main = {c: s.sy / s.n for c, s in whole.items()}
    about = {k: s.about(main[k[1]]) for k, s in sums.items()}
    total = {c: s.about(main[c]) for c, s in whole.items()}
    p = len(next(iter(total.values())).sx)

    def error(alpha: float, out: int) -> float:
        left = {c: about[out, c] for c in names if (out, c) in about}
        train = {c: total[c] - left[c] if c in left else total[c] for c in names}
        train = {c: s for c, s in train.items() if s.n > 0.5}
        mu, sd = _scale(train)
        a, b, _ = _equations({c: s.standardised(mu, sd) for c, s in train.items()}, names)
        beta = _solve(a, b, p, alpha, penalty)
        a, b, yy = _equations({c: s.standardised(mu, sd) for c, s in left.items()}, names)
        return (yy - 2 * (beta * b).sum() + (beta * (a @ beta)).sum()) / (sum(s.n for s in left.values()) * b.shape[1])

    alpha = min((float(np.mean([error(a, f) for f in folds])), a) for a in alphas)[1] if len(folds) > 1 else alphas[0]
    mu, sd = _scale(total)
    by = {c: s.standardised(mu, sd) for c, s in total.items()}
    a, b, yy = _equations(by, names)
    beta = _solve(a, b, p, alpha, penalty)
    weights, bias = beta[:p], {c: beta[p + k] for k, c in enumerate(names)}
    n = sum(s.n for s in by.values())
    mean = sum(s.sx @ weights + s.n * bias[c] for c, s in by.items()) / n
    left = yy - 2 * (beta * b).sum() + (beta * (a @ beta)).sum()
    spread = yy - n * float(((sum(s.sy for s in by.values()) / n) ** 2).sum())
    got = Fit(mu, sd, weights, bias, alpha, mean, 1 - left / spread if spread > 0 else 0.0)
    if not rank_one:
        return got
    # What the ridge leaves, by category: products with the centroids, and the squares.
    rest = {c: s.xy - s.xx @ weights - np.outer(s.sx, bias[c]) for c, s in by.items()}
    got.u, got.v, got.strength, left = _rank_one({c: s.xx for c, s in by.items()}, rest, left, alpha * penalty["rank_one"], restarts, rounds, tol, patience, seed)
    got.anchor = mean + sum(got.strength[c] * (s.sx @ got.v) for c, s in by.items()) / n * got.u
    got.r2 = 1 - left / spread if spread > 0 else 0.0
    return got


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x)
    return x / size if size > 0 else np.eye(len(x))[0]


def _rank_one(zz: dict, zr: dict, squares: float, penalty: float, restarts: int, rounds: int, tol: float, patience: int, seed: int) -> tuple[np.ndarray, np.ndarray, dict[object, float], float]:
    """(u, v, strength by category, squares left): the residual is strength x (z v) u; alternating least squares on products alone, the best of several starts."""
    p, q = next(iter(zr.values())).shape
    rng, best = np.random.default_rng(seed), (np.zeros(q), np.zeros(p), dict.fromkeys(zz, 1.0), squares)
    if squares <= 1e-12:
        return best
    for _ in range(restarts):
        u, v, s = _unit(rng.normal(size=q)), _unit(rng.normal(size=p)), dict.fromkeys(zz, 1.0)
        last, still = np.inf, 0
        for _ in range(rounds):
            along = sum(s[c] * (v @ zr[c]) for c in zz)
            u = _unit(along) if np.linalg.norm(along) > 0 else u
            v = _unit(np.linalg.solve(sum(s[c] ** 2 * zz[c] for c in zz) + penalty * np.eye(p), sum(s[c] * (zr[c] @ u) for c in zz)))
            size = {c: v @ zz[c] @ v for c in zz}
            s = {c: float(v @ zr[c] @ u / size[c]) if size[c] > 0 else 0.0 for c in zz}
            left = squares - 2 * sum(s[c] * (v @ zr[c] @ u) for c in zz) + sum(s[c] ** 2 * size[c] for c in zz)
            if left < best[3] - tol * squares:
                best = (u, v, s, left)
            still = still + 1 if abs(last - left) < tol * squares else 0
            last = left
            if still >= patience:
                break
    return best


def cleaned(items: DataFrame, centred: DataFrame, fitted: Fit) -> DataFrame:
    """items(item, subject, category, vec, ...) with the component taken from ``vec``; subjects without a centroid are left out, unknown categories refused."""
    both = items.drop("norm").join(centred.select("subject", F.col("x").alias("__x")), "subject")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                gone = fitted.component(np.stack(pdf["__x"].to_numpy()), pdf["category"].tolist())
                pdf["vec"] = list(np.stack(pdf["vec"].to_numpy()) - gone + fitted.anchor)
            yield pdf

    dim = len(fitted.anchor)
    return both.mapInPandas(run, both.schema).drop("__x").withColumn("norm", norm("vec", dim))


def formed(items: DataFrame, forms: dict[str, tuple[Fit, str]]) -> DataFrame:
    """items(category, vec, x_<centre>..., ...) with ``vec_<form>`` and ``norm_<form>`` of every form (its fit and the centre that it is applied to), in one pass."""
    kept = items.drop("norm", *{f"x_{centre}" for _, centre in forms.values()})
    names, kinds = kept.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                vec, category = np.stack(pdf["vec"].to_numpy()), pdf["category"].tolist()
                at = {centre: np.stack(pdf[f"x_{centre}"].to_numpy()) for _, centre in forms.values()}
                yield pdf[names].assign(**{f"vec_{name}": list(vec - fitted.component(at[centre], category) + fitted.anchor) for name, (fitted, centre) in forms.items()})

    made = items.mapInPandas(run, f"{kinds}, " + ", ".join(f"vec_{name} array<double>" for name in forms))
    return made.select("*", *(norm(f"vec_{name}").alias(f"norm_{name}") for name in forms))


def form_distance(name: str) -> F.Column:
    """The distance of a pair under a form, of rows with both ends' vectors. Not written out term by term: the code of many forms would fill the driver."""
    return cosine_from(dot(f"vec_{name}_l", f"vec_{name}_r"), F.col(f"norm_{name}_l"), F.col(f"norm_{name}_r"), "distinct")


def leave_pair_out(pairs: DataFrame, items: DataFrame, centred: DataFrame, fitted: Fit) -> DataFrame:
    """pairs(item_l, item_r, ...) with the ``distance`` when each end's centroid is that of its subject's other items, and ``fallbacks``, ends without any, which keep the
    whole centroid. The sums less the pair's own items give it; nothing is fitted again."""
    known = items.join(centred.select("subject", F.col("n").alias("c"), F.col("sums").alias("t")), "subject")
    side = lambda s: known.select(F.col("item").alias(f"item_{s}"), *(F.col(k).alias(f"__{k}_{s}") for k in ENDS))
    return apart(pairs.join(side("l"), "item_l").join(side("r"), "item_r"), pairs.columns, fitted)


#: What a pair's end has for ``apart``: ``c`` and ``t`` are its subject's count and sums.
ENDS = ("subject", "category", "vec", "proxy", "c", "t")


def apart(both: DataFrame, names: list[str], fitted: Fit) -> DataFrame:
    """The columns ``names`` of pairs whose ends' ``ENDS`` are there as __<name>_l and __<name>_r, with the ``distance`` and ``fallbacks`` of ``leave_pair_out``."""
    dim = len(fitted.anchor)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            same = (pdf["__subject_l"] == pdf["__subject_r"]).to_numpy()
            short = np.zeros(len(pdf), np.int64)
            at = {s: np.stack(pdf[f"__proxy_{s}"].to_numpy()) for s in "lr"}
            for s, o in (("l", "r"), ("r", "l")):
                whole, count = np.stack(pdf[f"__t_{s}"].to_numpy()), pdf[f"__c_{s}"].to_numpy()
                others = count - 1 - same
                rest = whole - at[s] - np.where(same[:, None], at[o], 0)
                x = np.where((others > 0)[:, None], rest / np.maximum(others, 1)[:, None], whole / count[:, None])
                short += others <= 0
                pdf[f"__v_{s}"] = list(np.stack(pdf[f"__vec_{s}"].to_numpy()) - fitted.component(x, pdf[f"__category_{s}"].tolist()) + fitted.anchor)
            yield pdf[names].assign(__v_l=pdf["__v_l"], __v_r=pdf["__v_r"], fallbacks=short)

    kinds = ", ".join(f"`{n}` {both.schema[n].dataType.simpleString()}" for n in names)
    got = both.select(*names, *(f"__{k}_{s}" for s in "lr" for k in ENDS)).mapInPandas(run, f"{kinds}, __v_l array<double>, __v_r array<double>, fallbacks long")
    return got.withColumn("distance", cosine_from(dot("__v_l", "__v_r", dim), norm("__v_l", dim), norm("__v_r", dim), "distinct")).drop("__v_l", "__v_r")
