"""Trainable projection heads: forward, losses and gradients of linear and two-layer heads; ``training`` fits them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.scalars import smooth_l1
from pairlens.functions.vectors import norm


def forward(x: np.ndarray, head: dict) -> np.ndarray:
    """Linear, or two layers with GELU between; rows of unit length."""
    z = x @ head["w1"] + head.get("b1", 0)
    if "w2" in head:
        z = 0.5 * z * (1 + np.tanh(np.sqrt(2 / np.pi) * (z + 0.044715 * z**3)))
        z = z @ head["w2"] + head.get("b2", 0)
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def transform(items: DataFrame, head: dict) -> DataFrame:
    """``items`` with projected vectors; weights travel in a broadcast (their size is the head's)."""
    shared = items.sparkSession.sparkContext.broadcast(head)

    def part(batches):
        for pdf in batches:
            if len(pdf):
                pdf["vec"] = list(forward(np.stack(pdf["vec"].to_numpy()), shared.value))
            yield pdf

    return items.drop("norm").mapInPandas(part, items.drop("norm").schema).withColumn("norm", norm("vec"))


def projected(items: DataFrame, mean: np.ndarray, directions: np.ndarray) -> DataFrame:
    """``items`` with their vectors' coordinates along directions (rows) about the mean."""
    shared = items.sparkSession.sparkContext.broadcast((mean, directions.T))

    def part(batches):
        for pdf in batches:
            if len(pdf):
                pdf["vec"] = list((np.stack(pdf["vec"].to_numpy()) - shared.value[0]) @ shared.value[1])
            yield pdf

    return items.drop("norm").mapInPandas(part, items.drop("norm").schema).withColumn("norm", norm("vec"))


def losses(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, ordinary, balanced): smooth L1 of distance and target; balanced averages the zero and the non-zero targets apart."""
    e = smooth_l1(F.col("distance") - F.col("target"))
    g = rows.groupBy(*(keys or [])).agg(F.avg(e).alias("ordinary"), F.avg(F.when(F.col("target") == 0, e)).alias("z"), F.avg(F.when(F.col("target") != 0, e)).alias("nz"))
    return g.select(*(keys or []), "ordinary", ((F.coalesce("z", "nz") + F.coalesce("nz", "z")) / 2).alias("balanced"))


def loss(pair: np.ndarray, cross: np.ndarray, strength: float, mode: str = "separate") -> float:
    """Pair and cross losses put together: their means added, or one mean over all with cross losses weighted."""
    if mode == "separate":
        return float(pair.mean() + strength * cross.mean())
    return float((pair.sum() + strength * cross.sum()) / (len(pair) + len(cross)))


def _up(x: np.ndarray, head: dict) -> tuple:
    """(hidden layer, its slope, last layer) of rows; a linear head has the last alone."""
    z = x @ head["w1"] + head["b1"]
    if "w2" not in head:
        return None, None, z
    c = np.sqrt(2 / np.pi)
    t = np.tanh(c * (z + 0.044715 * z**3))
    h = 0.5 * z * (1 + t)
    slope = 0.5 * (1 + t) + 0.5 * z * (1 - t**2) * c * (1 + 3 * 0.044715 * z**2)
    return h, slope, h @ head["w2"] + head["b2"]


def _down(x: np.ndarray, h: np.ndarray | None, slope: np.ndarray | None, dz: np.ndarray, head: dict) -> dict:
    """Gradients by the head's weights from those by the last layer's rows."""
    grads = {}
    if "w2" in head:
        grads |= {"w2": h.T @ dz, "b2": dz.sum(0)}
        dz = (dz @ head["w2"].T) * slope
    return grads | {"w1": x.T @ dz, "b1": dz.sum(0)}


def _smooth(e: np.ndarray) -> np.ndarray:
    a = np.abs(e)
    return np.where(a < 1, 0.5 * a * a, a - 0.5)


def _pair_step(head: dict, left: np.ndarray, right: np.ndarray, target: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the mean smooth L1 loss by the head's weights, and each pair's loss."""
    sides = [(x, *_up(x, head)) for x in (left, right)]
    size = [np.maximum(np.linalg.norm(s[3], axis=1, keepdims=True), 1e-9) for s in sides]
    unit = [s[3] / n for s, n in zip(sides, size, strict=True)]
    cos = (unit[0] * unit[1]).sum(1, keepdims=True)
    e = 1 - cos - target[:, None]
    g = np.clip(e, -1, 1) / len(target)
    grads = {k: np.zeros_like(v) for k, v in head.items()}
    for (x, h, slope, _), n, own, other in zip(sides, size, unit, unit[::-1], strict=True):
        for k, v in _down(x, h, slope, -g * (other - cos * own) / n, head).items():
            grads[k] += v
    return grads, _smooth(e[:, 0])


def _dense(items: int, pairs: int) -> bool:
    """Whether a table of all items by all items is small beside the pairs."""
    return items * items <= 8 * pairs


def cosines(unit: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dot products of the rows of ``unit`` at the places ``left`` and ``right``."""
    if _dense(len(unit), len(left)):
        return (unit @ unit.T).ravel()[left.astype(np.int64) * len(unit) + right]
    return np.einsum("ij,ij->i", unit[left], unit[right])


def item_step(head: dict, x: np.ndarray, left: np.ndarray, right: np.ndarray, target: np.ndarray, groups: dict[str, np.ndarray], flat_only: frozenset = frozenset()) -> dict[str, tuple[int, float, dict | None]]:
    """{group: (n, sum of losses, sums of gradients)} of pairs whose ends are the rows of ``x`` at ``left`` and ``right``: ``_pair_step`` with every row of x put through the head once, however many pairs
    it is in. ``groups`` are masks of the pairs; those in ``flat_only`` have no gradient."""
    n = len(x)
    h, slope, z = _up(x, head)
    size = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    unit = z / size
    e = 1 - cosines(unit, left, right) - target
    loss, push = _smooth(e), -np.clip(e, -1, 1)
    dense = _dense(n, len(left))
    out = {}
    for name, on in groups.items():
        count, total = int(on.sum()), float(loss[on].sum())
        if name in flat_only:
            out[name] = (count, total, None)
            continue
        i, j, c = left[on], right[on], push[on]
        # What the pairs of an item pull its unit row to.
        if dense:
            w = np.bincount(i.astype(np.int64) * n + j, weights=c, minlength=n * n).reshape(n, n)
            pull = w @ unit + w.T @ unit
        else:
            ui, uj = unit[i] * c[:, None], unit[j] * c[:, None]
            pull = np.stack([np.bincount(i, weights=uj[:, k], minlength=n) + np.bincount(j, weights=ui[:, k], minlength=n) for k in range(unit.shape[1])], axis=1)
        dz = (pull - (pull * unit).sum(1, keepdims=True) * unit) / size
        out[name] = (count, total, _down(x, h, slope, dz, head))
    return out
