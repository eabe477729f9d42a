"""All replicates of a bootstrap at once.

A unit's draws in all replicates are one vector of counts, and a pair's weights the product of its ends' vectors; no row is ever (pair, replicate). Sums are vectors added
up in each task and then by group. The weighted medians of all replicates come from one selection: rows are cut into parts by range of (group, value), each part's total
weight is a vector, and the vectors of the parts before tell in which part a replicate reaches half of its weight; only those parts are read again, in order.
Vectors join by unit; they are broadcast if their table is at most SMALL bytes, else the join shuffles: both give the same rows, whose order does not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.plans.storage import settled

SMALL = 64 << 20
#: Rows whose weights are added up at once.
_CHUNK = 1024


def matrix(column: pd.Series, kind: str = "<i8") -> np.ndarray:
    """Rows of packed vectors."""
    return np.frombuffer(b"".join(map(bytes, column)), kind).reshape(len(column), -1)


def drawn(seed: int | np.ndarray, replicate: np.ndarray, k: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """The rule of ``scalars.draw`` over arrays; remainders by the Mersenne prime 2^31 - 1 are sums of its halves."""
    p = 2147483647

    def rest(x: np.ndarray) -> np.ndarray:
        x = (x & p) + (x >> 31)
        x = (x & p) + (x >> 31)
        return np.where(x >= p, x - p, x)

    x = rest(np.asarray(seed + replicate * 1000003 + k * 7919, np.int64))
    return rest(rest(x * x) * 48271 + x) % n


def own_seed(seed: int, *keys: object) -> int:
    """The rule of ``scalars.group_seed``."""
    return seed + int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:7], 16)


def counted(spark: SparkSession, n: int, replicates: int, seed: int, block: int) -> DataFrame:
    """(replicate, block, m): how often each of n units is drawn in n draws, as packed counts of the units of a block. Draws are made from integers where they are counted, so no row is a draw."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf["id"]:
                for kind in ("u1", "<i4"):
                    m = np.zeros(n, kind)
                    for lo in range(0, n, 1 << 20):
                        np.add.at(m, drawn(seed, r, np.arange(lo, min(n, lo + (1 << 20)), dtype=np.int64), n), m.dtype.type(1))
                    if m.sum(dtype=np.int64) == n:  # else a small counter ran over
                        break
                yield pd.DataFrame({"replicate": r, "block": range(-(-n // block)), "m": [m[lo : lo + block].tobytes() for lo in range(0, n, block)]})

    return spark.range(0, replicates, 1, min(replicates, 200)).mapInPandas(count, "replicate int, block long, m binary")


def _counts(column: pd.Series, size: int) -> np.ndarray:
    return np.stack([np.frombuffer(m, "u1" if len(m) == size else "<i4") for m in column])


def drawn_sums(rows: DataFrame, number: str, values: list[str], replicates: int, seed: int, block: int = 1 << 14) -> DataFrame:
    """(replicate, values): the sums of ``values`` over as many rows as there are, drawn with replacement; ``number`` numbers the rows from 0. A block's rows meet its counts in all replicates."""
    n = rows.count()
    ours = rows.select(F.floor(F.col(number) / block).alias("block"), number, *(F.col(v).cast("double").alias(v) for v in values))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x = left.sort_values(number)[values].to_numpy(float)
        got = [_counts(right["m"].iloc[lo : lo + 100], len(x)).astype(float) @ x for lo in range(0, len(right), 100)]
        return pd.DataFrame(np.concatenate(got) if got else np.zeros((0, len(values))), columns=values).assign(replicate=right["replicate"].to_numpy())[["replicate", *values]]

    shape = "replicate int, " + ", ".join(f"{v} double" for v in values)
    met = ours.groupBy("block").cogroup(counted(rows.sparkSession, n, replicates, seed, block).groupBy("block")).applyInPandas(meet, shape)
    return met.groupBy("replicate").agg(*(F.sum(v).alias(v) for v in values))


def drawn_vectors(units: DataFrame, unit: str, replicates: int, seed: int, block: int = 1 << 11) -> DataFrame:
    """(unit, ms): the counts of every unit in all replicates, of as many draws as there are units; units(unit, idx) are numbered from 0."""
    n = units.count()
    kind = units.schema[unit].dataType.simpleString()

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("idx")
        ms = np.zeros((len(left), replicates), "<i4")
        ms[:, right["replicate"].to_numpy()] = _counts(right["m"], len(left)).T
        return pd.DataFrame({unit: left[unit].to_numpy(), "ms": [x.tobytes() for x in ms]})

    ours = units.select(unit, "idx", F.floor(F.col("idx") / block).alias("block"))
    return settled(ours.groupBy("block").cogroup(counted(units.sparkSession, n, replicates, seed, block).groupBy("block")).applyInPandas(meet, f"`{unit}` {kind}, ms binary"))


def vectors(drawn: DataFrame, keys: list[str], replicates: int) -> DataFrame:
    """(keys, ms): the counts of drawn(replicate, keys, m) as one packed vector."""
    kept = drawn.groupBy(*keys).agg(F.collect_list("replicate").alias("r"), F.collect_list("m").alias("m"))

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            ms = np.zeros((len(pdf), replicates), "<i4")
            for row, (r, m) in enumerate(zip(pdf["r"], pdf["m"], strict=True)):
                ms[row, r] = m
            yield pdf[keys].assign(ms=[x.tobytes() for x in ms])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keys)
    return settled(kept.mapInPandas(pack, f"{kinds}, ms binary"))


def weighed(rows: DataFrame, drawn: DataFrame, unit: str, on: list[str], replicates: int) -> DataFrame:
    """``rows`` with the vectors ``ms_l`` and ``ms_r`` of their ends, and whether the ends are ``one``; a pair with an end that no replicate drew drops out."""
    packed = drawn if "ms" in drawn.columns else vectors(drawn, [*on, unit], replicates)
    bytes_ = packed.count() * (4 * replicates + 100)
    side = lambda s: packed.select(*on, F.col(unit).alias(f"{unit}_{s}"), F.col("ms").alias(f"ms_{s}"))
    sent = F.broadcast if bytes_ <= SMALL else (lambda f: f.hint("merge"))
    both = rows.join(sent(side("l")), [*on, f"{unit}_l"]).join(sent(side("r")), [*on, f"{unit}_r"])
    return both.withColumn("one", F.col(f"{unit}_l") == F.col(f"{unit}_r"))


def products(pdf: pd.DataFrame) -> np.ndarray:
    """The weights of pairs in all replicates."""
    left, right = matrix(pdf["ms_l"], "<i4").astype(np.int64), matrix(pdf["ms_r"], "<i4")
    return np.where(pdf["one"].to_numpy(bool)[:, None], left, left * right)


Fields = dict[str, Callable[[pd.DataFrame], np.ndarray]]


def summed(frame: DataFrame, keys: list[str], fields: Fields, kind: str = "<i8") -> DataFrame:
    """(keys, fields): vectors of ``fields`` (a matrix of each batch, of whole numbers or with kind <f8 of doubles) added up by keys, in each task first."""
    names = list(fields)

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if not len(pdf):
                continue
            made = {n: f(pdf) for n, f in fields.items()}
            groups = pdf.groupby(keys, sort=False, dropna=False).indices
            heads = pdf[keys].iloc[[ix[0] for ix in groups.values()]]
            yield heads.assign(**{n: [m[ix].sum(0).astype(kind).tobytes() for ix in groups.values()] for n, m in made.items()})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[keys].iloc[:1].assign(**{n: [matrix(pdf[n], kind).sum(0).tobytes()] for n in names})

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name in keys), *(f"{n} binary" for n in names)])
    ordered = [f.name for f in frame.schema if f.name in keys]
    select = lambda f: f.select(*ordered, *names)
    return select(select(frame.mapInPandas(lambda p: (x[[*ordered, *names]] for x in partial(p)), kinds)).groupBy(*ordered).applyInPandas(lambda p: total(p)[[*ordered, *names]], kinds))


def unpacked(frame: DataFrame, keys: list[str], fields: list[str], kind: str = "<i8") -> DataFrame:
    """(keys, replicate, fields) of packed vectors: as many rows as groups and replicates."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for k in range(len(pdf)):
                one = pdf.iloc[k : k + 1]
                made = {n: matrix(one[n], kind)[0] for n in fields}
                yield pd.DataFrame({**{c: [one[c].iloc[0]] * len(made[fields[0]]) for c in keys}, "replicate": range(len(made[fields[0]])), **made})

    kinds = ", ".join([*(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in keys), "replicate int", *(f"{n} {'long' if kind == '<i8' else 'double'}" for n in fields)])
    return frame.mapInPandas(run, kinds)


def cut(rows: DataFrame, keys: list[str], value: str, *ties: str) -> DataFrame:
    """``rows`` with the ``part`` of the range of (keys, value, ties) that they lie in, written."""
    return settled(rows.repartitionByRange(*keys, value, *ties).withColumn("part", F.spark_partition_id()))


def medians(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, replicate, median): in every replicate the first value at which the running weight reaches half of the group's, of rows from ``cut`` and ``weighed``;
    a group without weight in a replicate has no row there."""
    parts = summed(frame, [*keys, "part"], {"own": products})

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        own = matrix(pdf["own"])
        upto = np.cumsum(own, axis=0)
        total = upto[-1]
        before = upto - own
        hits = ((2 * before < total) & (2 * upto >= total)).any(1)
        return pdf[hits].drop(columns="own").assign(before=[x.tobytes() for x in before[hits]], total=total.tobytes())

    names = [f.name for f in parts.schema if f.name != "own"]
    kinds = ", ".join(f"`{n}` {parts.schema[n].dataType.simpleString()}" for n in names)
    hits = settled(parts.groupBy(*keys).applyInPandas(place, f"{kinds}, before binary, total binary"))

    def select(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(value)
        values, run, total = left[value].to_numpy(), matrix(right["before"])[0].copy(), matrix(right["total"])[0]
        open_ = (2 * run < total) & (total > 0)
        found = np.full(len(run), np.nan)
        for at in range(0, len(left), _CHUNK):
            upto = run + np.cumsum(products(left.iloc[at : at + _CHUNK]), axis=0)
            reached = open_ & (2 * upto[-1] >= total)
            found[reached] = values[at + (2 * upto[:, reached] >= total[reached]).argmax(0)]
            open_ &= ~reached
            run = upto[-1]
        got = np.flatnonzero(~np.isnan(found))
        return pd.DataFrame({**{c: [right[c].iloc[0]] for c in keys}, "rs": [got], "ms": [found[got]]})

    again = frame.join(hits.select(*keys, "part"), [*keys, "part"], "left_semi").select(*keys, "part", value, "ms_l", "ms_r", "one")
    shape = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in keys)
    got = again.groupBy(*keys, "part").cogroup(hits.groupBy(*keys, "part")).applyInPandas(select, f"{shape}, rs array<int>, ms array<double>")
    return got.select(*keys, F.explode(F.arrays_zip("rs", "ms")).alias("e")).select(*keys, F.col("e.rs").alias("replicate"), F.col("e.ms").alias("median"))
