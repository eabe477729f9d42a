"""Study settings, and what may leave in a public release."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Study:
    """The settings of a study; ``locked`` names those that may not differ from the registered ones."""

    seed: int = 20260829
    replicates: int = 1000
    correction: str = "holm"
    least_pairs: int = 200
    least_gain: float = 0.05
    largest_harm: float = 0.01
    locked: tuple[str, ...] = ("seed", "replicates", "correction")


def study(settings: dict, registered: Study | None = None) -> Study:
    """Settings checked by name and type and against the registered study; anything else is an error."""
    known = {f.name: f for f in fields(Study)}
    if unknown := sorted(set(settings) - set(known)):
        raise ValueError(f"unknown settings: {unknown}")
    for name, value in settings.items():
        want = type(getattr(Study(), name))
        if isinstance(value, bool) or not isinstance(value, (int, float) if want is float else want):
            raise ValueError(f"{name}: {value!r} is not of type {want.__name__}")
    made = Study(**settings)
    base = registered or Study()
    if moved := [n for n in base.locked if getattr(made, n) != getattr(base, n)]:
        raise ValueError(f"locked settings differ: {moved}")
    return made


def registry(path: str | Path) -> dict[str, dict]:
    """A registry of manifests by role: JSON, {role: {path, split, sha256}}."""
    rows = json.loads(Path(path).read_text())
    if not isinstance(rows, dict) or any({"path", "split", "sha256"} - set(v) for v in rows.values()):
        raise ValueError("each role needs path, split and sha256")
    return rows


def sanitised(frame: DataFrame, drop: set[str], rewrite: dict[str, str]) -> DataFrame:
    """The table without private fields at any depth, and with private path prefixes in strings rewritten."""

    def keep(col, kind):
        if isinstance(kind, T.StructType):
            inner = [keep(col[f.name], f.dataType).alias(f.name) for f in kind if f.name not in drop]
            return F.when(col.isNull(), None).otherwise(F.struct(*inner)) if inner else F.lit(None)
        if isinstance(kind, T.ArrayType):
            return F.transform(col, lambda x: keep(x, kind.elementType))
        if isinstance(kind, T.StringType):
            for old, new in rewrite.items():
                col = F.replace(col, F.lit(old), F.lit(new))
        return col

    return frame.select(*(keep(F.col(f.name), f.dataType).alias(f.name) for f in frame.schema if f.name not in drop))


def offending(files: DataFrame, suffixes: tuple[str, ...], tokens: tuple[str, ...], pattern: str) -> DataFrame:
    """files(path, content) that may not be released: by suffix, by a token in the path, or by a pattern in the text."""
    low = F.lower("path")
    by_suffix, by_token = F.lit(False), F.lit(False)
    for s in suffixes:
        by_suffix = by_suffix | low.endswith(s)
    for t in tokens:
        by_token = by_token | low.contains(t)
    why = F.when(by_suffix, "suffix").when(by_token, "token").when(F.col("content").cast("string").rlike(pattern), "pattern")
    return files.select("path", why.alias("why")).where("why IS NOT NULL")
