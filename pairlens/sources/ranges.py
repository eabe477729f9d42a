"""Archives read by byte range: members of a tar in parts, and rows of the arrays of an NPZ, as Spark data sources.

A plain tar says where its members lie in 512 bytes a member, and an NPZ in its directory and in the header of each array; planning reads these alone. Splits are ranges of at most ``split`` bytes,
each read by a task of its own that seeks to it. What is compressed cannot be sought in: a deflated array is one split, read as a stream, and a gzipped tar is read by
``media.archive_members``. Arrays of Python objects are refused: nothing is unpickled. Paths are files that all executors see.
"""

from __future__ import annotations

import io
import json
import os
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pairlens.sources.media import safe_member

SPLIT = 64 << 20


class Parts(io.RawIOBase):
    """Files in order as one that can be sought in; a part is opened when it is reached."""

    def __init__(self, paths: list[str]) -> None:
        self._paths, self._at, self._open = paths, 0, (None, None)
        self._ends = np.cumsum([os.path.getsize(p) for p in paths]).tolist()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, to: int, whence: int = 0) -> int:
        self._at = to + (0, self._at, self._ends[-1] if self._ends else 0)[whence]
        return self._at

    def readinto(self, into) -> int:
        part = int(np.searchsorted(self._ends, self._at, side="right"))
        if part == len(self._ends):
            return 0
        if self._open[0] != part:
            self.close_part()
            self._open = (part, open(self._paths[part], "rb"))
        begin = self._ends[part - 1] if part else 0
        self._open[1].seek(self._at - begin)
        n = self._open[1].readinto(memoryview(into)[: self._ends[part] - self._at])
        self._at += n
        return n

    def close_part(self) -> None:
        if self._open[1] is not None:
            self._open[1].close()

    def close(self) -> None:
        self.close_part()
        super().close()


@dataclass
class Range(InputPartition):
    """What one task reads: pieces (name, offset, size, first row, shape of a row, kind) of the file."""

    pieces: list


def packed(pieces: list[tuple], split: int) -> list[Range]:
    """Pieces in order, put together to at most ``split`` bytes; a larger one stands alone."""
    out, held = [], 0
    for p in pieces:
        if not out or held + p[2] > split:
            out.append(Range([]))
            held = 0
        out[-1].pieces.append(p)
        held += p[2]
    return out


class TarRanges(DataSource):
    """``spark.read.format("tar_ranges").option("parts", json list of paths).load()``: (member, size, offset, content) of every file of a plain tar cut into parts;
    option ``wanted``, a JSON list of members; ``content`` = false gives the directory alone. Members whose names lead out of the archive are refused."""

    @classmethod
    def name(cls) -> str:
        return "tar_ranges"

    def schema(self) -> str:
        return "member string, size long, offset long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _TarReader(self.options)


class _TarReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.parts, self.split = json.loads(options["parts"]), int(options.get("split", SPLIT))
        self.wanted = set(json.loads(options["wanted"])) if "wanted" in options else None
        self.content = options.get("content", "true") != "false"

    def partitions(self) -> list[Range]:
        with Parts(self.parts) as raw, tarfile.open(fileobj=io.BufferedReader(raw), mode="r:") as tar:
            found = [(m.name, m.offset_data, m.size) for m in tar if m.isfile() and (self.wanted is None or m.name in self.wanted)]
        if bad := [n for n, *_ in found if not safe_member(n)]:
            raise ValueError(f"unsafe member: {bad[0]}")
        return packed(found, self.split) or [Range([])]

    def read(self, partition: Range) -> Iterator[tuple]:
        with Parts(self.parts) as raw, io.BufferedReader(raw) as file:
            for name, offset, size in partition.pieces:
                if self.content:
                    file.seek(offset)
                yield name, size, offset, file.read(size) if self.content else None


class NpzRows(DataSource):
    """``spark.read.format("npz_rows").load(path)``: (name, row, values) of the numeric arrays of an NPZ, a row of an array flat; option ``arrays``, a JSON list of names."""

    @classmethod
    def name(cls) -> str:
        return "npz_rows"

    def schema(self) -> str:
        return "name string, row long, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _NpzReader(self.options)


def _npy_header(file) -> tuple[tuple, bool, np.dtype]:
    version = np.lib.format.read_magic(file)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
    if kind.hasobject:
        raise ValueError("an array of Python objects is not read")
    return shape, fortran, kind


class _NpzReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.arrays = set(json.loads(options["arrays"])) if "arrays" in options else None

    def partitions(self) -> list[Range]:
        pieces = []
        with open(self.path, "rb") as file, zipfile.ZipFile(file) as archive:
            for info in archive.infolist():
                name = info.filename.removesuffix(".npy")
                if not info.filename.endswith(".npy") or (self.arrays is not None and name not in self.arrays):
                    continue
                with archive.open(info) as inside:
                    shape, fortran, kind = _npy_header(inside)
                    begin = inside.tell()
                rows, wide = (shape[0] if shape else 1), int(np.prod(shape[1:], dtype=np.int64))
                if not rows * wide:
                    continue
                if info.compress_type != zipfile.ZIP_STORED or fortran:
                    pieces.append((name, -1, info.file_size, 0, info.filename, kind.str))
                    continue
                # Behind the entry's own header, whose names may be longer than the directory's.
                file.seek(info.header_offset + 26)
                extra = sum(int.from_bytes(file.read(2), "little") for _ in range(2))
                data, row = info.header_offset + 30 + extra + begin, wide * kind.itemsize
                step = max(1, self.split // max(row, 1))
                pieces += [(name, data + r * row, min(step, rows - r) * row, r, wide, kind.str) for r in range(0, rows, step)]
        return packed(pieces, self.split) or [Range([])]

    def read(self, partition: Range) -> Iterator[tuple]:
        with open(self.path, "rb") as file:
            for name, offset, size, first, wide, kind in partition.pieces:
                if offset < 0:
                    with zipfile.ZipFile(file) as archive, archive.open(wide) as inside:
                        values = np.lib.format.read_array(inside, allow_pickle=False)
                    values = values.reshape(len(values) if values.ndim else 1, -1)
                else:
                    file.seek(offset)
                    values = np.frombuffer(file.read(size), kind).reshape(-1, wide)
                for k, row in enumerate(values.astype(np.float64)):
                    yield name, first + k, row.tolist()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarRanges)
    spark.dataSource.register(NpzRows)


def matrix_entries(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(name, l, r, value): the entries of square arrays of ``npz_rows`` under the names(i, label) of their rows and columns."""
    long = rows.select("name", F.col("row").alias("i"), F.posexplode("values").alias("j", "value"))
    left, right = (names.select(F.col("i").cast("long").alias(k), F.col("label").alias(n)) for k, n in (("i", "l"), ("j", "r")))
    return long.join(left, "i").join(right.withColumn("j", F.col("j").cast("int")), "j").select("name", "l", "r", "value")


def extracted(spark: SparkSession, parts: list[str], wanted: DataFrame, root: str, split: int = SPLIT) -> DataFrame:
    """One audit row (selected, written, skipped, missing, first_missing, status) of wanted(member): members are read by range where they are written, each under a name of its own first and
    then renamed, and a file of the member's size is left alone, so that a run that was cut short goes on. A member that leads out of ``root`` is refused."""
    register(spark)
    names = wanted.select("member").distinct()
    told = spark.read.format("tar_ranges").option("parts", json.dumps(parts)).option("content", "false").option("split", str(split)).load().select("member", "size", "offset")
    asked = names.join(told, "member", "left")

    def write(batches):
        import pandas as pd

        for pdf in batches:
            state = []
            with Parts(parts) as raw, io.BufferedReader(raw) as file:
                for member, size, offset in zip(pdf["member"], pdf["size"], pdf["offset"], strict=True):
                    target = os.path.realpath(os.path.join(root, member))
                    if not safe_member(member) or not target.startswith(os.path.realpath(root) + os.sep):
                        raise ValueError(f"unsafe member: {member}")
                    if pd.isna(size):
                        state.append("missing")
                    elif os.path.exists(target) and os.path.getsize(target) == int(size):
                        state.append("skipped")
                    else:
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        mine = f"{target}.{os.getpid()}.part"
                        file.seek(int(offset))
                        with open(mine, "wb") as out:
                            for at in range(0, int(size), 1 << 20):
                                out.write(file.read(min(1 << 20, int(size) - at)))
                        os.replace(mine, target)
                        state.append("written")
            yield pd.DataFrame({"member": pdf["member"], "state": state})

    from pairlens.plans.storage import settled

    done = settled(asked.mapInPandas(write, "member string, state string"))
    n = lambda s: F.sum(F.when(F.col("state") == s, 1).otherwise(0))
    lacking = done.where("state = 'missing'").orderBy("member").limit(20).agg(F.array_sort(F.collect_list("member")).alias("first_missing"))
    audit = done.agg(F.count("*").alias("selected"), *(F.coalesce(n(s), F.lit(0)).alias(s) for s in ("written", "skipped", "missing")))
    return audit.crossJoin(lacking).withColumn("status", F.when(F.col("missing") == 0, "passed").otherwise("failed"))
