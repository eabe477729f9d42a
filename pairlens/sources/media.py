"""Binary sources: members of split tar archives, and PCM audio."""

from __future__ import annotations

import io
import tarfile
import wave

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 16_000


def safe_member(name: str) -> bool:
    return not name.startswith("/") and ".." not in name.split("/")


class _Joined(io.RawIOBase):
    """The parts of a split archive read as one stream, each opened when it is reached."""

    def __init__(self, open_part, parts: list[str]):
        self._open, self._parts, self._now = open_part, list(parts), None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if self._now is None:
                if not self._parts:
                    return 0
                self._now = self._open(self._parts.pop(0))
            if n := self._now.readinto(into):
                return n
            self._now.close()
            self._now = None


def archive_members(spark: SparkSession, archives: DataFrame, wanted: DataFrame, open_part) -> DataFrame:
    """(archive, member, size, content) of wanted members; archives(archive, parts: array of part names in order), wanted(archive, member).
    One task reads one archive as a stream, since a tar has no index; ``open_part(name)`` gives a binary file."""
    asked = wanted.groupBy("archive").agg(F.collect_set("member").alias("members"))  # the list of one archive's members

    def read(batches):
        import pandas as pd

        for pdf in batches:
            for archive, parts, members in zip(pdf["archive"], pdf["parts"], pdf["members"], strict=True):
                want = set(members)
                with tarfile.open(fileobj=io.BufferedReader(_Joined(open_part, list(parts))), mode="r|") as tar:
                    for m in tar:
                        if m.isfile() and m.name in want and safe_member(m.name):
                            yield pd.DataFrame({"archive": [archive], "member": [m.name], "size": [m.size], "content": [tar.extractfile(m).read()]})

    joined = archives.join(asked, "archive").select("archive", "parts", "members")
    return joined.mapInPandas(read, "archive string, member string, size long, content binary")


def decode_wav(content: bytes, rate: int = RATE) -> np.ndarray:
    """Mono samples in -1..1 at ``rate``: 8, 16 or 32-bit PCM, channels averaged, linear resampling."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, source, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(np.float64) / float(1 << (8 * width - 1))
    else:
        raise ValueError(f"{8 * width}-bit samples")
    x = x.reshape(-1, channels).mean(1)
    if source == rate or not len(x):
        return x
    n = max(1, round(len(x) * rate / source))
    return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x)


def audio(files: DataFrame, rate: int = RATE) -> DataFrame:
    """files(path, content) -> (path, samples, seconds)."""

    def read(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                x = decode_wav(content, rate)
                yield pd.DataFrame({"path": [path], "samples": [x.tolist()], "seconds": [len(x) / rate]})

    return files.select("path", "content").mapInPandas(read, "path string, samples array<double>, seconds double")


def pooled(frames: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Mean over the frames of an item: what an encoder's last hidden states are pooled by."""
    from pairlens.functions.vectors import mean_vectors

    return mean_vectors(frames.withColumnRenamed(vec, "vec"), keys).select(*keys, F.col("mean").alias("vec"))
