"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file (base64 bytes and rank a line) becomes a byte-level BPE model: each byte is written as one
printable character, every pair of entries that joins to an entry is a merge at the joined entry's
rank, and a piece that is an entry itself is taken whole. Pieces are the matches of the pattern; text
between matches has no ids. Decoding looks ids up in the byte table, so characters that tokens split
come back whole; offsets give each token's place in the text, in code points.

Defined cases: a null or empty text has no ids and decodes to nothing; a null id is carried; repeated
rows repeat; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, whole_text

REMEMBERED = 100_000


def byte_table() -> list[str]:
    """The printable character of each byte: itself where it prints, else the next of those from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Coder:
    """Encodes texts piece by piece. A piece is encoded once by the library and remembered; the memory holds
    about twice REMEMBERED pieces at most, so a worker's memory does not follow the data."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each keep memory of their own
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks, shown = read_ranks(path), byte_table()
        write = lambda b: "".join([shown[x] for x in b])
        merges = []
        for whole in sorted(ranks, key=ranks.__getitem__):
            # Earlier splits first: of two ways to one entry, the leftmost pair is the one to join.
            merges += [(write(whole[:k]), write(whole[k:])) for k in range(1, len(whole)) if whole[:k] in ranks and whole[k:] in ranks]
        self.library = Tokenizer(models.BPE(vocab={write(b): r for b, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.table[r] = b
        self.sizes = np.array([len(b) for b in self.table], np.int64)
        self.find = regex.compile(pattern)
        self._known: dict = {}
        self._before: dict = {}

    def _learn(self, pieces: list[str]) -> None:
        """Makes every piece known; when the memory is full it becomes the one before, from which pieces in use are taken over."""
        if len(self._known) > REMEMBERED:
            self._known, self._before = {}, self._known
        known, before = self._known, self._before
        new = []
        for p in set(pieces):
            if p not in known:
                if p in before:
                    known[p] = before[p]
                else:
                    new.append(p)
        for at in range(0, len(new), 5_000):
            part = new[at : at + 5_000]
            found = self.library.encode_batch_fast(part, add_special_tokens=False)
            known.update(zip(part, self._rows(part, [e.ids for e in found]), strict=True))

    def _rows(self, pieces: list[str], ids: list[list[int]]) -> list[bytes]:
        """Of each piece its tokens as rows of four integers: id, first character and the one after the last, both counted back
        from the piece's end, and the piece's length in the first row. All pieces at a time, laid one after the other."""
        rows = np.zeros((sum(map(len, ids)), 4), "<i4")
        rows[:, 0] = np.fromiter((k for x in ids for k in x), np.int32, len(rows))
        counts, lengths = np.array([*map(len, ids)], np.int64), np.array([*map(len, pieces)], np.int64)
        upto, byte = np.cumsum(counts), np.cumsum(self.sizes[rows[:, 0]])
        # Byte places to character places: the character that a byte belongs to.
        of = np.cumsum(np.frombuffer("".join(pieces).encode(), np.uint8) & 0xC0 != 0x80) - 1
        end = np.repeat(np.cumsum(lengths), counts)
        rows[:, 1] = of[byte - self.sizes[rows[:, 0]]] - end
        rows[:, 2] = of[byte - 1] + 1 - end
        rows[upto - counts, 3] = lengths
        raw = rows.tobytes()
        return [raw[16 * a : 16 * b] for a, b in zip((upto - counts).tolist(), upto.tolist(), strict=True)]

    def rows(self, text: str) -> np.ndarray:
        """A row a token: its id, its first character and the one after its last: a token that splits a character holds it whole."""
        pieces = self.find.findall(text)
        try:
            raw = b"".join([*map(self._known.__getitem__, pieces)])
        except KeyError:
            self._learn(pieces)
            raw = b"".join([*map(self._known.__getitem__, pieces)])
        rows = np.frombuffer(raw, "<i4").reshape(-1, 4)
        ends = np.cumsum(rows[:, 3], dtype=np.int32)
        if len(ends) and ends[-1] != len(text):  # text between matches
            ends = np.array([m.end() for m in self.find.finditer(text)], np.int32)[np.cumsum(rows[:, 3] > 0) - 1]
        out = rows[:, :3].copy()
        out[:, 1] += ends
        out[:, 2] += ends
        return out

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.rows(text)[:, 0].tobytes()

    def ids_and_places(self, text: str) -> tuple[bytes, list[int], list[int]]:
        """The ids, and the first character of each token and the one after its last."""
        rows = self.rows(text)
        return rows[:, 0].tobytes(), rows[:, 1].tolist(), rows[:, 2].tolist()

    def decode(self, ids: bytes) -> bytes:
        return b"".join([*map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())])


    def forget(self) -> None:
        self._known, self._before = {}, {}


@lru_cache(maxsize=1)
def coder(path: str, pattern: str) -> Coder:
    """One a worker; its memory of pieces lasts for a partition."""
    return Coder(path, pattern)


def _few(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of about that many bytes at a time: only they are Python objects."""
    held = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) // most
    edges = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        part = batch.slice(a, b - a)
        yield part.column(0), part.column(1).to_pylist()


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", places: bool = True) -> DataFrame:
    """(doc_id, ids, decoded) and with ``places`` also (starts, ends): the ids, the bytes they decode to, and where each token lies in the text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in parts:
            for names, texts in _few(batch):
                done = [c.rows(t) for t in texts]
                upto = pa.array(np.cumsum([0, *map(len, done)]), pa.int32())
                flat = np.concatenate([np.zeros((0, 3), np.int32), *done])
                lists = [pa.ListArray.from_arrays(upto, pa.array(np.ascontiguousarray(flat[:, k]))) for k in range(3 if places else 1)]
                back = pa.array([c.decode(d[:, 0].tobytes()) for d in done], pa.binary())
                yield pa.RecordBatch.from_arrays([names, lists[0], back, *lists[1:]], ["doc_id", "ids", "decoded", "starts", "ends"][: len(lists) + 2])
        c.forget()

    base = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return base.mapInArrow(lean(run), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary" + ", starts array<int>, ends array<int>" * places)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, places_sha256): ids, decoded bytes, and the starts and after them the
    ends of all tokens (each a little-endian 32-bit integer), digested where they are made."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        digest = lambda x: pa.array([hashlib.sha256(b).hexdigest() for b in x])
        for batch in parts:
            for names, texts in _few(batch):
                done = [c.rows(t) for t in texts]
                ids = [d[:, 0].tobytes() for d in done]
                back = [c.decode(x) for x in ids]
                cols = [names, pa.array([len(d) for d in done], pa.int64()), digest(ids), digest(back), pa.array([len(b) for b in back], pa.int64()), digest(d[:, 1:].tobytes("F") for d in done)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "places_sha256"])
        c.forget()

    base = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return base.mapInArrow(lean(run), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, places_sha256 string")
