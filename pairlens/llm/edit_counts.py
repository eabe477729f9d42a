"""Edit-aware token counts.

A text is cut into pre-tokens; runs of them with their token counts are the leaves of a segment tree of subtree sums. An
edit (start, end, new text) re-cuts only from the last cut that the edit cannot have moved up to the
first old cut that comes back after it, re-encodes those pre-tokens and replaces the leaves; only sums
above them change. Runs are laid out half full, so that most edits change one run; a run that overflows is spread over the
least subtree around it that is at most FILL full, and only a text whose whole tree is fuller is laid out anew. Cutting reads at
most LOOK characters past a pre-token, so a restart that far before the edit is safe.

``trees`` gives the pre-tokens and counts of every text as a table, and ``edited`` applies a table of edits to such a table: texts come
back from their leaves, and nothing that the edits do not touch is cut or encoded again.

The registered query edits each text with a script that follows from its id (an insertion, a deletion and a
replacement), and returns counts before and after.

Defined cases: a null or empty text has no pre-tokens; an edit past the end appends; overlapping edits
apply one after the other, those of ``edited`` by their number and then by start, end and text; a null id edits as 0 and an id that is no
integer as its crc32; repeated rows repeat, and each gets the edits of its id; a long text costs memory in proportion to its length; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import _few, read_ranks
from .common import lean, whole_text

LOOK, REMEMBERED, LEAF = 2, 300_000, 64
#: A subtree takes pre-tokens over from an overflowing run up to this share of its room.
FILL = 0.75


class Counter:
    """Tokens of a pre-token, remembered for at most so many of them."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        self.find = regex.compile(pattern)
        self._encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={}).encode_ordinary
        self._known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        out = [known.get(p) for p in pieces]
        if None in out:
            for k, n in enumerate(out):
                if n is None:
                    p = pieces[k]
                    n = known.get(p)
                    if n is None:
                        n = known[p] = len(self._encode(p))
                    out[k] = n
        return out


class Tree:
    """Subtree sums over a power of two of runs of at most LEAF pre-tokens: each run keeps its pre-tokens and counts, and the levels
    above hold sums of pairs. ``replace`` swaps pre-tokens and renews the sums on the paths above."""

    def __init__(self, pieces: list[str], counts: list[int]):
        self.laid, self.changed = 0, 0
        self._lay(pieces, counts)

    def _lay(self, pieces: list[str], counts: list[int]) -> None:
        runs = 1
        while runs * LEAF < 2 * len(pieces):
            runs *= 2
        self.laid += 1
        self.runs = self._spread(pieces, counts, runs)
        self.sums = [[sum(c) for _, c in self.runs]]
        self.sizes = [[sum(map(len, p)) for p, _ in self.runs]]
        for levels in (self.sums, self.sizes):
            while len(levels[-1]) > 1:
                low = levels[-1]
                levels.append([low[i] + low[i + 1] for i in range(0, len(low), 2)])

    @staticmethod
    def _spread(pieces: list[str], counts: list[int], runs: int) -> list[tuple[list[str], list[int]]]:
        edges = [len(pieces) * k // runs for k in range(runs + 1)]
        return [(pieces[a:b], counts[a:b]) for a, b in zip(edges, edges[1:], strict=False)]

    @property
    def total(self) -> int:
        return self.sums[-1][0]

    @property
    def length(self) -> int:
        return self.sizes[-1][0]

    def locate(self, place: int) -> tuple[int, int]:
        """(run, its first character) that holds the character at ``place``; the last run beyond the end."""
        k, base = 0, 0
        for level in range(len(self.sizes) - 1, 0, -1):
            k *= 2
            left = self.sizes[level - 1][k]
            if place >= base + left and k + 1 < len(self.sizes[level - 1]):
                base, k = base + left, k + 1
        return k, base

    def replace(self, first: int, last: int, pieces: list[str], counts: list[int]) -> None:
        """Runs first..last hold these pre-tokens from now on."""
        lo, hi, room, level = first, last, (last - first + 1) * LEAF, 0
        while len(pieces) > room:  # the next larger subtree takes them
            if hi - lo + 1 == len(self.runs):
                return self._lay(pieces, counts)
            level += 1
            low, high = lo >> level << level, (hi >> level << level) + (1 << level) - 1
            before, after = self.runs[low:lo], self.runs[hi + 1 : high + 1]
            pieces = [x for r in before for x in r[0]] + pieces + [x for r in after for x in r[0]]
            counts = [x for r in before for x in r[1]] + counts + [x for r in after for x in r[1]]
            lo, hi, room = low, high, int((high - low + 1) * LEAF * FILL)
        new = self._spread(pieces, counts, hi - lo + 1)
        self.changed += len(new)
        self.runs[lo : hi + 1] = new
        for levels, of in ((self.sums, lambda r: sum(r[1])), (self.sizes, lambda r: sum(map(len, r[0])))):
            levels[0][lo : hi + 1] = map(of, new)
            a, b = lo, hi
            for level in range(1, len(levels)):
                a, b = a // 2, b // 2
                for k in range(a, b + 1):
                    levels[level][k] = levels[level - 1][2 * k] + levels[level - 1][2 * k + 1]


class Document:
    def __init__(self, text: str, counter: Counter, tree: Tree | None = None):
        """``tree``: that of the text, where it is known; nothing is cut or encoded then."""
        self.text, self.counter, self.reencoded = text, counter, 0
        if tree is None:
            pieces = counter.find.findall(text)
            tree = Tree(pieces, counter.counts(pieces))
        self.tree = tree

    def leaves(self) -> tuple[list[str], list[int]]:
        return [p for run, _ in self.tree.runs for p in run], [n for _, run in self.tree.runs for n in run]

    def edit(self, start: int, end: int, new: str) -> None:
        """Puts ``new`` in place of the characters from start to end."""
        start, end = min(max(start, 0), len(self.text)), min(max(start, end, 0), len(self.text))
        shift = len(new) - (end - start)
        run, base = self.tree.locate(max(0, start - LOOK - 1))
        while True:
            # Back to a cut that the edit cannot have moved: the first of a piece that ends LOOK before it.
            held = self.tree.runs[run][0]
            ends, at = [], base
            for p in held:
                at += len(p)
                ends.append(at)
            keep = max(0, bisect_right(ends, start - LOOK) - 1)
            if keep or not run:
                break
            run -= 1
            base -= self.tree.sizes[0][run]
        before, head = ends[keep - 1] if keep else base, held[:keep]
        text = self.text = self.text[:start] + new + self.text[end:]
        # Old cuts from the edit's end on, shifted, by run as they are needed.
        last, upto = run, base + self.tree.sizes[0][run]
        old: dict[int, tuple[int, int]] = {}

        def learn(r: int, begin: int) -> None:
            at = begin
            for k, p in enumerate(self.tree.runs[r][0]):
                if at >= end:
                    old[at + shift] = (r, k)
                at += len(p)

        learn(run, base)
        pieces, at, meet = [], before, None
        for m in self.counter.find.finditer(text, before):
            while m.start() - shift >= upto and last + 1 < len(self.tree.runs):
                last += 1
                learn(last, upto)
                upto += self.tree.sizes[0][last]
            if m.start() >= start + len(new) and m.start() in old:
                meet = old[m.start()]
                break
            pieces.append(m[0])
            at = m.end()
        counts = self.counter.counts(pieces)
        self.reencoded += len(pieces)
        head_counts = self.tree.runs[run][1][: len(head)]
        if meet is None:
            last, tail, tail_counts = len(self.tree.runs) - 1, [], []
        else:
            last, k = meet
            tail, tail_counts = self.tree.runs[last][0][k:], self.tree.runs[last][1][k:]
        self.tree.replace(run, last, head + pieces + tail, head_counts + counts + tail_counts)


def script(doc_id, length: int) -> list[tuple[int, int, str]]:
    """The edits of the query: an insertion, a deletion and a replacement, at places that follow from the id."""
    k = (doc_id if isinstance(doc_id, int) else zlib.crc32(str(doc_id).encode()) if doc_id is not None else 0) % 1_000_003
    spot = lambda n: (k * 7919 + n * 104729) % (length + 1)
    return [(spot(1), spot(1), f" note {k},"), (spot(2), spot(2) + 5, ""), (spot(3), spot(3) + 3, "ab\n ")]


def counts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits=script) -> DataFrame:
    """(doc_id, n_tokens, n_pieces, n_edits, n_reencoded, n_tokens_after): before and after the edits."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, pattern)
        for batch in parts:
            for names, texts in _few(batch):
                rows = []
                for i, text in zip(names.to_pylist(), texts, strict=True):
                    d = Document(text, counter)
                    n, pieces, todo = d.tree.total, sum(len(p) for p, _ in d.tree.runs), edits(i, len(text))
                    for e in todo:
                        d.edit(*e)
                    rows.append((n, pieces, len(todo), d.reencoded, d.tree.total))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([names, *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n_tokens", "n_pieces", "n_edits", "n_reencoded", "n_tokens_after"])

    base = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return base.mapInArrow(lean(run), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_pieces long, n_edits long, n_reencoded long, n_tokens_after long")


_LEAVES = "pieces array<string>, counts array<long>, n_tokens long, n_reencoded long"


def _kept(names: pa.Array, done: list[Document]) -> pa.RecordBatch:
    pieces, counted = zip(*(d.leaves() for d in done), strict=True) if done else ((), ())
    cols = [pa.array(pieces, pa.list_(pa.string())), pa.array(counted, pa.list_(pa.int64())), pa.array([d.tree.total for d in done], pa.int64()), pa.array([d.reencoded for d in done], pa.int64())]
    return pa.RecordBatch.from_arrays([names, *cols], ["doc_id", "pieces", "counts", "n_tokens", "n_reencoded"])


def trees(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pieces, counts, n_tokens, n_reencoded = 0): the leaves of every text's tree, to be written and edited later."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, pattern)
        for batch in parts:
            for names, texts in _few(batch):
                yield _kept(names, [Document(t, counter) for t in texts])

    base = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return base.mapInArrow(lean(run), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, {_LEAVES}")


def edited(known: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """``trees`` after ``edits(doc_id, k, start, end, text)``, in the order of k; n_reencoded counts the pre-tokens that were encoded."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, pattern)
        for batch in parts:
            for at in range(0, batch.num_rows, 64):
                names, pieces, counted, todo = batch.slice(at, 64).columns
                done = []
                for p, n, es in zip(pieces.to_pylist(), counted.to_pylist(), todo.to_pylist(), strict=True):
                    d = Document("".join(p), counter, Tree(p, n))
                    for e in es or []:
                        d.edit(e["start"], e["end"], e["text"] or "")
                    done.append(d)
                yield _kept(names, done)

    asked = edits.groupBy(F.col("doc_id").alias("of")).agg(F.sort_array(F.collect_list(F.struct("k", "start", "end", "text"))).alias("todo"))
    both = known.join(asked, F.col("doc_id") == F.col("of"), "left").select("doc_id", "pieces", "counts", "todo")
    return both.mapInArrow(lean(run), f"doc_id {both.schema['doc_id'].dataType.simpleString()}, {_LEAVES}")
