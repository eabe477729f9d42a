"""Language-model scoring by online logistic context mixing.

Bytes are spelled as binary decisions along a Huffman tree (256 bytes and an end) of what follows the byte
before in training, so the product of the decisions' probabilities is the text's. Predictors are tables over hashed
contexts: the latest 3 bytes, the latest 5, and the word so far. A cell, hashed from context and tree node, holds the
logit of the training bits seen there, shrunk to even odds where few were. A mixer sums the logits with weights and a
bias, squashes, and after each decision moves the weights along the coding error. Weights are gated by the
depth in the tree and by whether the latest 5 bytes are known, each with weights of its own; a last refinement scales the mixed logit by
an adaptive gain.

What is learned from training: every (context, symbol) pair of every training text, once-seen ones included, counts in its cells.
Counts are added up by shuffle, in buckets that are ranges of hashed contexts, and each bucket's part of the tables is made where its counts are; only
finished tables come to the driver. Their size follows the number of distinct pairs, up to 2^MOST_BITS cells for each predictor (a documented
bound of the model's memory; beyond it contexts share cells). The mixer's starting weights follow from the same counts: each predictor's share of
the bits that the predictors save on the training bits, every bit left out of its own cell.

Weights and gain adapt over the whole text. A text is cut into segments that begin at content-defined words, and these into pieces of PIECE bytes (contexts
carry over); pieces are read in generations of 1, 8, 64, ... side by side, and a generation starts from the mean of the states in which the one before ended.

The last context is the whole segment before: how often segments followed it in training texts grows with the corpus without a bound, is counted by shuffle
and meets the texts in joins. A segment's probability is the mixture of what followed there (the share of this segment) and of the bit predictors,
weighted by how often something new followed (seen / (seen + distinct)). Being online, a text is not its own past: a training text's own
segments are left out of these counts. So a text that occurs again elsewhere costs far less than one that occurs once.
A score depends on the trained tables and counts alone, on neither partition nor order.

Beside it stands the add-one unigram score over words: its counts are gathered from all training texts,
the HEAD most frequent of them (a fixed number) travel to the scan, the rest meet their words in a join.

Defined cases: null and empty texts are scored as their end alone; a null id hashes as the empty text;
with no training text all logits are 0 and base counts are 0; of equally frequent words the lesser ones travel; repeated rows
repeat, and rows that share an id are texts of their own; a long text costs memory in proportion to its length; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, whole_text, written

#: Predictors: the latest so many bytes; 0 is the word so far.
ORDERS = (3, 5, 0)
#: Contexts of each, as powers of two.
SLOT_BITS = (20, 22, 22)
#: Cells of a table, as powers of two: about CELLS_A_PAIR for every distinct pair of its predictor, between these.
LEAST_BITS, MOST_BITS, CELLS_A_PAIR = 20, 22, 2
SYMBOLS, END, NODES = 257, 256, 256
PIECE, RATE, SHRINK, SCALE = 128, 0.016, 0.4, 12.0
#: One word in so many begins a segment.
SPREAD = 32
#: Pieces of a generation are so many times those of the one before.
GROWTH = 8
#: Step of the last refinement's gain.
REFINE = np.float32(0.0015)
#: Size of the constant input, in the tables' units.
BIAS = np.int8(6)
#: Sum of the starting weights.
START = 1.2
#: The predictor by whose knowledge weights are gated.
GATE = 1
HEAD, FOLDS, OUT = 200_000, 7, 2
#: Distinct words that a worker counts before it passes them on.
_WORDS_HELD = 400_000
#: Bytes of text that a worker holds laid out at a time.
_BATCH = 3 << 19
#: Pairs that a worker merges before it passes them on.
_HELD = 600_000


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == OUT


#: Bits of a branch (byte before and symbol) in a counted key.
_PLACE, _BUCKET_BITS = 17, 10
_C1, _C2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_BLANK = np.zeros(SYMBOLS, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _contexts(data: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Context of every symbol under each predictor, below its slots; ``begin`` is each symbol's first place in its text."""
    n = len(data)
    place = np.arange(n, dtype=np.int32)
    starts = np.flatnonzero(place == begin)
    kept = {}
    acc = np.zeros(n, np.uint32)
    back = np.empty(n, np.uint32)
    for k in range(1, max(ORDERS) + 1):
        back[:k] = 0
        back[k:] = data[:-k]
        # Nothing from before a text's start; what passes a short text's end lies as near to the next one's start.
        for j in range(k):
            back[starts[: np.searchsorted(starts, n - j)] + j] = 0
        acc += back
        acc += np.uint32(k)
        acc *= _C1
        acc ^= acc >> np.uint32(15)
        if k in ORDERS:
            kept[k] = acc.copy()
    # The word so far: a difference of prefix sums of hashed (byte, place in word).
    fresh = np.zeros(n, bool)
    fresh[1:] = _BLANK[data[:-1]]
    fresh[starts] = True
    start = np.maximum.accumulate(np.where(fresh, place, 0))
    inside = (place - start).astype(np.uint32)
    mixed = (data.astype(np.uint32) + np.uint32(1)) * _C1 ^ (inside + np.uint32(1)) * _C2
    mixed ^= mixed >> np.uint32(13)
    mixed *= _C2
    sums = np.zeros(n + 1, np.uint32)
    np.cumsum(mixed, out=sums[1:], dtype=np.uint32)
    word = (sums[:-1] - sums[start]) ^ inside * _C1
    kept[0] = (word ^ word >> np.uint32(16)) * _C1
    return [((kept[k] * _C2) >> np.uint32(32 - bits)).astype(np.int32) for k, bits in zip(ORDERS, SLOT_BITS, strict=True)]


def _cell_base(slot: np.ndarray, slot_bits: int, bits: int) -> np.ndarray:
    """First cell of a context: buckets of slots have ranges of cells, and a context lies in the lower half of its range."""
    wide = bits - _BUCKET_BITS
    low = ((slot.astype(np.uint32) * _C1) >> np.uint32(9)) & np.uint32((1 << wide - 1) - 16)
    low |= (slot >> (slot_bits - _BUCKET_BITS) << wide).astype(np.uint32)
    return low


def _cell_offsets() -> np.ndarray:
    """By node, up to half a range of the least table: sixteen neighbours in the tree share a cache line, their lines lie anywhere."""
    nodes = np.arange(NODES, dtype=np.uint32)
    return (((nodes >> np.uint32(4)) * _C2 >> np.uint32(9)) & np.uint32((1 << LEAST_BITS - _BUCKET_BITS - 1) - 16)) + (nodes & np.uint32(15))


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols with an end after each text, first place of each symbol's text, text of each symbol)."""
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data[ends - 1] = END
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    return data, (ends - sizes).astype(np.int32)[owner], owner


def _runs(column: pa.Array, most: int = _BATCH) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of about that many bytes; only they are Python objects."""
    run, held, start = [], 0, 0
    for at in range(0, len(column), 64):
        run += [t or b"" for t in column.slice(at, 64).cast(pa.binary()).to_pylist()]
        held = sum(map(len, run))
        if held >= most:
            yield start, run
            run, start = [], at + 64
    if run:
        yield start, run


def _branch(data: np.ndarray) -> np.ndarray:
    """Byte before * SYMBOLS + symbol; after an end, and first of all, the byte before is 0."""
    before = np.zeros(len(data), np.int32)
    before[1:] = data[:-1]
    before[before == END] = 0
    before *= np.int32(SYMBOLS)
    before += data
    return before


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse counts of (predictor, slot, byte before and symbol) over one partition's training texts; the last kind is the byte before."""
    found: list[list] = [[] for _ in ORDERS]
    follows = np.zeros(256 * SYMBOLS, np.int64)

    def out(k: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Sorted pairs, packed by bucket: a bucket holds a range of slots, and slots are hashes."""
        if len(keys):
            yield _packed(k, keys, n)

    for batch in parts:
        for _, texts in _runs(batch.column(1), 1 << 20):
            data, begin, _ = _laid(texts)
            place = _branch(data)
            follows += np.bincount(place, minlength=len(follows))
            for k, slots in enumerate(_contexts(data, begin)):
                found[k].append(np.unique(slots.astype(np.int64) << _PLACE | place, return_counts=True))
                if len(found[k]) > 3:
                    found[k] = [_merged(found[k])]
                    if len(found[k][0][0]) > _HELD:
                        yield from out(k, *found[k].pop())
    for k in range(len(ORDERS)):
        if found[k]:
            yield from out(k, *_merged(found[k]))
    keys = np.flatnonzero(follows)
    yield from out(len(ORDERS), keys, follows[keys])


def _begins(data: np.ndarray, within: np.ndarray, latest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where segments begin: at a text's start and at words before which the ``latest`` bytes' hash says so; and their pieces, every PIECE bytes from there."""
    opens = within == 0
    opens[1:] |= _BLANK[data[:-1]] & ~_BLANK[data[1:]] & (latest[1:] % SPREAD == 0) & (data[1:] != END)
    place = np.arange(len(data), dtype=np.int32)
    return opens, (place - np.maximum.accumulate(np.where(opens, place, 0))) % PIECE == 0


def _followed(text: bytes, firsts: list[int]) -> tuple[list[int], list[int]]:
    """Of each segment the hash of the one before (0 at the start), and the hash of both; the last one has the end in it."""
    from xxhash import xxh3_64_intdigest as digest

    before, both, last = [], [], 0
    for a, b in zip(firsts, [*firsts[1:], len(text)], strict=True):
        segment = text[a:b]
        before.append(last)
        both.append(digest(segment + b"\0end" if len(before) == len(firsts) else segment, last))
        last = digest(segment) | 1
    return before, both


def _packed(k: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Sorted pairs as one compressed body a bucket."""
    bucket = keys >> ((_PLACE + SLOT_BITS[k] if k < len(ORDERS) else _PLACE) - _BUCKET_BITS)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    bodies = []
    for a, b in zip(first, [*first[1:], len(keys)], strict=True):
        raw = np.diff(keys[a:b], prepend=0).astype("<i8").tobytes() + n[a:b].astype("<i8").tobytes()
        bodies.append(len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True))
    sizes = np.diff(np.concatenate([first, [len(keys)]]))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), k, np.int32)), pa.array(bucket[first].astype(np.int32)), pa.array(sizes.astype(np.int64)), pa.array(bodies, pa.binary())], ["k", "bucket", "pairs", "body"])


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True)
    both = np.frombuffer(raw, "<i8")
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def _summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up packed pairs, sorted by bucket, one bucket at a time."""
    held, of = [], None
    for batch in parts:
        for at in range(0, batch.num_rows, 64):
            for k, bucket, body in zip(*(c.to_pylist() for c in (batch.slice(at, 64).column(x) for x in ("k", "bucket", "body"))), strict=True):
                if (k, bucket) != of:
                    if held:
                        yield _packed(of[0], *_merged(held))
                    held, of = [], (k, bucket)
                held.append(_unpacked(body))
                if len(held) > 16:
                    held = [_merged(held)]
    if held:
        yield _packed(of[0], *_merged(held))


def _merged(found: list) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([a for a, _ in found])
    order = np.argsort(keys, kind="stable")  # runs that are sorted already are merged
    keys, n = keys[order], np.concatenate([b for _, b in found])[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def tree(frequency: np.ndarray) -> list[list[tuple[int, int]]]:
    """Each symbol's path: (node, bit) from the root, nodes numbered from 0 in order of weight, the root first."""
    heap = [(int(f) * SYMBOLS + 1, s, None) for s, f in enumerate(frequency)]
    heapq.heapify(heap)
    count = len(heap)
    inner = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        inner.append((a, b))
        heapq.heappush(heap, (a[0] + b[0], count, (a, b)))
        count += 1
    paths: list[list[tuple[int, int]]] = [[] for _ in frequency]
    number, todo = 0, [(heap[0], [])]
    while todo:
        (_, s, halves), path = todo.pop(0)
        if halves is None:
            paths[s] = path
            continue
        here, number = number, number + 1
        todo += [(half, [*path, (here, bit)]) for bit, half in enumerate(halves)]
    return paths


def _trees(follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(depth, node, sign) of the trees by previous byte: of each branch, and by depth and branch."""
    paths = [path for row in follows for path in tree(row)]
    depth = np.array([len(p) for p in paths], np.int8)
    node = np.zeros((int(depth.max()), len(paths)), np.uint8)
    sign = np.zeros(node.shape, np.int8)
    for s, path in enumerate(paths):
        for d, (at, bit) in enumerate(path):
            node[d, s], sign[d, s] = at, 1 if bit else -1
    return depth, node, sign


class Model:
    """The trees by previous byte, the tables of logits (int8, SCALE steps to one), where their cells lie, and starting weights."""

    def __init__(self, trees: tuple[np.ndarray, np.ndarray, np.ndarray], tables: list[np.ndarray], bits: list[int], start: list[float]):
        self.depth, self.node, self.sign = trees
        self.tables, self.bits, self.start = tables, bits, start
        self.off = _cell_offsets()
        # A branch's cell and bit at each depth, in one number.
        self.packed = self.off[self.node] << np.uint32(1) | (self.sign > 0).astype(np.uint32)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Natural log of the probability of each text and its end, by the bit predictors alone."""
        owner, _, total = self.segments(texts)
        return np.bincount(owner, weights=total, minlength=len(texts))

    def segments(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each segment of the texts: its text, the first byte in it, and the natural log of its probability; the end is in the last one."""
        data, begin, owner = _laid(texts)
        contexts = _contexts(data, begin)
        within = np.arange(len(data), dtype=np.int32) - begin
        opens, begins = _begins(data, within, contexts[1])
        first = np.flatnonzero(begins)
        opens = np.flatnonzero(opens[first])
        text, firsts = owner[first].astype(np.int64), within[first]
        number = np.arange(len(text)) - np.searchsorted(text, text)
        edges, most = [1], int(number.max())
        while edges[-1] <= most:
            edges.append(edges[-1] * GROWTH + 1)
        generation = np.searchsorted(edges, number, side="right")
        del begin, owner, within
        # Symbols by generation from here on: each is a range of pieces and of symbols.
        order = np.argsort(generation, kind="stable")
        length = np.diff(first, append=len(data))[order]
        start = np.cumsum(length) - length
        moved = np.arange(len(data)) + np.repeat(first[order] - start, length)
        place = _branch(data).take(moved).astype(np.int64)
        bases = [_cell_base(c, slots, bits).take(moved) for c, slots, bits in zip(contexts, SLOT_BITS, self.bits, strict=True)]
        lane = np.repeat(np.arange(len(order)), length)
        ranges = np.searchsorted(generation[order], np.arange(len(edges) + 1))
        symbols = np.append(start, len(data))[ranges]
        del data, contexts, moved
        owner, total = text[order], np.zeros(len(order))
        depth = self.depth.take(place)
        chosen = np.arange(len(place))  # indices are of the machine's own width: others are converted at every use
        for d in range(len(self.node)):
            chosen = chosen[depth.take(chosen) > d]
            if not len(chosen):
                break
            branch = place.take(chosen)
            both = self.packed[d].take(branch)
            off, sign = both >> np.uint32(1), (both & np.uint32(1)).astype(np.int8) * np.int8(2) - np.int8(1)
            inputs = [t.take(b.take(chosen) + off) * sign for t, b in zip(self.tables, bases, strict=True)]
            inputs.append(sign * BIAS)
            here = lane.take(chosen)
            cuts = np.searchsorted(chosen, symbols)
            state = self._begin(len(inputs), len(texts))
            for g, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if a < b:
                    lo, hi = ranges[g], ranges[g + 1]
                    total[lo:hi] += self._generation(here[a:b] - lo, [x[a:b] for x in inputs], owner[lo:hi], state, g + 1 < len(ranges) - 1)
        out = np.empty(len(order))
        out[order] = total
        return text[opens], firsts[opens], np.add.reduceat(out, opens)

    def _begin(self, inputs: int, texts: int) -> list[np.ndarray]:
        """States of each text, of unknown and of known places: weights and gain, in the units of ``_mix``."""
        unit = np.float32(RATE / SCALE**2)
        one = np.empty((inputs + 1, texts), np.float32)
        one[: len(self.start)] = np.array(self.start, np.float32)[:, None] / (SCALE * unit)
        one[-2], one[-1] = 0, -unit
        return [one, one.copy()]

    def _generation(self, lane: np.ndarray, inputs: list[np.ndarray], owner: np.ndarray, state: list[np.ndarray], more: bool) -> np.ndarray:
        """Sums of log p of a generation's pieces. A piece's known and unknown places are lanes of their own; each text carries their states on."""
        lanes = len(owner)
        known = inputs[GATE] != 0
        count = np.bincount(lane, minlength=lanes)
        first = np.cumsum(count) - count
        upto = np.cumsum(known)
        upto -= np.concatenate([[0], upto])[first].take(lane)
        place = np.arange(len(lane)) - first.take(lane)
        place = np.where(known, upto - 1, place - upto)
        sums, ends, times = self._mix(lane + lanes * known, place, inputs, np.concatenate([x.take(owner, axis=1) for x in state], axis=1))
        if more:
            for k, held in enumerate(state):
                half = slice(k * lanes, (k + 1) * lanes)
                on = times[half] > 0
                seen = np.bincount(owner[on], minlength=held.shape[1])
                for row, end in zip(held, ends[:, half], strict=True):
                    mean = np.bincount(owner[on], weights=end[on], minlength=len(row))
                    row[seen > 0] = mean[seen > 0] / seen[seen > 0]
        return sums[:lanes] + sums[lanes:]

    @staticmethod
    def _mix(lane: np.ndarray, place: np.ndarray, inputs: list[np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum of log p over each lane's decisions, by their place, the weights adapting, the states in which they end, and the lanes' lengths. ``inputs`` carry the bit's sign."""
        lanes = start.shape[1]
        length = np.bincount(lane, minlength=lanes)
        by_length = np.argsort(-length, kind="stable")
        rank = np.empty(lanes, np.int64)
        rank[by_length] = np.arange(lanes)
        longest = int(length[by_length[0]])
        active = lanes - np.searchsorted(np.sort(length), np.arange(longest), side="right")
        offset = np.concatenate([[0], np.cumsum(active)])[:-1]
        where = offset.take(place)
        where += rank.take(lane)
        laid = np.empty((len(inputs), len(lane)), np.int8)
        for row, x in zip(laid, inputs, strict=True):
            row[where] = x
        # Inputs are used as they are stored: weights carry RATE, gains the tables' scale, RATE and a sign.
        state = start.take(by_length, axis=1)
        weights, gain = state[:-1], state[-1]
        unit = np.float32(RATE / SCALE**2)
        refine = np.float32(-REFINE * unit * unit)
        out, product = np.zeros(lanes), np.ones(lanes)
        for t, (a, at) in enumerate(zip(active.tolist(), offset.tolist(), strict=True)):
            s = laid[:, at : at + a].astype(np.float32)
            w, g = weights[:, :a], gain[:a]
            z = np.einsum("ka,ka->a", w, s)
            e = z * g
            np.exp(e, out=e)
            odds = e + 1
            product[:a] *= odds  # 1/p of the decisions so far; its logarithm is taken every eight of them
            if t % 8 == 7:
                out -= np.log(product)
                product.fill(1)
            e /= odds  # how far the bit's probability is from 1
            z *= e
            z *= refine
            g += z
            s *= e
            w += s
        out -= np.log(product)
        return out.take(rank), state.take(rank, axis=1), length


def _built(trees: tuple[np.ndarray, np.ndarray, np.ndarray], table_bits: list[int]):
    """Makes each bucket's part of its table, and what its predictor saves there, in nats, of how many."""
    depth, node, sign = trees

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        off = _cell_offsets()
        for batch in parts:
            for at in range(batch.num_rows):
                k, bucket, body = (batch.column(x)[at].as_py() for x in ("k", "bucket", "body"))
                bits = table_bits[k]
                size = 1 << bits - _BUCKET_BITS
                keys, n = _unpacked(body)
                place = keys & ((1 << _PLACE) - 1)
                base = _cell_base((keys >> _PLACE).astype(np.int32), SLOT_BITS[k], bits) & np.uint32(size - 1)
                up, down = np.zeros(size), np.zeros(size)
                for d in range(len(node)):
                    on = np.flatnonzero(depth[place] > d)
                    if not len(on):
                        break
                    cell, s = base[on] + off[node[d][place[on]]], sign[d][place[on]]
                    for to, b in ((up, 1), (down, -1)):
                        to += np.bincount(cell[s == b], weights=n[on][s == b], minlength=size)
                # Each bit left out of its own cell.
                seen = up + down
                rest = np.maximum(seen - 1, 0) + 2 * SHRINK
                nats = sum((x * np.log((np.maximum(x - 1, 0) + SHRINK) / rest)).sum() for x in (up, down))
                logit = np.clip(np.rint(np.log((up + SHRINK) / (down + SHRINK)) * SCALE), -127, 127).astype(np.int8)
                even = seen.sum() * math.log(2)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bucket], pa.int32()), pa.array([logit.tobytes()], pa.binary()), pa.array([nats + even]), pa.array([even])], ["k", "bucket", "part", "saved", "even"])

    return run


def train(docs: DataFrame) -> Model:
    """The model of ``docs(doc_id, text)``: counts over all of them; finished tables alone come to the driver."""
    form = "k int, bucket int, pairs long, body binary"
    counted = docs.mapInArrow(lean(_count), form).repartition("k", "bucket").sortWithinPartitions("k", "bucket")
    merged = written(counted.mapInArrow(lean(_summed), form))
    follows = np.zeros(256 * SYMBOLS, np.int64)
    for body in merged.where(F.col("k") == len(ORDERS)).select("body").toArrow().column("body").to_pylist():
        keys, n = _unpacked(body)
        follows[keys] = n
    trees = _trees(follows.reshape(256, SYMBOLS))
    sizes = {r["k"]: r["pairs"] for r in merged.groupBy("k").agg(F.sum("pairs").alias("pairs")).collect()}
    bits = [min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, sizes.get(k, 0) * CELLS_A_PAIR))))) for k in range(len(ORDERS))]
    tables = [np.zeros(1 << b, np.int8) for b in bits]
    saved, even = np.zeros(len(ORDERS)), np.zeros(len(ORDERS))
    made = merged.where(F.col("k") < len(ORDERS)).mapInArrow(lean(_built(trees, bits)), "k int, bucket int, part binary, saved double, even double").toArrow()
    for batch in made.to_batches():
        for at in range(batch.num_rows):
            k, bucket, part, s, e = (batch.column(x)[at].as_py() for x in range(5))
            wide = bits[k] - _BUCKET_BITS
            tables[k][bucket << wide : bucket + 1 << wide] = np.frombuffer(part, np.int8)
            saved[k] += s
            even[k] += e
    share = np.maximum(saved / np.maximum(even, 1), 0.01)
    return Model(trees, tables, bits, (START * share / share.sum()).tolist())


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words with A-Z lowered: the bytes methods know ASCII alone, and part at the same six blanks."""
    return (text.encode() if isinstance(text, str) else text or b"").lower().split()


def _word_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    batch_of = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["token", "c"])
    for batch in parts:
        for _, texts in _runs(batch.column(1)):
            for t in texts:
                found.update(words_of(t))
            if len(found) > _WORDS_HELD:
                yield batch_of(found)
                found = Counter()
    yield batch_of(found)


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over ``docs(doc_id, text)``, ends left out: counted in each worker, added up by token."""
    return docs.mapInArrow(lean(_word_counts), "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


_SEGMENTS = "array<struct<ctx:long,seg:long,ln_p:double,own_ctx:int,own:int>>"


def _scored(docs: DataFrame, model: Model, top: dict[bytes, int]) -> DataFrame:
    """(doc_id, segments, n_bytes, n, k, gain, rare) in one pass over ``docs(doc_id, text)``: the segments (context, hash with it, the model's ln p, and how often the
    text itself has either), the words, those among ``top`` and their part of the base score, and the others with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast((model, {w: math.log10(c + 1) for w, c in top.items()}))

    def segments(m: Model, texts: list[bytes]) -> pa.Array:
        owner, firsts, ln_p = m.segments(texts)
        edges = np.searchsorted(owner, np.arange(len(texts) + 1))
        firsts = firsts.tolist()
        ctx, seg, own_ctx, own = [], [], [], []
        for text, a, b in zip(texts, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            before, both = _followed(text, firsts[a:b])
            ctx += before
            seg += both
            for mine, out in ((before, own_ctx), (both, own)):
                times = Counter(mine)
                out += map(times.__getitem__, mine) if len(times) < len(mine) else [1] * len(mine)
        long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        each = pa.StructArray.from_arrays([long(ctx), long(seg), pa.array(ln_p), pa.array(own_ctx, pa.int32()), pa.array(own, pa.int32())], ["ctx", "seg", "ln_p", "own_ctx", "own"])
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), each)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, head = shared.value
        of = head.get
        for batch in parts:
            for start, texts in _runs(batch.column(1)):
                n, k, gain, ends, rare, times = [], [], [], [0], [], []
                for t in texts:
                    found = Counter(words_of(t))
                    all_, unknown, gains = found.total(), 0, []
                    for w, c in found.items():
                        if (x := of(w)) is None:
                            unknown += c
                            rare.append(w)
                            times.append(c)
                        else:
                            gains.append(c * x)
                    n.append(all_)
                    k.append(all_ - unknown)
                    gain.append(math.fsum(gains))
                    ends.append(len(rare))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], ["token", "n"]))
                cols = [segments(m, texts), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(gain, pa.float64()), lists]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *cols], ["doc_id", "segments", "n_bytes", "n", "k", "gain", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lean(run, keep=True), f"doc_id {kind}, segments {_SEGMENTS}, n_bytes long, n long, k long, gain double, rare array<struct<token:binary,n:long>>")


def _mixed(scored: DataFrame) -> DataFrame:
    """(row, ln_p) of ``scored(row, held_out, segments)``: each segment's bit predictors mixed with what else followed its context in training texts."""
    each = scored.select("row", "held_out", F.explode_outer("segments").alias("s")).select("row", "held_out", "s.*")
    seen = written(each.where("NOT held_out").groupBy("ctx", "seg").agg(F.count("*").alias("c")))
    follows = written(seen.groupBy("ctx").agg(F.sum("c").alias("all"), F.count("*").alias("kinds")))
    # Every text has the start as a context: one number, not a key of the join.
    begin = follows.where("ctx = 0").first()
    told = each.join(seen, ["ctx", "seg"], "left")
    start = told.where("ctx = 0").withColumn("all", F.lit(begin["all"] if begin else 0)).withColumn("kinds", F.lit(begin["kinds"] if begin else 0))
    rest = told.where("ctx <> 0").join(follows.where("ctx <> 0"), "ctx", "left")
    both = start.unionByName(rest)
    mine = lambda c: F.when(F.col("held_out"), F.lit(0)).otherwise(F.col(c))
    c = F.coalesce("c", F.lit(0))
    others = both.select("row", "ln_p", (c - mine("own")).alias("c"), (F.coalesce("all", F.lit(0)) - mine("own_ctx")).alias("all"), (F.coalesce("kinds", F.lit(0)) - F.when(~F.col("held_out") & (c == F.col("own")), 1).otherwise(0)).alias("kinds"))
    weight = F.col("all") / (F.col("all") + F.col("kinds"))
    known = F.when(F.col("c") > 0, F.ln(weight * F.col("c") / F.col("all") + (1 - weight) * F.exp("ln_p"))).otherwise(F.col("ln_p") + F.ln(1 - weight))
    return others.select("row", F.when(F.col("all") > 0, known).otherwise(F.col("ln_p")).alias("ln_p")).groupBy("row").agg(F.sum("ln_p").alias("ln_p"))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte)."""
    base = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    learn = base.where(~held_out(F.col("doc_id")))
    counted = written(word_counts(learn))
    ends = learn.count()
    told = counted.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    # The end is one more token of the training texts, and one more distinct one.
    total, distinct = told["n"] + ends, told["v"] + (ends > 0)
    first = counted.orderBy(F.desc("c"), "token").limit(head).toArrow()
    top = dict(zip(first.column("token").to_pylist(), first.column("c").to_pylist(), strict=True))
    del first
    # The number of a row is written with it: scans of the table may deal its files out differently.
    scored = written(_scored(base, train(learn), top).withColumn("row", F.monotonically_increasing_id())).withColumn("held_out", held_out(F.col("doc_id")))
    each = scored.select("row", F.explode_outer("rare").alias("r")).where("r IS NOT NULL").select("row", "r.token", "r.n")
    met = each.join(counted, "token").groupBy("row").agg(F.sum("n").alias("k2"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("gain2"))
    n = F.col("n") + 1
    end_gain = float(np.log10(ends + 1))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    mixed = _mixed(scored.select("row", "held_out", "segments"))
    return scored.drop("rare", "segments").join(met, "row", "left").join(mixed, "row").select(
        "doc_id",
        "held_out",
        n.cast("long").alias("n_tokens"),
        (F.col("k") + zero("k2") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("gain") + zero("gain2") + end_gain - n * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
        (F.col("ln_p") / float(np.log(10))).alias("score"),
        "n_bytes",
        (-F.col("ln_p") / float(np.log(2)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
