"""The other operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import byte_bpe, context_mixing, edit_counts, ngram_join, pairwise_rank
from pairlens.llm.common import connected
from pairlens.llm.queries import tokenizer
from tests.llm.test_native import docs

ODD = [None, "", " ", "a", "hello  world\n\n  x", "‮ \x00 é́ 🤗🤗 日本語", "<|endoftext|> 's I'll don't", "\t\t\n", "aaaa" * 40, "=-" * 33, "\r\n\r\n  \r\n", "x" * 3000]


def words(rng, n, k=500):
    return [f"wort{rng.randrange(k)}" for _ in range(n)]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    path, pattern = tokenizer()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


def test_bpe_digests_and_round_trip(spark, reference):
    rng = random.Random(1)
    rows = list(enumerate([*ODD, *("".join(rng.choice("aé🤗 \n日b") for _ in range(50)) for _ in range(30))]))
    got = {r["doc_id"]: r for r in byte_bpe.digests(docs(spark, [*rows, (None, "a"), (3, "a")]), *tokenizer()).collect()}
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.digests(docs(spark, []), *tokenizer()).count() == 0


def test_bpe_places(spark, reference):
    rows = list(enumerate(ODD))
    table = {v: k for k, v in byte_bpe.read_ranks(tokenizer()[0]).items()}
    for r in byte_bpe.encode(docs(spark, rows), *tokenizer()).collect():
        text = ODD[r["doc_id"]] or ""
        assert r["ids"] == reference.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
        for k, a, b in zip(r["ids"], r["starts"], r["ends"], strict=True):
            assert table[k] in text[a:b].encode() and b <= len(text)


def test_bpe_digests_and_stage_give_places(spark, reference):
    import corpus_pipeline

    table = {v: k for k, v in byte_bpe.read_ranks(tokenizer()[0]).items()}
    rng = random.Random(8)
    rows = list(enumerate([*ODD, *("".join(rng.choice("ab é🤗日\n") for _ in range(n)) for n in (3, 400, 9000)), "word " * 300_000, "z"]))
    want = {}
    for i, t in rows:
        of, at, starts, ends = [k for k, ch in enumerate(t or "") for _ in ch.encode()], 0, [], []
        for x in reference.encode_ordinary(t or ""):
            starts.append(of[at])
            at += len(table[x])
            ends.append(of[at - 1] + 1)
        want[i] = starts, ends
    got = {r["doc_id"]: r["places_sha256"] for r in byte_bpe.digests(docs(spark, rows), *tokenizer()).collect()}
    assert got == {i: hashlib.sha256(np.array([*a, *b], "<i4").tobytes()).hexdigest() for i, (a, b) in want.items()}
    assert {r["doc_id"]: (r["starts"], r["ends"]) for r in corpus_pipeline.tokens(spark, docs(spark, rows), "").collect()} == want
    gaps = byte_bpe.Coder(tokenizer()[0], r"\w+")
    assert gaps.ids_and_places(" a, é ")[1:] == ([1, 4], [2, 5])


def test_edit_counts_match_full_encoding(spark, reference):
    rng = random.Random(7)
    path, pattern = tokenizer()
    counter = edit_counts.Counter(path, pattern)
    alphabet = ["word", " ", "  ", "\n", "é", "'s", "12", "!?", "\t ", " x", "ing"]
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 900)))
        d = edit_counts.Document(text, counter)
        assert d.tree.total == len(reference.encode_ordinary(text))
        for _ in range(6):
            a = rng.randrange(0, len(text) + 3)
            b, new = a + rng.choice([0, 0, 1, 3, 40]), "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 4, 90])))
            s, e = min(a, len(text)), min(b, len(text))
            text = text[:s] + new + text[e:]
            d.edit(a, b, new)
            assert d.text == text and d.tree.length == len(text)
            assert d.tree.total == len(reference.encode_ordinary(text)), text
            assert [p for run, _ in d.tree.runs for p in run] == counter.find.findall(text)


def test_edits_change_few_runs():
    rng = random.Random(17)
    counter = edit_counts.Counter(*tokenizer())
    d = edit_counts.Document(" ".join(words(rng, 20_000)), counter)
    for _ in range(2000):
        a = rng.randrange(len(d.text))
        d.edit(a, a + rng.choice([0, 0, 4]), rng.choice(["x", " word", "", " two words", "\n\n", " and a longer passage of words"]))
    assert d.tree.laid == 1 and d.tree.changed < 3 * 2000 and d.reencoded < 20 * 2000
    spot = len(d.text) // 2
    for _ in range(3000):  # all at one place
        d.edit(spot, spot, " grows")
    pieces = counter.find.findall(d.text)
    assert d.leaves() == (pieces, counter.counts(pieces)) and d.tree.laid <= 2 and d.tree.changed < 12 * 5000


def test_stored_trees_are_edited(spark, reference):
    rng = random.Random(18)
    rows = [*enumerate([*ODD, *(" ".join(words(rng, 3000)) for _ in range(3))]), (None, "a b"), (3, "again 3")]
    at = edit_counts.trees(docs(spark, rows), *tokenizer())
    edits = [(i, k, rng.randrange(0, 9000), 0, rng.choice([" neu", "s", "\n"])) for i in sorted({i for i, _ in rows if i is not None}) for k in range(3)]
    edits = [(i, k, a, a + rng.choice([0, 0, 7]), t) for i, k, a, _, t in edits]
    got = edit_counts.edited(at, spark.createDataFrame([*edits, (77, 0, 0, 0, "x")], "doc_id long, k int, start int, end int, text string"), *tokenizer()).collect()
    want = []
    for i, t in rows:
        t = t or ""
        for j, _, a, b, new in edits:
            if j == i:
                t = t[: min(a, len(t))] + new + t[min(b, len(t)) :]
        want.append((i or -1, t))
    dedup = sorted({(i, t) for i, t in want})
    assert sorted({((r["doc_id"] or -1), "".join(r["pieces"])) for r in got}) == dedup and len(got) == len(rows)
    for r in got:
        assert r["n_tokens"] == sum(r["counts"]) == len(reference.encode_ordinary("".join(r["pieces"])))
        assert len(r["pieces"]) < 1000 or r["n_reencoded"] < 60
    assert edit_counts.edited(at.limit(0), spark.createDataFrame([], "doc_id long, k int, start int, end int, text string"), *tokenizer()).count() == 0


def test_edit_query_of_string_ids_and_very_long_texts(spark, reference):
    rows = [("a", "word " * 200_000), ("b", "x" * 100_000), (None, None)]
    for r in edit_counts.counts(spark.createDataFrame(rows, "doc_id string, text string"), *tokenizer()).collect():
        text = after = dict(rows)[r["doc_id"]] or ""
        for a, b, new in edit_counts.script(r["doc_id"], len(text)):
            after = after[: min(a, len(after))] + new + after[min(b, len(after)) :]
        assert (r["n_tokens"], r["n_tokens_after"]) == (len(reference.encode_ordinary(text)), len(reference.encode_ordinary(after)))


def test_edit_query(spark, reference):
    rows = list(enumerate([*ODD, "some text " * 400]))
    for r in edit_counts.counts(docs(spark, [*rows, (None, "a")]), *tokenizer()).collect():
        text = dict(rows).get(r["doc_id"], "a") or ""
        after = text
        for a, b, new in edit_counts.script(r["doc_id"], len(text)):
            after = after[: min(a, len(after))] + new + after[min(b, len(after)) :]
        assert (r["n_tokens"], r["n_tokens_after"]) == (len(reference.encode_ordinary(text)), len(reference.encode_ordinary(after)))
        assert len(text) < 1000 or "some" not in text or r["n_reencoded"] < 60


def brute_shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_shingles_are_sets_of_five_words():
    rng = random.Random(2)
    texts = [" ".join(words(rng, n, 4)) for n in (0, 1, 3, 4, 5, 6, 40, 0, 9)] + ["  a\tb\n c ", "é ü ß x y z"]
    h, owner = ngram_join.shingles([t.encode() for t in texts])
    seen = {}
    for k, t in enumerate(texts):
        mine = set(h[owner == k].tolist())
        assert len(mine) == len(brute_shingles(t))
        for s in brute_shingles(t):
            seen.setdefault(s, mine).intersection_update(mine)
    assert all(seen.values())


def families(rng):
    out = []
    for _ in range(12):
        base = words(rng, rng.randrange(30, 120))
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = "neu"
            out.append(" ".join(w))
    return out


def test_join_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    chain = [words(rng, 200)]
    for _ in range(40):  # a chain of near copies, more than a block
        chain.append([*chain[-1][:-1], "x"] if rng.random() < 0.1 else [w if k != (len(chain) * 5) % 200 else f"c{len(chain)}" for k, w in enumerate(chain[-1])])
    texts = [*families(rng), *(" ".join(w) for w in chain), "", None, "one two", "one  two", "same short text", "same short text"]
    rows = list(enumerate(texts)) + [(None, texts[0]), (1000, texts[5]), (1001, texts[5])]
    sets = {}
    for _, t in rows:
        sets.setdefault(t or "", brute_shingles(t))
    names = list(sets)
    links, root = Counter(), {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        if i is not None:
            least[find(t or "")] = min(i, least.get(find(t or ""), i))
    copies = Counter(t or "" for _, t in rows)
    for block in (200, 7):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        got = ngram_join.classes(docs(spark, rows), recall=0.99999).collect()
        assert len(got) == len(rows)
        by_id = {i: t or "" for i, t in rows if i is not None}
        for r in got:
            if r["doc_id"] is not None:
                t = by_id[r["doc_id"]]
                assert (r["class_id"], r["n_links"], r["n_copies"]) == (least[find(t)], links[t], copies[t]), (block, t[:60])
    kept = [r["doc_id"] for r in ngram_join.one_of_each(docs(spark, rows), recall=0.99999).collect()]
    assert sorted(kept) == sorted(least.values())
    assert ngram_join.classes(docs(spark, [])).count() == 0 == ngram_join.one_of_each(docs(spark, [])).count()


def test_join_of_repeated_null_and_string_ids(spark):
    rng = random.Random(14)
    a, b = words(rng, 120), words(rng, 120)
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (2, near(a)), (3, " ".join(b)), (2, near(b)), (2, near(b)), (None, "lone text of five words"), (None, "lone text of five words"), (None, near(a))]
    got = sorted((r["doc_id"] or -1, r["class_id"] or -1, r["n_links"], r["n_copies"]) for r in ngram_join.classes(docs(spark, rows)).collect())
    assert got == sorted([(1, 1, 1, 1), (2, 1, 1, 2), (3, 2, 1, 1), (2, 2, 1, 2), (2, 2, 1, 2), (-1, -1, 0, 2), (-1, -1, 0, 2), (-1, 1, 1, 2)])
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in ngram_join.one_of_each(docs(spark, rows)).collect())
    assert kept == sorted([(1, " ".join(a)), (2, near(b)), (-1, "lone text of five words")])
    named = spark.createDataFrame([("y", " ".join(a)), ("x", near(a)), ("z", None)], "doc_id string, text string")
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.classes(named).collect()) == [("x", "x", 1), ("y", "x", 1), ("z", "z", 0)]


def test_recall_of_the_shipped_bands():
    """Pairs of known similarity of 0.8 or more share a band in the setting that the queries use."""
    import pyarrow as pa

    rng = random.Random(21)
    texts, want = [], 0
    while want < 1500:
        w = words(rng, rng.randrange(40, 160), 4000)
        v = list(w)
        for _ in range(rng.randrange(1, 1 + len(w) // 40)):
            v[rng.randrange(len(v))] = "neu"
        x, y = brute_shingles(" ".join(w)), brute_shingles(" ".join(v))
        if 0.8 <= len(x & y) / len(x | y) < 1:
            texts += [" ".join(w), " ".join(v)]
            want += 1
    sign = ngram_join._signer(*ngram_join.bands_for())
    bands = [b for part in sign(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])])) for b in part.column("bands").to_pylist()]
    met = sum(not set(bands[k]).isdisjoint(bands[k + 1]) for k in range(0, len(texts), 2))
    assert met >= 0.99 * want


def test_join_of_very_long_texts_and_bytes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 200_000)
    rng = random.Random(22)
    w = words(rng, 60_000, 9000)
    rows = [(k, " ".join([*w[: 59_990 - 700 * k], f"end{k}"])) for k in range(4)] + [(9, " ".join(w[::-1]))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.classes(docs(spark, rows)).collect()}
    assert got == {0: (0, 3), 1: (0, 3), 2: (0, 3), 3: (0, 3), 9: (9, 0)}


def test_bands_reach_the_recall():
    b, r = ngram_join.bands_for(0.8, 0.995)
    assert 1 - (1 - 0.8**r) ** b >= 0.995 > 1 - (1 - 0.8**r) ** (b - 1)


def test_connected(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 540)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_context_mixing_base_is_exact(spark):
    rng = random.Random(8)
    texts = [*(" ".join(words(rng, rng.randrange(0, 60), 40)).title() for _ in range(60)), None, "", "ÄÖ Tab\tß"]
    rows = list(enumerate(texts))
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in (t or ""))
    toks = lambda t: [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low(t)) if w]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter()
    for i, t in rows:
        if not out(i):
            count.update([*toks(t), None])
    total, distinct = sum(count.values()), len(count)
    for head in (context_mixing.HEAD, 3):
        got = {r["doc_id"]: r for r in context_mixing.scores(docs(spark, rows), head=head).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            w = [*toks(t), None]
            r = got[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(i), len(w), sum(count[x] > 0 for x in w), total)
            assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w))
            assert r["score"] < 0 and r["n_bytes"] == len((t or "").encode())


def test_context_mixing_is_a_distribution_and_learns(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, 80, 30))) for i in range(80)]
    model = context_mixing.train(docs(spark, rows).select("doc_id", "text"))
    texts = [t.encode() for _, t in rows]
    assert -model.score(texts).sum() / math.log(2) / sum(map(len, texts)) < 3
    together, apart = model.score(texts), np.concatenate([model.score([t]) for t in texts])
    assert np.allclose(together, apart, rtol=1e-4)
    # Over every symbol after a text, the probabilities add up to one.
    for prefix in (b"wort1", b"", b"wort12 w"):
        assert sum(math.exp(first_decisions(model, prefix, b)) for b in [*range(256), context_mixing.END]) == pytest.approx(1, abs=1e-3)
    assert sum(model.start) == pytest.approx(context_mixing.START) and min(model.start) > 0


def logits(model, symbols, at):
    """(depth, known, input logits with the bit's sign) of the decisions that spell the symbol at that place."""
    cm = context_mixing
    slots = [c[at] for c in cm._contexts(symbols, np.zeros(len(symbols), np.int32))]
    before = int(symbols[at - 1]) if at else 0
    place = before * cm.SYMBOLS + int(symbols[at])
    for d in range(model.depth[place]):
        node, sign = int(model.node[d, place]), int(model.sign[d, place])
        raw = []
        for k, (table, slot) in enumerate(zip(model.tables, slots, strict=True)):
            base = int(cm._cell_base(np.array([slot], np.int32), cm.SLOT_BITS[k], model.bits[k])[0])
            raw.append(int(table[base + int(model.off[node])]) * sign / cm.SCALE)
        yield d, raw[cm.GATE] != 0, [*raw, sign * int(cm.BIAS) / cm.SCALE]


def first_decisions(model, prefix, symbol):
    """ln p of a symbol by the starting weights."""
    symbols = np.array([*prefix, symbol], np.uint16)
    return -sum(math.log1p(math.exp(-sum(w * x for w, x in zip(model.start, xs, strict=False)))) for _, _, xs in logits(model, symbols, len(prefix)))


def plain_score(model, text):
    """Bit by bit, in plain Python: generations of segments, each from the mean of the states before."""
    cm = context_mixing
    symbols = np.array([*text, cm.END], np.uint16)
    latest = cm._contexts(symbols, np.zeros(len(symbols), np.int32))[1]
    found, number, begin = {}, -1, 0
    for at in range(len(symbols)):
        word = at and symbols[at] != cm.END and bytes([symbols[at - 1]]).isspace() and not bytes([symbols[at]]).isspace()
        if not at or word and latest[at] % cm.SPREAD == 0:
            number, begin = number + 1, at
        elif (at - begin) % cm.PIECE == 0:
            number += 1
        for d, known, xs in logits(model, symbols, at):
            found.setdefault((d, known), []).append((number, xs))
    total = 0.0
    for decisions in found.values():
        state, begin, size = [*model.start, 0.0, 1.0], 0, 1
        while begin <= decisions[-1][0]:
            ends = []
            for segment in range(begin, begin + size):
                mine = [xs for k, xs in decisions if k == segment]
                if mine:
                    now = list(state)
                    for xs in mine:
                        z = sum(w * x for w, x in zip(now, xs, strict=False))
                        miss = 1 / (1 + math.exp(z * now[-1]))
                        total += math.log(1 - miss)
                        now[-1] += float(cm.REFINE) * z * miss
                        for k, x in enumerate(xs):
                            now[k] += cm.RATE * x * miss
                    ends.append(now)
            if ends:
                state = [sum(x) / len(ends) for x in zip(*ends, strict=True)]
            begin, size = begin + size, size * cm.GROWTH
    return total


def test_context_mixing_score_is_the_plain_one(spark, monkeypatch):
    rng = random.Random(26)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 60), 30))) for i in range(60)]
    model = context_mixing.train(docs(spark, rows).select("doc_id", "text"))
    monkeypatch.setattr(context_mixing, "PIECE", 40)
    texts = [b"", b"w", "Äö ß\nneu".encode(), *(t.encode() for _, t in rows[:8]), " ".join(words(rng, 300, 60)).encode(), bytes(range(256)) * 2]
    for got, text in zip(model.score(texts), texts, strict=True):
        assert got == pytest.approx(plain_score(model, text), rel=2e-3, abs=2e-3), text


def test_context_mixing_counts_every_pair(spark, monkeypatch):
    """Tables made in buckets, of all pairs, equal those of one count over all texts; texts seen twice score better than those seen once."""
    cm = context_mixing
    rng = random.Random(27)
    fresh = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(60))
    once, twice = [fresh() for _ in range(30)], [fresh() for _ in range(30)]
    rows = list(enumerate([*once, *twice, *twice]))
    model = cm.train(docs(spark, rows).repartition(3).select("doc_id", "text"))
    up, down = [[np.zeros(len(t)) for t in model.tables] for _ in range(2)]
    for _, text in rows:
        data, begin, _ = cm._laid([text.encode()])
        branch = cm._branch(data)
        for k, slots in enumerate(cm._contexts(data, begin)):
            base = cm._cell_base(slots, cm.SLOT_BITS[k], model.bits[k])
            for x, p in zip(base.tolist(), branch.tolist(), strict=True):
                for d in range(model.depth[p]):
                    (up if model.sign[d, p] > 0 else down)[k][x + int(model.off[model.node[d, p]])] += 1
    for k, table in enumerate(model.tables):
        want = np.clip(np.rint(np.log((up[k] + cm.SHRINK) / (down[k] + cm.SHRINK)) * cm.SCALE), -127, 127)
        assert np.array_equal(table, want)
    a, b, c = (np.median(model.score([t.encode() for t in x]) / [len(t) for t in x]) for x in (once, twice, [fresh() for _ in range(30)]))
    assert c < a < b


def test_context_mixing_remembers_what_followed(spark):
    """The score is the segments' mixture with what followed in other training texts, counted here by hand."""
    cm = context_mixing
    rng = random.Random(29)
    text = lambda n: " ".join(words(rng, n, 5000))
    once, twice = [text(rng.randrange(5, 300)) for _ in range(40)], [text(rng.randrange(5, 300)) for _ in range(10)]
    half = twice[0][: len(twice[0]) // 2] + text(50)
    rows = list(enumerate([*once, *twice, *twice, half, None, "", once[0] + " " + once[0], "same same " * 200]))
    base = docs(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    model = cm.train(base.where(~cm.held_out(F.col("doc_id"))))
    segments = {i: (cm._followed((t or "").encode(), m[1].tolist()), m[2].tolist()) for i, t in rows for m in [model.segments([(t or "").encode()])]}
    train = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2}
    got = {r["doc_id"]: r for r in cm.scores(docs(spark, rows)).collect()}
    for i, t in rows:
        others = [x for j in train - {i} for x in zip(*segments[j][0], strict=True)]
        pairs, all_, total = Counter(others), Counter(c for c, _ in others), 0.0
        kinds = Counter(c for c, _ in pairs)
        # A text that repeats a segment that no other has leaves out one kind for it, as the operator does.
        for (ctx, seg), ln_p in zip(zip(*segments[i][0], strict=True), segments[i][1], strict=True):
            own = len({y for x, y in zip(*segments[i][0], strict=True) if x == ctx and (x, y) not in pairs}) - ((ctx, seg) not in pairs) if i in train else 0
            w = all_[ctx] / (all_[ctx] + kinds[ctx] + own) if all_[ctx] else 0
            p = w * pairs[ctx, seg] / all_[ctx] if pairs[ctx, seg] else 0
            total += math.log(p + (1 - w) * math.exp(ln_p)) if p else ln_p + math.log(1 - w)
        assert got[i]["score"] == pytest.approx(total / math.log(10), rel=1e-3), (i, t)
    bits = lambda x: np.mean([r["bits_per_byte"] for i, r in got.items() if rows[i][1] in x and len(rows[i][1]) > 400])
    assert bits(twice) < 0.5 * bits(once[1:])


def test_context_mixing_of_very_long_texts(spark):
    rng = random.Random(28)
    learnt = next(i for i in range(20, 99) if zlib.crc32(str(i).encode()) % 7 != 2)
    rows = [(0, " ".join(words(rng, 20_000))), (learnt, "x" * 300_000), *((i, " ".join(words(rng, 20))) for i in range(2, 12)), (3, "again"), (None, "no id")]
    got = context_mixing.scores(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["score"] < 0 for r in got)
    assert next(r["bits_per_byte"] for r in got if r["n_bytes"] == 300_000) < 0.2
    none = context_mixing.scores(docs(spark, [(2, "only held out")]).where("false")).count()
    assert none == 0


def test_pairwise_rank(spark):
    rng = random.Random(10)
    good = [(i, " ".join(words(rng, 60))) for i in range(0, 120)]
    bad = [(i, " ".join(w + "***" for w in words(rng, 60))) for i in range(120, 160)]
    rows = [*good, *bad, (500, None), (501, ""), (None, "a b")]
    labels = spark.createDataFrame([(i, int(i < 120), "x") for i, _ in [*good, *bad]] + [(700, None, "x"), (None, 1, "x")], "doc_id long, quality int, h string")
    got = {r["doc_id"]: r for r in pairwise_rank.score(docs(spark, rows), labels).collect()}
    assert len(got) == len(rows)
    for i, _ in [*good, *bad]:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i]["predicted"] == int(i < 120) == int(got[i]["score"] >= 0.3)
    none = pairwise_rank.score(docs(spark, rows), labels.where("quality = 1"))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert pairwise_rank.score(docs(spark, []), labels).count() == 0


def test_fit_is_the_least_loss_and_its_quantile():
    """Against plain gradient descent on the same differences."""
    rng = np.random.default_rng(4)
    x = rng.random((300, 3))
    y = (x @ [2.0, -1.0, 0.5] + rng.normal(0, 0.3, 300) > 0.5).astype(int)
    w, threshold = pairwise_rank.fit(x, y, seed=9)
    draw = np.random.default_rng(9)
    good, bad = x[y == 1], x[y == 0]
    d = good[draw.integers(0, len(good), pairwise_rank.PAIRS)] - bad[draw.integers(0, len(bad), pairwise_rank.PAIRS)]
    v = np.zeros(3)
    for _ in range(4000):
        v -= 4 * (d.T @ (1 / (1 + np.exp(-(d @ v))) - 1) / len(d) + pairwise_rank.RIDGE * v)
    assert np.allclose(w, v, atol=1e-3)
    assert (x @ w < threshold).sum() == len(bad)


def test_pairwise_rank_of_repeated_ids_and_labels(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(words(rng, 60)) if i % 2 else " ".join(w + "***" for w in words(rng, 60))) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    alone = {r["doc_id"]: r["score"] for r in pairwise_rank.score(docs(spark, rows), labels).collect()}
    noisy = labels.unionByName(labels).unionByName(labels).unionByName(spark.createDataFrame([(100, 0), (100, 1), (101, None)], "doc_id long, quality int"))
    got = pairwise_rank.score(docs(spark, [*rows, *rows, (100, "a b c"), (101, "x")]), noisy).collect()
    assert len(got) == 2 * len(rows) + 2
    assert all(r["score"] == pytest.approx(alone[r["doc_id"]]) for r in got if r["doc_id"] < 100)


def test_held_out_accuracy_on_driver_data(spark):
    sf = "/root/testdata/sf0.01"
    d, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = pairwise_rank.score(d, lab).join(lab, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("a")).first()["a"]
    assert got >= 0.95


def test_scores_do_not_depend_on_how_files_are_dealt_out(spark, monkeypatch):
    """The table of scored rows is read several times; each read may cut its files into other tasks."""
    rng = random.Random(12)
    rows = [(i, " ".join(words(rng, 30, 40))) for i in range(60)]
    table = docs(spark, rows).repartition(6).cache()
    want = {r["doc_id"]: r["score"] for r in context_mixing.scores(table).collect()}
    read, sizes = context_mixing.written, iter([1, 10**9] * 50)

    def dealt(frame):
        spark.conf.set("spark.sql.files.openCostInBytes", str(next(sizes)))
        return read(frame)

    monkeypatch.setattr(context_mixing, "written", dealt)
    try:
        got = context_mixing.scores(table)
        spark.conf.set("spark.sql.files.openCostInBytes", str(10**9))
        assert {r["doc_id"]: r["score"] for r in got.collect()} == pytest.approx(want)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
