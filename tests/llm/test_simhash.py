"""Fingerprints against the definition, and components against all pairs."""

import random

import xxhash
from pyspark.sql import functions as F

from pairlens.llm import simhash
from tests.llm.test_native import docs

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    """The fingerprint by its definition, as an unsigned integer."""
    found = [w for w in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate(LETTERS)) if w]
    grams = [" ".join(found[i : i + 3]) for i in range(max(len(found) - 2, 1))] if found else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(pairs):
    """Least id of each class of (id, fingerprint), all pairs compared."""
    up = {i: i for i, _ in pairs}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in pairs:
        for j, b in pairs:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: top(i) for i in up}


def test_fingerprints_and_components(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    texts = [None, "", " \n\t", "One", "one", "One two", "A b C d", "a\x0bb\x0cc\rd", "Été É x y z", "日本 語 🤗", "a b c " * 500]
    for _ in range(60):
        near = list(base)
        for _ in range(rng.randrange(3)):
            near[rng.randrange(300)] = "changed"
        texts.append(" ".join(near))
    texts += [" ".join(f"v{rng.randrange(50)}" for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(500, texts[-1])]
    got = {r["doc_id"]: r for r in simhash.components(docs(spark, rows).withColumn("fp", F.lit(1)).withColumn("root", F.lit(2))).collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == {i: plain(t) for i, t in rows}
    assert {i: r["component_id"] for i, r in got.items()} == classes([(i, plain(t)) for i, t in rows])


def test_long_texts_are_hashed_in_blocks(spark):
    text = " ".join(f"w{i % 9973}" for i in range(150_000))
    assert simhash.fingerprint(text.encode()) % (1 << 64) == plain(text)


def test_links_of_crowded_and_calm_halves(spark):
    """Crowds of any size lose no link: random walks of one to three flips, with halves that many share."""
    rng = random.Random(9)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(120):
            fps.add(at)
            fps.add(at ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(40) ^ (1 << rng.randrange(8)))
            at ^= 1 << rng.randrange(64)
            if rng.random() < 0.3:
                at ^= 1 << rng.randrange(32)
    fps |= {0xABCD << 40 | rng.getrandbits(9) for _ in range(300)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = classes([(signed(x), x) for x in fps])
    table = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for crowd in (1, 20, 1024):
        found = {tuple(r) for r in simhash.links(table, crowd).collect()}
        assert all(1 <= ((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in found)
        up = {signed(x): signed(x) for x in fps}

        def top(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in found:
            x, y = sorted((top(a), top(b)))
            up[y] = x
        assert {i: top(i) for i in up} == want


def test_defined_cases(spark):
    assert simhash.components(docs(spark, [])).count() == 0
    got = sorted(simhash.components(docs(spark, [(None, "x y z"), (None, None), (4, ""), (7, "x y z"), (7, "other words here now"), (7, "x y z")])).collect(), key=str)
    zero = [r for r in got if r["fingerprint"] == "0" * 16]
    assert {(r["doc_id"], r["component_id"]) for r in zero} == {(None, 4), (4, 4)}
    assert len(got) == 6 and all(r["component_id"] == 7 for r in got if r not in zero)
    named = simhash.components(spark.createDataFrame([("b", "q r s"), ("a", "q r s")], "doc_id string, text string"))
    assert {r["component_id"] for r in named.collect()} == {"a"}
