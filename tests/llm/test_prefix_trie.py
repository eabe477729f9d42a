"""The trie against its definition, in memory and by the registered SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from pairlens.llm import prefix_trie
from pairlens.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id long, turn int, role string, text string, digest int, depth string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def plain(rows, branch):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            told = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, told, role, text))
    own = {c: [x[3:] for x in sorted(ts)] for c, ts in own.items()}
    made = dict(own)
    if branch:
        for c, ts in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            made[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    below = defaultdict(list)
    for k in members:
        for d in range(len(k) + 1):
            below[k[:d]].append(k)
    kids = defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    words = lambda k: len(re.findall("[^\x20\x09-\x0d]+", k[-1][1])) if k else 0
    out = set()
    for k, ms in members.items():
        ends = ",".join(map(str, sorted(c for c in ms if len(made[c]) == len(k))))
        out.add((min(ms), len(k), min(members[k[:-1]]) if k else None, len(ms), kids[k], sum(kids[x] == 0 for x in below[k]), sum((len(members[x]) - 1) * words(x) for x in below[k]), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(frame):
    got = [tuple(r) for r in frame.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("block", [2, 3, 32])
def test_random_conversations(spark, monkeypatch, block):
    """Shared beginnings, long chains over several levels of blocks, absent bases, nulls and ties."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "CHUNK", 10)
    rng = random.Random(block)
    rows = []
    for c in [*range(-3, 60), 81, 103, 10**12 + 7]:
        for turn in range(rng.choice([1, 2, 3, 4, 9, 20]) if c != 5 else 75):
            rows.append((c, turn, rng.choice(["user", "user", None, "bot"]), rng.choice(["a", "a", "a", "a b", "", None, "Ä ß  x"])))
    rows += [(200 + i, t, "user", f"same {t}") for i in range(40) for t in range(12)]
    rows += [(3, None, "user", "first"), (3, None, "user", "first"), (3, 1, "bot", "tie"), (None, 1, "user", "none")]
    rng.shuffle(rows)
    assert rows_of(prefix_trie.nodes(table(spark, rows))) == plain(rows, False)
    assert rows_of(prefix_trie.branched_nodes(table(spark, rows))) == plain(rows, True)


def test_empty_turnless_and_long(spark):
    assert prefix_trie.branched_nodes(table(spark, [])).count() == 0
    few = [(c, 1, "user", "x") for c in range(101, 120)]
    assert rows_of(prefix_trie.branched_nodes(table(spark, few))) == plain(few, True)
    assert any(zlib.crc32(str(c).encode()) % 4 for c, *_ in few)
    long = [(1, t, "user", f"t{t}") for t in range(1500)] + [(2, t, "user", f"t{t}" if t < 1100 else "other") for t in range(1200)] + [(3, 1, "user", "word " * 200_000)]
    got = prefix_trie.nodes(table(spark, long))
    assert got.where("depth = 1").select(F.sum("n_convs")).first()[0] == 3
    assert rows_of(got) == plain(long, False)


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    got = con.execute(ORACLE_SQL["op12_prefix_trie"])
    names = [d[0] for d in got.description]
    frame = QUERIES["op12_prefix_trie"](spark, "/root/testdata/sf0.001")
    assert frame.columns == names and all(t == "bigint" for c, t in frame.dtypes if c != "ends_sha256")
    assert rows_of(frame) == set(map(tuple, got.fetchall()))
