"""The pipeline against a plain version, stage by stage, on a small table of its own."""

import hashlib
import random

from pairlens.llm import byte_bpe
from pairlens.llm.queries import tokenizer
from tests.llm.test_free import brute_shingles
from tests.llm.test_native import brute_lines, brute_overlaps, brute_quality, item

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(spark, rows, bench):
    import tiktoken

    path, pattern = tokenizer()
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    kept = [(i, t) for i, t in rows for n, _, _, _, repeated in [brute_quality(t)] if n >= 20 and 100 * repeated <= 30 * n]
    lines = [(i, t) for (i, _), t in zip(kept, brute_lines(spark, kept), strict=True) if t.strip()]
    sets, root = [brute_shingles(t) for _, t in lines], list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if lines[a][1] == lines[b][1] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    first = {}
    for k, (i, t) in enumerate(lines):
        mine = (i, hashlib.md5(t.encode()).digest(), t)
        first[root[k]] = min(first.get(root[k], mine), mine)
    single = [(i, t) for i, _, t in first.values()]
    bad = {k for k, row in enumerate(single) if brute_overlaps([row], bench)}
    return sorted((i, coder.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for k, (i, t) in enumerate(single) if k not in bad)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(31)
    text = lambda n=60: "\n".join(" ".join(item(rng, 12)) for _ in range(n // 12))
    bench = [(k, " ".join(item(rng, 30))) for k in range(6)]
    rows = [(k, text()) for k in range(30)]
    shared = text(72)
    rows += [(40 + k, f"{text(24)}\n{shared}\n{text(24)}") for k in range(4)]
    flat = [" ".join(item(rng, 200)) for _ in range(6)]
    rows += [(60 + k, x) for k, x in enumerate(flat)] + [(70 + k, x.replace(x.split()[7], "other")) for k, x in enumerate(flat)] + [(80, flat[0]), (81, flat[0])]
    rows += [(90 + k, f"{' '.join(item(rng, 20))} {b} {' '.join(item(rng, 20))}") for k, (_, b) in enumerate(bench[:3])]
    rows += [(100, None), (101, ""), (102, "too few words"), (103, "same words again " * 30), (5, text()), (6, rows[6][1]), (104, rows[7][1])]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["ids"], r["decoded_sha256"]) for r in got) == plain(spark, rows, bench)
    assert all(r["n_tokens"] == len(r["starts"]) == len(r["ends"]) for r in got)
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
