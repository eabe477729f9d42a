"""Archives by byte range: whole contents from several tasks, resumed extraction, and no pickles."""

import io
import json
import os
import random
import tarfile

import numpy as np
import pytest

from pairlens.sources import ranges


@pytest.fixture()
def archive(tmp_path):
    rng = random.Random(1)
    files = {f"d/{k:02}.bin": rng.randbytes(rng.randrange(0, 3000)) for k in range(40)}
    whole = io.BytesIO()
    with tarfile.open(fileobj=whole, mode="w") as tar:
        for name, content in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    data, parts = whole.getvalue(), []
    for k, at in enumerate(range(0, len(data), len(data) // 3 + 1)):
        parts.append(str(tmp_path / f"a.tar.{k}"))
        open(parts[-1], "wb").write(data[at : at + len(data) // 3 + 1])
    return files, parts


def test_members_by_range(spark, archive):
    files, parts = archive
    ranges.register(spark)
    read = spark.read.format("tar_ranges").option("parts", json.dumps(parts)).option("split", "8000")
    frame = read.load()
    assert frame.rdd.getNumPartitions() > 4
    assert {r["member"]: bytes(r["content"]) for r in frame.collect()} == files
    some = read.option("wanted", json.dumps(["d/03.bin", "d/39.bin", "no"])).load().collect()
    assert {r["member"]: bytes(r["content"]) for r in some} == {k: files[k] for k in ("d/03.bin", "d/39.bin")}


def test_extraction_resumes_and_audits(spark, archive, tmp_path):
    files, parts = archive
    root = str(tmp_path / "out")
    want = lambda *names: spark.createDataFrame([(n,) for n in names], "member string")
    first = ranges.extracted(spark, parts, want("d/01.bin", "d/02.bin"), root).first()
    assert (first["written"], first["skipped"], first["status"]) == (2, 0, "passed")
    open(f"{root}/d/02.bin", "ab").write(b"spoilt")
    again = ranges.extracted(spark, parts, want(*files, "d/99.bin", "d/98.bin"), root, split=5000).first().asDict()
    assert again == {"selected": 42, "written": 39, "skipped": 1, "missing": 2, "first_missing": ["d/98.bin", "d/99.bin"], "status": "failed"}
    assert all(open(f"{root}/{n}", "rb").read() == c for n, c in files.items()) and not [f for f in os.listdir(f"{root}/d") if f.endswith("part")]
    with pytest.raises(Exception, match="unsafe member"):
        ranges.extracted(spark, parts, want("../x"), root).collect()


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_npz_rows(spark, tmp_path, save):
    ranges.register(spark)
    path = str(tmp_path / "m.npz")
    rng = np.random.default_rng(1)
    held = {"big": rng.normal(size=(50, 7)), "small": np.arange(6, dtype="<i2").reshape(2, 3), "line": np.arange(5.0), "cube": rng.normal(size=(3, 2, 2)).astype("f4"), "turned": np.asfortranarray(rng.normal(size=(4, 3))), "empty": np.zeros((0, 3))}
    save(path, **held)
    frame = spark.read.format("npz_rows").option("split", "600").load(path)
    got = {}
    for r in frame.collect():
        got.setdefault(r["name"], {})[r["row"]] = r["values"]
    for name, x in held.items():
        assert [got.get(name, {})[k] for k in range(len(x))] == x.reshape(len(x), -1).astype(float).tolist() if len(x) else name not in got
    assert save is not np.savez or frame.rdd.getNumPartitions() > 5
    one = spark.read.format("npz_rows").option("arrays", '["small"]').load(path)
    names = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "i int, label string")
    assert {(r["l"], r["r"]): r["value"] for r in ranges.matrix_entries(one, names).collect()} == {(a, b): float(3 * i + j) for i, a in enumerate("xy") for j, b in enumerate("xyz")}


def test_objects_are_refused(spark, tmp_path):
    ranges.register(spark)
    path = str(tmp_path / "o.npz")
    np.savez(path, o=np.array([{"a": 1}], dtype=object))
    with pytest.raises(Exception, match="not read"):
        spark.read.format("npz_rows").load(path).collect()
