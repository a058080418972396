"""Range reads, archives as a data source, information without the body."""

import io
import os
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.operators.archive import split_zip
from docloom.sources.archives import SCHEMA, ArchiveReader, Ranges, deal, read_archives, whole_entries
from docloom.sources.ranges import RangeFile, list_files


def test_range_file_equals_bytes(tmp_path):
    rnd = random.Random(1)
    data = rnd.randbytes(300_000)
    (tmp_path / "f").write_bytes(data)
    with RangeFile(str(tmp_path / "f"), block=1000, blocks=3) as got, io.BytesIO(data) as want:
        for _ in range(400):
            if rnd.random() < 0.5:
                to, whence = rnd.choice([(rnd.randrange(300_000), 0), (rnd.randrange(-200, 200), 1), (-rnd.randrange(300_000), 2)])
                if whence != 1 or want.tell() + to >= 0:
                    assert got.seek(to, whence) == want.seek(to, whence)
            n = rnd.choice([0, 1, 999, 1000, 1001, 5000, 300_001])
            assert got.read(n) == want.read(n) and got.tell() == want.tell()
        got.seek(299_990)
        assert got.read() == data[-10:]


def test_list_files(tmp_path):
    for name in ("a.zip", "b.txt", "sub/c.zip", "sub/deep/d.zip", ".hidden/e.zip", "_staged/f.zip"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    names = lambda p: [os.path.relpath(f, tmp_path) for f, _ in list_files(p)]
    assert names(str(tmp_path)) == ["a.zip", "b.txt", "sub/c.zip", "sub/deep/d.zip"]
    assert names(f"file://{tmp_path}/*.zip") == ["a.zip"] and names(f"{tmp_path}/*/*.zip") == ["sub/c.zip"] and names(f"{tmp_path}/b.txt") == ["b.txt"]
    with pytest.raises(FileNotFoundError):
        list_files(f"{tmp_path}/none")


def test_deal_covers_each_byte_once():
    parts = deal([("a", 10), ("b", 0), ("c", 250), ("d", 90), ("e", 20)], 100)
    found = {}
    for group in parts:
        for path, start, end in group:
            found.setdefault(path, []).append((start, end))
    assert found == {"a": [(0, 10)], "b": [(0, 1)], "c": [(0, 100), (100, 200), (200, 250)], "d": [(0, 90)], "e": [(0, 20)]}


def archive(entries, stored=()):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data, zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED)
    return raw.getvalue()


def made_entries(seed=2):
    rnd = random.Random(seed)
    found = [(f"d/{i}.txt", (b"line %d\n" % i) * rnd.randrange(0, 3000)) for i in range(20)]
    return found + [("raw.bin", rnd.randbytes(50_000)), ("empty", b""), ("dir/", b""), ("__MACOSX/x", b"m"), ("é.html", b"<p>hi</p>")]


@pytest.mark.parametrize("split, chunk", [(1 << 26, 1 << 22), (1000, 700), (7, 4096), (20_000, 1)])
def test_archive_source_equals_whole_reader(spark, tmp_path, split, chunk):
    entries = made_entries() if chunk > 1 else [("a", b"abcde"), ("raw.bin", b"0123456"), ("empty", b"")]
    content = archive(entries, {"raw.bin"})
    (tmp_path / "x.zip").write_bytes(content)
    for mode in ("core", "full"):
        reader = ArchiveReader({"path": str(tmp_path), "splitBytes": split, "chunkBytes": chunk, "mode": mode}, StructType.fromDDL(SCHEMA))
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert all(len(r["content"]) <= chunk and r["error"] is None for r in rows)
        got = {}
        for r in sorted(rows, key=lambda r: (r["index"], r["chunk"])):
            key = r["mime"], r["index"], r["label"]
            assert r["offset"] == len(got.get(key, b"")) == r["chunk"] * chunk
            got[key] = got.get(key, b"") + r["content"]
        assert [(c, *k) for k, c in got.items()] == split_zip(content, mode)


def test_archive_errors_stay_in_their_place(spark, tmp_path):
    content = bytearray(archive([("good.txt", b"fine" * 100), ("bad.txt", b"spoilt" * 100), ("more.txt", b"fine too")]))
    at = content.index(b"bad.txt") + 8
    content[at : at + 4] = b"\xff\xff\xff\xff"
    (tmp_path / "spoilt.zip").write_bytes(content)
    (tmp_path / "cut.zip").write_bytes(bytes(content[:200]))
    (tmp_path / "none.zip").write_bytes(b"")
    (tmp_path / "empty.zip").write_bytes(archive([]))
    locked = bytearray(archive([("locked.txt", b"x")]))
    locked[6] |= 1
    locked[locked.index(b"PK\x01\x02") + 8] |= 1
    (tmp_path / "locked.zip").write_bytes(locked)
    rows = {(os.path.basename(r["path"]), r["name"]): r for r in read_archives(spark, str(tmp_path), split_bytes=100).collect()}
    assert set(rows) == {("spoilt.zip", "good.txt"), ("spoilt.zip", "bad.txt"), ("spoilt.zip", "more.txt"), ("cut.zip", None), ("none.zip", None), ("locked.zip", "locked.txt")}
    assert {k: r["error"]["type"] for k, r in rows.items() if r["error"]} == {("spoilt.zip", "bad.txt"): "Parse", ("cut.zip", None): "Parse", ("none.zip", None): "Parse", ("locked.zip", "locked.txt"): "Resource"}
    assert bytes(rows["spoilt.zip", "more.txt"]["content"]) == b"fine too"


def test_archive_conditions_are_pushed_down(spark, tmp_path):
    (tmp_path / "x.zip").write_bytes(archive(made_entries()))
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    df = read_archives(spark, str(tmp_path), content=False)
    for condition, n in ((F.col("name") == "empty", 1), (F.col("name").startswith("d/1"), 11), (F.col("name").endswith(".html"), 1), (F.col("name").isin("d/3.txt", "empty", "none"), 2)):
        found = df.where(condition)
        assert found.count() == n
        assert "PushedFilters: []" not in found._jdf.queryExecution().executedPlan().toString()
    assert df.where(F.col("path").endswith("x.zip")).count() == len(split_zip(archive(made_entries())))


def test_one_large_archive_is_read_by_many_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "large.zip", "w", zipfile.ZIP_STORED) as z:
        for i in range(40):
            z.writestr(f"e{i}", bytes([i]) * 100_000)
        z.writestr("long", b"z" * 3_000_000)
    df = read_archives(spark, str(tmp_path / "large.zip"), split_bytes=500_000, chunk_bytes=200_000)
    per = df.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.length("content")).alias("n")).collect()
    assert len(per) == 14 and max(r["n"] for r in per) <= 900_000
    whole = {r["name"]: bytes(r["content"]) for r in whole_entries(df).collect()}
    assert whole == {f"e{i}": bytes([i]) * 100_000 for i in range(40)} | {"long": b"z" * 3_000_000}


def test_a_bomb_is_chunks(spark, tmp_path):
    (tmp_path / "bomb.zip").write_bytes(archive([("bomb", bytes(300_000_000))]))
    reader = ArchiveReader({"path": str(tmp_path / "bomb.zip")}, StructType.fromDDL(SCHEMA))
    began, size = time.time(), 0
    for batch in reader.read(Ranges([(str(tmp_path / "bomb.zip"), 0, 1 << 30)])):
        assert batch.nbytes < 40 << 20
        size += sum(len(x) for x in batch.column("content").to_pylist())
    assert size == 300_000_000 and time.time() - began < 30
