"""Stateful operators over streams."""

import random
import time

from docloom.streaming.ingest import drain
from docloom.streaming.ordered import ordered_chunks

CHUNK = "key string, seq long, chunk binary, last boolean"


def chunks(seed=1):
    rnd = random.Random(seed)
    rows, want = [], []
    for k in range(12):
        n = rnd.randrange(1, 9)
        rows += [(f"k{k}", s, f"{k}.{s};".encode(), s in (3, n - 1)) for s in range(n)]
        parts = [f"{k}.{s};" for s in range(n)]
        want += [(f"k{k}", "".join(p).encode() + b"!") for p in ([parts[:4], parts[4:]] if n > 4 else [parts])]
    rows += rows[5:9]  # repeated
    rows += [("open", 0, b"x", False), ("gap", 1, b"y", True), ("nulls", 0, None, False), ("nulls", None, b"z", True), ("nulls", 1, b"n", True), (None, 0, b"q", True)]
    want += [("nulls", b"n!"), ("nulls", "Validation"), (None, b"q!")]
    return rows, want


def run(spark, tmp_path, batches, name, idle=3600):
    folder = tmp_path / name
    for rows in batches:
        spark.createDataFrame(rows, CHUNK).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    drain(ordered_chunks(stream, lambda: b"", lambda s, c: s + c, lambda s: s + b"!", idle), f"{folder}/out", f"{folder}/check", timers=True)
    found = spark.read.parquet(f"{folder}/out").collect()
    key = lambda r: (r[0] or "", str(r[1]))
    return sorted(((r.key, bytes(r.result) if r.error is None else r.error.type) for r in found), key=key)


def test_shuffled_batches_equal_one_batch(spark, tmp_path):
    rows, want = chunks()
    want = sorted(want, key=lambda r: (r[0] or "", str(r[1])))
    assert run(spark, tmp_path, [rows], "one") == want
    random.Random(2).shuffle(rows)
    assert run(spark, tmp_path, [rows[::3], rows[1::3], rows[2::3]], "three") == want


def test_state_survives_a_restart_and_idle_keys_end(spark, tmp_path):
    assert run(spark, tmp_path, [[("a", 0, b"1", False), ("c", 0, b"done", True)]], "r") == [("c", b"done!")]
    assert run(spark, tmp_path, [[("a", 1, b"2", True), ("b", 1, b"late", True)]], "r", 1) == [("a", b"12!"), ("c", b"done!")]
    time.sleep(1.5)
    got = run(spark, tmp_path, [[("new", 0, b"n", True)]], "r", 1)
    assert got == [("a", b"12!"), ("b", "Timeout"), ("c", b"done!"), ("new", b"n!")]
    # what was forgotten begins anew
    assert ("b", b"again!") in run(spark, tmp_path, [[("b", 0, b"again", True)]], "r", 1)


def test_chunks_of_large_files_are_given_once(spark, tmp_path):
    from docloom.sources.chunks import stream_chunks

    rnd = random.Random(4)
    data = {f"f{i}": rnd.randbytes(n) for i, n in enumerate((0, 1, 999, 1000, 1001, 25_000))}
    (tmp_path / "in").mkdir()
    stream = stream_chunks(spark, f"{tmp_path}/in", 1000, 4000)

    def take():
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
        query.processAllAvailable()
        query.stop()  # killed between two batches
        found = {}
        for r in sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: (r.path, r.seq)):
            name = r.path.rpartition("/")[2]
            assert (r.seq, r.at) == (len(found.get(name, b"")) // 1000, len(found.get(name, b"")))
            found[name] = found.get(name, b"") + bytes(r.content)
            assert r.last == (len(found[name]) == r.size)
        return found

    for name in ("f0", "f2", "f5"):
        (tmp_path / "in" / name).write_bytes(data[name])
    assert take() == {n: data[n] for n in ("f2", "f5")}
    for name in ("f1", "f3", "f4"):
        (tmp_path / "in" / name).write_bytes(data[name])
    assert take() == {n: d for n, d in data.items() if d}
    assert take() == {n: d for n, d in data.items() if d}


def test_chunk_partitions_and_growth(spark, tmp_path):
    import pytest
    from pyspark.sql.types import StructType

    from docloom.sources.chunks import SCHEMA, ChunkReader

    schema = StructType.fromDDL(SCHEMA)
    reader = ChunkReader({"path": str(tmp_path), "chunkBytes": "10", "splitBytes": "40"}, schema)
    parts = [p.parts for p in reader.partitions({"a": 25}, {"a": 25, "b": 95, "c": 12})]
    covered = sorted(x for p in parts for x in p)
    assert sum(e - s for _, s, e in covered) == 107 and all(s % 10 == 0 for _, s, _ in covered) and all(sum(e - s for _, s, e in p) <= 50 for p in parts)
    with pytest.raises(ValueError, match="had 25 bytes"):
        reader.partitions({"a": 25}, {"a": 30})
    growing = ChunkReader({"path": str(tmp_path), "chunkBytes": "10", "growing": "true"}, schema)
    (tmp_path / "log").write_bytes(b"x" * 37)
    assert list(growing.latestOffset().values()) == [30]
    got = [(r["seq"], len(r["content"])) for p in growing.partitions({str(tmp_path / "log"): 10}, growing.latestOffset()) for b in growing.read(p) for r in b.to_pylist()]
    assert got == [(1, 10), (2, 10)]
    assert ChunkReader({"path": f"{tmp_path}/none"}, schema).latestOffset() == {}
