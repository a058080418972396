"""Files as a committing sink, in batch and stream."""

import os

import pytest
from pyspark.sql import functions as F

from docloom.sources.sink import FileStreamWriter, FileWriter, Staged, checked, clean_staged, commit_files, stream_files


def tree(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, files in os.walk(folder) for f in files}


def rows(spark, names, tag=""):
    return spark.createDataFrame([(n, f"{tag}{n}".encode(), 1) for n in names], "filename string, content binary, more int").repartition(3)


def test_files_are_placed_whole(spark, tmp_path):
    names = [f"s{i % 3}/{i}.txt" for i in range(40)] + ["a/b/../c.bin"]
    df = rows(spark, names).unionByName(spark.createDataFrame([(None, b"x", 1), ("no", None, 1)], "filename string, content binary, more int"))
    commit_files(df, f"file://{tmp_path}/out")
    assert tree(tmp_path / "out") == {os.path.normpath(n): n.encode() for n in names}
    commit_files(rows(spark, ["s0/0.txt", "new"], "2:"), f"{tmp_path}/out")
    assert len(tree(tmp_path / "out")) == 42 and tree(tmp_path / "out")["s0/0.txt"] == b"2:s0/0.txt"
    commit_files(rows(spark, ["only"]), f"{tmp_path}/out", mode="overwrite")
    assert tree(tmp_path / "out") == {"only": b"only"}
    commit_files(rows(spark, ["x"]).limit(0), f"{tmp_path}/none")
    assert not os.path.exists(tmp_path / "none") or tree(tmp_path / "none") == {}


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    commit_files(rows(spark, ["kept"]), f"{tmp_path}/out")
    df = rows(spark, [f"{i}" for i in range(60)]).withColumn("filename", F.when(F.col("filename") == "37", F.raise_error(F.lit("broken"))).otherwise(F.col("filename")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken"):
            commit_files(df, f"{tmp_path}/out", mode=mode)
        assert tree(tmp_path / "out") == {"kept": b"kept"} and os.listdir(tmp_path / "out") == ["kept"]


@pytest.mark.parametrize("names", [["../x"], ["/x"], ["_hidden"], ["a/.x"], ["."], ["a/../../x"], ["same", "same"], ["d/same", "d/./same"]])
def test_names_are_checked_before_anything_is_moved(spark, tmp_path, names):
    with pytest.raises(Exception, match="name"):
        commit_files(rows(spark, [*names, "good"]), f"{tmp_path}/out")
    assert tree(tmp_path) == {}


def test_checked_names():
    assert checked("a//b/./c") == "a/b/c" and checked("a/../b") == "b"


def test_an_attempt_that_does_not_count_is_dropped(spark, tmp_path):
    """A repeated task: both attempts have written, the message of one of them counts."""
    schema = rows(spark, ["x"]).schema
    writer = FileWriter({"path": str(tmp_path)}, schema, False)
    batches = lambda *names: iter(rows(spark, names).drop("more").coalesce(1).toArrow().to_batches())
    first, again = writer.write(batches("a", "b")), writer.write(batches("a", "b"))
    other = writer.write(batches("c"))
    assert {first.files, again.files, other.files} == {2, 1} and set(os.listdir(tmp_path)) == {"_staged"}
    writer.commit([again, other, None])
    assert tree(tmp_path) == {"a": b"a", "b": b"b", "c": b"c"} and sorted(os.listdir(tmp_path)) == ["a", "b", "c"]


def test_a_batch_that_comes_again_is_written_once(spark, tmp_path):
    schema = rows(spark, ["x"]).schema
    batches = lambda *names: iter(rows(spark, names).drop("more").coalesce(1).toArrow().to_batches())
    writer = FileStreamWriter({"path": str(tmp_path)}, schema, False)
    writer.commit([writer.write(batches("a"))], 0)
    at = os.stat(tmp_path / "a").st_mtime_ns
    again = FileStreamWriter({"path": str(tmp_path)}, schema, False)
    message = again.write(batches("a"))
    lost = again.write(batches("lost"))
    again.commit([message], 0)
    assert os.stat(tmp_path / "a").st_mtime_ns == at and not os.path.exists(message.folder) and isinstance(lost, Staged)
    clean_staged(str(tmp_path))
    assert {k for k in tree(tmp_path)} == {"a", "_batches/0"}


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for part in range(3):
        rows(spark, [f"{part}/{i}" for i in range(5)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("filename string, content binary, more int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second one finds nothing new
        stream_files(stream, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    found = {k: v for k, v in tree(tmp_path / "out").items() if not k.startswith("_")}
    assert found == {f"{p}/{i}": f"{p}/{i}".encode() for p in range(3) for i in range(5)}
