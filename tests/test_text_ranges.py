"""Texts split by many tasks equal the row versions, whatever the blocks."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators.text_ranges import _Block, _runs, block_plan, read_lines, split_csv_files, split_paragraph_files
from docloom.operators.text_split import split_csv_rows, split_paragraphs


def texts():
    rnd = random.Random(7)
    piece = lambda: rnd.choice(["a", "bb bb", "line é 中", "", "", " \t", "\x0b", "\x00", "\x01 ", "x" * 40, "  lead", "tail  ", "\r"])
    found = {f"r{i}": "\n".join(piece() for _ in range(rnd.randrange(1, 60))) + rnd.choice(["", "\n", "\n\n"]) for i in range(14)}
    return found | {"empty": "", "blank": "\n \n\n", "one": "word", "whole": "\n".join(["no break here"] * 30), "controls": "\x00\n\x01\n" * 20 + "\n\nend", "long": "y" * 300 + "\n\n" + "z" * 300}


@pytest.fixture
def blocks(spark):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]

    def set_to(n):
        for k in keys:
            spark.conf.set(k, n)

    yield set_to
    for k in keys:
        spark.conf.unset(k)


def named(df):
    return sorted(tuple(r) for r in df.withColumn("path", F.regexp_extract("path", "[^/]*$", 0)).select("path", "index", "label", "total", "text").collect())


@pytest.mark.parametrize("size, some", [(9, ("r1", "blank", "one", "controls")), (200, None), (1 << 27, None)])
def test_files_equal_rows(spark, tmp_path, blocks, size, some):
    folder = str(tmp_path)
    chosen = {k: v[:150] if some else v for k, v in texts().items() if not some or k in some}
    for name, text in chosen.items():
        (tmp_path / name).write_text(text, newline="")
    rows = spark.createDataFrame(list(chosen.items()), "path string, text string")
    blocks(size)
    assert named(split_paragraph_files(spark, folder)) == named(split_paragraphs(rows, keep=("path",)))
    # a carriage return at the end of a file goes here
    rows = rows.withColumn("text", F.regexp_replace("text", "\r$", ""))
    assert named(split_csv_files(spark, folder)) == named(split_csv_rows(rows, keep=("path",)))


def test_a_file_is_read_in_many_blocks_and_only_edges_are_shuffled(spark, tmp_path, blocks):
    (tmp_path / "f").write_text("\n\n".join(f"paragraph {i}\nwith two lines" for i in range(2000)))
    blocks(4000)
    lines = read_lines(spark, str(tmp_path))
    assert lines.select("block").distinct().count() > 10
    plan = block_plan(lines).collect()
    assert sum(r["joined"] for r in plan) <= len(plan) and plan[0]["total"] == 2000
    edges = _runs(lines, False).where("text IS NOT NULL").count()
    assert edges <= 2 * len(plan)
    found = split_paragraph_files(spark, str(tmp_path))
    assert [r["text"] for r in found.orderBy("index").collect()] == [f"paragraph {i}\nwith two lines" for i in range(2000)]
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_a_block_are_one_block():
    import pyarrow as pa

    rnd = random.Random(3)
    for _ in range(300):
        lines = [rnd.choice(["a", "b c", "", " ", "\x00"]) for _ in range(rnd.randrange(1, 12))]
        cut = sorted(rnd.randrange(len(lines) + 1) for _ in range(2))

        def read(parts):
            block = _Block(("p", 0))
            out = [r for p in parts if p for b in block.take(pa.array(p), True) for r in b.to_pylist()]
            return out + [r for b in block.end() for r in b.to_pylist()]

        assert read([lines]) == read([lines[: cut[0]], lines[cut[0] : cut[1]], lines[cut[1] :]])
