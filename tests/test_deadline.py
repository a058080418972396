"""A row that hangs, dies or eats memory costs itself only; splitting a table of many types by SQL."""

import os
import time

import pytest

from docloom import udfs
from docloom.functions.mime import SHORT
from docloom.operators.archive import build_zip
from docloom.operators.base import ConversionError, convert_documents
from docloom.operators.deadline import Guarded


def work(content):
    if content == b"hang":
        time.sleep(60)
    if content == b"die":
        os._exit(9)
    if content == b"fill":
        return bytes(1 << 32)
    if content == b"refuse":
        raise ConversionError("Parse", "no")
    if content == b"break":
        raise ValueError("odd")
    return content + str(os.getpid()).encode()


def test_one_child_serves_until_it_must_go():
    guarded = Guarded(work, 1.0, 1 << 30)
    first, second = guarded(b"a"), guarded(b"a")
    assert first == second != b"a" + str(os.getpid()).encode()
    for content, kind in ((b"hang", "Timeout"), (b"die", "Render"), (b"fill", "Resource"), (b"refuse", "Parse")):
        with pytest.raises(ConversionError) as e:
            guarded(content)
        assert e.value.kind == kind
        assert guarded(b"a").startswith(b"a")
    with pytest.raises(RuntimeError, match="odd"):
        guarded(b"break")
    assert guarded(b"a") != first
    big = b"x" * (8 << 20)
    assert guarded(big).startswith(big)
    guarded.close()


def test_a_hanging_row_costs_its_row(spark):
    rows = [(i, c) for i, c in enumerate([b"a", b"hang", b"b", b"die", b"c", b"refuse", None, b"d"])]
    began = time.time()
    got = {r.i: r for r in convert_documents(spark.createDataFrame(rows, "i int, content binary").coalesce(1), Guarded(work, 1.0)).collect()}
    assert time.time() - began < 30
    assert {i: r.error.type for i, r in got.items() if r.error} == {1: "Timeout", 3: "Render", 5: "Parse"}
    assert all(bytes(got[i].result).startswith(rows[i][1]) for i in (0, 2, 4, 7)) and got[6].result is None


def test_split_a_table_by_sql(spark):
    udfs.register(spark)
    docs = [(1, SHORT["plain"], b"a\n\nb", "x"), (2, SHORT["csv"], b"h\n1\n2", "y"), (3, SHORT["zip"], build_zip([("f.txt", b"in")]), None), (4, SHORT["html"], b"<p>", "z"), (5, SHORT["plain"], None, "n"), (6, None, b"?", "u"), (7, SHORT["zip"], b"bad", "v")]
    spark.createDataFrame(docs, "id int, mime string, content binary, more string").createOrReplaceTempView("mixed_docs")
    got = spark.sql("SELECT * FROM doc_split_table(TABLE(mixed_docs))")
    assert got.columns == ["id", "more", "content", "mime", "index", "label", "total", "error"]
    rows = sorted((r.id, r.more, r.content and bytes(r.content), r["index"], r.total, r.error and r.error.type) for r in got.collect())
    assert [r[:3] for r in rows] == [(1, "x", b"a"), (1, "x", b"b"), (2, "y", b"h\n1"), (2, "y", b"h\n2"), (3, None, b"in"), (4, "z", None), (6, "u", None), (7, "v", None)]
    assert [r[5] for r in rows[-3:]] == ["UnsupportedConversion", "UnsupportedConversion", "Split"] and rows[0][3:5] == (0, 2)
    for bad in ("SELECT * FROM doc_split_table(TABLE(SELECT 1 AS id))", "SELECT * FROM doc_split_table(TABLE(SELECT 1 AS total, content, mime FROM mixed_docs))"):
        with pytest.raises(Exception, match="doc_split_table"):
            spark.sql(bad).collect()
