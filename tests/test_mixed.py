"""Documents of many types in one plan."""

import pytest
from pyspark.sql import functions as F

from docloom import cli
from docloom.functions.mime import OCTET, SHORT
from docloom.operators import archive, mail, pdf, slides, workbook
from docloom.operators.convert import convert, split
from docloom.operators.mixed import convert_mixed, split_mixed, with_routes

DOCS = "id string, mime string, content binary, more int"


def documents(spark):
    book = workbook.from_csv(b"a,b\n1,x\n", "xlsx")
    found = [
        ("plain", SHORT["plain"], b"one\n\ntwo"), ("html", "TEXT/HTML; charset=UTF-8", b"<html><body><p>x &amp; y</p></body></html>"), ("csv", SHORT["csv"], b"h,i\n1,2\n"), ("xlsx", SHORT["xlsx"], book),
        ("zip", SHORT["zip"], archive.build_zip([("a.txt", b"inside"), ("b.html", b"<p>t</p>")])), ("pdf", SHORT["pdf"], pdf.from_text(["page 1", "page 2"])), ("broken", SHORT["xlsx"], b"PK no"),
        ("null", SHORT["plain"], None), ("unknown", None, b"bytes"), ("json", SHORT["json"], b"{}"),
    ]
    return spark.createDataFrame([(*r, 7) for r in found], DOCS)


def pairs(df):
    return {r["id"]: (None if r["result"] is None else bytes(r["result"]), r["error"] and r["error"]["type"]) for r in df.collect()}


@pytest.mark.parametrize("target", ["plain", "html", "ods", "csv"])
def test_each_row_as_its_type_alone(spark, target):
    docs = documents(spark)
    got = pairs(convert_mixed(docs, target))
    assert len(got) == 10
    for name, mime, short in (("plain", SHORT["plain"], "plain"), ("html", "x", "html"), ("csv", "x", "csv"), ("xlsx", "x", "xlsx"), ("pdf", "x", "pdf"), ("broken", "x", "xlsx"), ("json", "x", "json"), ("null", "x", "plain")):
        want = pairs(convert(docs.where(F.col("id") == name), short, target))[name]
        assert got[name][1] == want[1] and (target == "ods" or got[name][0] == want[0]), name
    assert got["unknown"][1] == (None if target == "plain" else "UnsupportedConversion")


def test_targets_may_differ_too(spark):
    docs = documents(spark).withColumn("target", F.when(F.col("id") == "csv", SHORT["html"]).otherwise(F.lit(SHORT["plain"])))
    got = pairs(convert_mixed(docs))
    assert got["csv"][0].startswith(b"<table>") and got["plain"] == (b"one\n\ntwo", None) and got["html"] == (b"x & y", None)
    assert convert_mixed(docs).columns == ["id", "mime", "more", "target", "result", "error"]


def test_one_pass_and_balance(spark):
    plan = convert_mixed(documents(spark), "plain")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "REBALANCE_PARTITIONS" in plan


def test_routes_of_rows(spark):
    rows = spark.createDataFrame([(SHORT["xlsx"], SHORT["ods"]), (SHORT["docx"], SHORT["pdf"]), (SHORT["plain"], SHORT["pdf"]), (None, SHORT["plain"])], "mime string, target string")
    got = [r["backends"] for r in with_routes(rows).collect()]
    assert got == [["commercial", "office", "core"], ["commercial", "office"], None, ["core"]]
    assert [r["backends"] for r in with_routes(rows, products=["words"]).collect()] == [["office", "core"], ["commercial", "office"], None, ["core"]]


def test_split_of_many_types(spark):
    docs = documents(spark).drop("more")
    got = split_mixed(docs)
    assert got.columns == ["id", "content", "mime", "index", "label", "total", "error"]
    rows = {}
    for r in got.collect():
        rows.setdefault(r["id"], []).append(r)
    assert {k: len(v) for k, v in rows.items()} == {"plain": 2, "html": 1, "csv": 1, "xlsx": 1, "zip": 2, "pdf": 2, "broken": 1, "unknown": 1, "json": 1}
    assert {k for k, v in rows.items() if v[0]["error"] and v[0]["error"]["type"] == "UnsupportedConversion"} == {"html", "unknown", "json"}
    want = {(r["index"], r["label"], bytes(r["content"])) for r in split(docs.where("id = 'zip'").drop("mime"), "zip").collect()}
    assert {(r["index"], r["label"], bytes(r["content"])) for r in rows["zip"]} == want


def test_empty_and_clashing(spark):
    docs = documents(spark)
    assert convert_mixed(docs.limit(0), "plain").count() == split_mixed(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="rename"):
        convert_mixed(docs.withColumnRenamed("more", "result"), "plain")
    with pytest.raises(ValueError, match="rename"):
        split_mixed(docs.withColumnRenamed("more", "label"))


def test_a_mixed_folder_at_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for name, data in (("t.csv", b"h\n1\n2"), ("p.html", b"<p>hello</p>"), ("w.xlsx", workbook.from_csv(b"a,b\n1,x\n", "xlsx")), ("n.txt", b"note")):
        (tmp_path / "in" / name).write_bytes(data)
    assert cli.main(["convert", "-t", "plain", "-i", f"{tmp_path}/in/*", "-o", f"{tmp_path}/out"], spark) == 0
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()}["p.plain"] == "hello"
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["n.plain", "p.plain", "t.plain", "w.plain"]
    assert cli.main(["split", "--extract", "-i", f"{tmp_path}/in/*", "-o", f"{tmp_path}/parts"], spark) == 1
    assert "p: UnsupportedConversion (415)" in capsys.readouterr().err and sorted(p.name for p in (tmp_path / "parts").iterdir()) == ["n", "t", "w"]


def test_an_image_that_ends_early_is_a_parse_error(spark):
    for mime, data in (("image/jpeg", b"\xff\xd8\xff\xe0\x00"), ("image/png", b"\x89PNG\r\n\x1a\n\x00\x00")):
        row = convert_mixed(spark.createDataFrame([(data, mime)], "content binary, mime string"), "pdf").first()
        assert (row.result, row.error.type, row.error.http_status) == (None, "Parse", 400)
