import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from docloom import cli, queries
from docloom.functions.errors import error
from docloom.operators import archive
from docloom.plans import pipeline as P, registry as R
from docloom.sources.files import documents_from_text, read_documents, read_texts, responses, write_files

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("backends,n,targets,divisible", [(R.BACKENDS, 122, 18, 16), (("commercial", "core"), 104, 16, 16), (("office", "core"), 92, 13, 11), (("core",), 47, 3, 11)])
def test_capabilities(spark, backends, n, targets, divisible):
    found = R.capability_matrix(spark, backends)
    assert found.count() == n and found.select("target").distinct().count() == targets and found.select("source").distinct().count() == 24
    assert R.splits(spark, backends).select("source").distinct().count() == divisible


def test_route_sets():
    a, b = set(R.COMMERCIAL), set(R.OFFICE)
    assert (len(a), len(b), len(a & b), len(a | b)) == (78, 60, 35, 103)


def test_composition(spark):
    df = spark.createDataFrame([(1, "a, b"), (2, "c")], "doc_id long, text string")
    split = P.Transform("split", lambda d: d.select("doc_id", F.posexplode(F.split("text", ", ")).alias("index", "text")), priority=-100)
    both = split >> P.conversion("upper", F.upper)
    assert (both.name, both.priority, both.with_priority(3).priority) == ("split >>> upper", -100, 3)
    assert [tuple(r) for r in both(df).orderBy("doc_id", "index").collect()] == [(1, 0, "A"), (1, 1, "B"), (2, 0, "C")]
    assert P.empty(df).count() == 0 and P.identity(df) is df
    failed = P.failing("General", "no")(df)
    assert failed.first().error.http_status == 500 and P.on_error(failed, "drop").count() == 0 and P.on_error(failed).count() == 2
    with pytest.raises(Exception, match="no"):
        P.on_error(failed, "throw").collect()
    with pytest.raises(ValueError):
        P.on_error(failed, "other")


def test_fallback_order(spark):
    kinds = [None, "UnsupportedConversion", "Resource", "Parse"]
    df = spark.createDataFrame([(a, b) for a in kinds for b in kinds], "a string, b string")
    fault = lambda c: F.when(F.col(c).isNotNull(), error(F.col(c), F.lit("x")))
    value, e = P.fallback(F.when(F.col("a").isNull(), "first"), fault("a"), (F.when(F.col("b").isNull(), "second"), fault("b")))
    for r in df.select("a", "b", value.alias("v"), e["type"].alias("e")).collect():
        again = r.a in ("UnsupportedConversion", "Resource")
        assert (r.v, r.e) == (("second" if r.b is None else None, r.b) if again else ("first" if r.a is None else None, r.a))


def test_plan_time_checks():
    R.require_path("html", "pdf", "pptx")
    R.require_splitter("csv")
    for bad in (lambda: R.require_path("html", "zip"), lambda: R.require_splitter("odp")):
        with pytest.raises(LookupError):
            bad()
    assert R.licensed_products({}) == [] and R.licensed_products({"DOCLOOM_LICENSE_CELLS": "x"}) == ["cells"]
    assert R.licensed_products({"DOCLOOM_LICENSE_TOTAL": "x"}) == list(R.PRODUCTS) and R.licensed_products({"DOCLOOM_LICENSE_TOTAL": "x", "DOCLOOM_LICENSE_OFF": "true"}) == []


def test_request_parameters(spark):
    from docloom.functions.options import options_summary
    from docloom.plans import requests as Q

    given = {"sheet": F.lit("A, B,"), "paper_size": F.lit("a4"), "landscape": F.lit("no"), "exclude_hidden": F.lit("TRUE"), "evaluate_formulas": F.lit("false")}
    bad = Q.parse_options({"paper_size": F.lit("b9")})
    r = spark.range(1).select(options_summary(Q.parse_options(given)), options_summary(bad), *(Q.parse_backend(F.lit(b)) for b in ("Core", "", "x"))).first()
    assert tuple(r) == ("no-evaluate-formulas, portrait, paper-size=A4, sheet=A,B, exclude-hidden", "", "core", None, "")
    assert Q.health(spark).first().status == "healthy"
    c = Q.server_config({"port": "9"}, {"PORT": "8", "HOST": "h"})
    assert (c["port"], c["host"], c["task_timeout_ms"]) == (9, "h", 120000)


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a/x.txt", b"1"), ("b.pdf", b"%PDF-1"), ("c", b"<html>"), ("n", None)], "filename string, content binary")
    assert write_files(df, str(tmp_path)) == 3
    got = {r.path.rsplit("/", 1)[1]: (r.mime, bytes(r.content)) for r in read_documents(spark, f"{tmp_path}/*").collect()}
    assert got == {"x.txt": ("text/plain", b"1"), "b.pdf": ("application/pdf", b"%PDF-1"), "c": ("text/html", b"<html>")}
    assert read_texts(spark, f"{tmp_path}/a").first().text == "1"
    with pytest.raises(Exception, match="leaves the folder"):
        write_files(spark.createDataFrame([("../x", b"")], "filename string, content binary"), str(tmp_path))
    out = responses(documents_from_text(spark.createDataFrame([(1, "é")], "i int, text string"))).first()
    assert (out.content_type, out.content_length, out.i) == ("text/plain", 2, 1)


def test_streams(spark, tmp_path):
    from docloom.streaming.ingest import drain, process_chunks, stream_documents

    write_files(spark.createDataFrame([("x.txt", b"1"), ("y.html", b"2")], "filename string, content binary"), str(tmp_path / "in"))
    for want in (2, 2):
        drain(stream_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == want
    # out of order, three results of one key, and a key that isn't finished
    rows = [("k", 2, b"b", True), ("k", 1, b"a", False), ("k", 4, b"d", True), ("k", 3, b"c", False), ("k", 5, None, True), ("open", 1, b"c", False)]
    chunks = spark.createDataFrame(rows, "key string, seq long, chunk binary, last boolean")
    chunks.coalesce(1).write.parquet(str(tmp_path / "chunks"))
    stream = spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "chunks"))
    drain(process_chunks(stream, lambda: b"", lambda s, c: s + c, lambda s: s + b"!"), str(tmp_path / "done"), str(tmp_path / "cp2"))
    assert [(r.key, bytes(r.result)) for r in spark.read.parquet(str(tmp_path / "done")).collect()] == [("k", b"ab!"), ("k", b"cd!"), ("k", b"!")]


def test_command_line(spark, tmp_path, capsys):
    write_files(spark.createDataFrame([("t.csv", b"h\n1\n2"), ("u.csv", b"h\n3")], "filename string, content binary"), str(tmp_path / "in"))
    assert cli.main(["split", "-i", f"{tmp_path}/in/*", "-o", f"{tmp_path}/zips"], spark) == 0
    assert [f[3] for f in archive.split_zip((tmp_path / "zips/t.zip").read_bytes())] == ["1__Row 2.csv", "2__Row 3.csv"]
    assert cli.main(["split", "--extract", "-i", f"{tmp_path}/in/t.csv", "-o", f"{tmp_path}/files"], spark) == 0
    assert (tmp_path / "files/t/2__Row 3.csv").read_text() == "h\n2"
    assert cli.main(["convert", "-t", "html", "-i", f"{tmp_path}/in/*", "-o", f"{tmp_path}/html"], spark) == 0
    assert (tmp_path / "html/u.html").read_text().startswith("<table>")
    assert cli.main(["convert", "-t", "pdf", "-i", f"{tmp_path}/in/*", "-o", f"{tmp_path}/pdf"], spark) == 1
    assert "Resource (503)" in capsys.readouterr().err
    assert cli.main(["info", "-i", f"{tmp_path}/in/*"], spark) == 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("nation", "part", "documents", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_equal_sql(spark, duck, tmp_path, name):
    df = queries.QUERIES[name](spark, SF)
    df.write.parquet(f"{tmp_path}/got")
    cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
    want, got = f"SELECT {cols} FROM ({queries.ORACLE[name]})", f"SELECT {cols} FROM '{tmp_path}/got/*.parquet'"
    differ = f"SELECT count(*) FROM (({want}) EXCEPT ALL ({got}) UNION ALL (({got}) EXCEPT ALL ({want})))"
    assert duck.execute(differ).fetchall() == [(0,)]
    assert duck.execute(f"SELECT count(*) FROM ({want})").fetchall() == duck.execute(f"SELECT count(*) FROM ({got})").fetchall()


def test_json_files_and_the_store(spark, tmp_path):
    from docloom.sources.files import delete, exists, read_json, write_json

    df = spark.createDataFrame([(1, "a", None), (2, None, [1])], "id long, name string, xs array<long>")
    write_json(df, str(tmp_path / "rows"))
    assert sorted(map(tuple, read_json(spark, str(tmp_path / "rows"), "id long, name string, xs array<long>").collect())) == [(1, "a", None), (2, None, [1])]
    (tmp_path / "one.json").write_text('[{"id": 1},\n {"id": 2}]')
    assert read_json(spark, str(tmp_path / "one.json")).count() == 2
    assert exists(spark, str(tmp_path / "rows")) and delete(spark, str(tmp_path / "rows"), True) and not exists(spark, str(tmp_path / "rows"))
    assert not delete(spark, str(tmp_path / "rows"))


def test_licences_choose_the_backend(spark):
    from docloom.operators import convert as C

    docs = spark.createDataFrame([(1, bytearray(b"a\n\nb"))], "id long, content binary")
    assert C.convert(docs, "docx", "pdf", products=[]).first().error.type == "Resource"
    assert len(C.converters("xlsx", "csv", products=["words"])) == 2
    assert len(C.converters("xlsx", "csv", products=["cells"])) == 3 == len(C.converters("xlsx", "csv"))
    assert len(C.splitters("pdf", products=["cells"])) == 2 and len(C.splitters("pdf", products=["pdf"])) == 3
    # without the licence, core takes sections of a text document as a whole
    assert C.split(docs, "plain", products=[]).count() == 2


def test_an_office_process_takes_what_has_no_reader(monkeypatch, tmp_path):
    """A stand-in for the process, that copies its input and notes its arguments."""
    from docloom.functions.options import ConvertOptions
    from docloom.operators import convert as C, outlook, workbook as B

    made = B.write_xlsx([B.Sheet("A", {(0, 0): B.Cell("string", "x")}), B.Sheet("B", {(0, 0): B.Cell("string", "y")})])
    (tmp_path / "made.xlsx").write_bytes(made)
    script = tmp_path / "office"
    script.write_text(f"""#!/bin/sh
echo "$@" >> {tmp_path}/log
while [ $# -gt 1 ]; do case $1 in --convert-to) to=$2;; --outdir) out=$2;; esac; shift; done
case $to in xlsx) cp {tmp_path}/made.xlsx $out/in.$to;; bad) exit 1;; *) cp $1 $out/in.$to;; esac
""")
    script.chmod(0o755)
    monkeypatch.setattr(C, "office_path", lambda: str(script))
    one = lambda a, b, o=ConvertOptions(): C.first_success(C.converters(a, b, options=o))
    for a, b in C.OFFICE_TOO:
        if (a, b) not in (("doc", "markdown"), ("eml", "pdf"), ("msg", "pdf")):
            assert one(a, b)(b"body") == b"body", (a, b)
    assert b"<" in one("eml", "pdf")(b"Subject: s\r\n\r\ntext")
    assert b"<pre>text" in one("msg", "pdf")(outlook.from_mail(b"Subject: s\r\n\r\ntext"))
    assert [f[3] for f in C.first_success(C.splitters("xls"))(b"old")] == ["A", "B"]
    assert C.any_text(b"old", "xls") == "A\n\tx\nB\n\ty"
    log = (tmp_path / "log").read_text()
    assert "--infilter=writer_pdf_import" in log and len({w for w in log.split() if "UserInstallation" in w}) == 1
    setup = one("xlsx", "pdf", ConvertOptions(landscape=True, paper_size="A3", one_sheet_per_page=True, sheet_names=("B",)))(made)
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(setup)) as z:
        sheet, book = z.read("xl/worksheets/sheet1.xml").decode(), z.read("xl/workbook.xml").decode()
    assert '<pageSetup paperSize="8" orientation="landscape" fitToWidth="1" fitToHeight="1"/></worksheet>' in sheet and '<sheetPr><pageSetUpPr fitToPage="1"/></sheetPr><sheetData>' in sheet
    assert 'state="hidden" name="A"' in book and 'state="hidden" name="B"' not in book
    assert [s.hidden for s in B.read_workbook(setup)] == [True, False]


def test_requests_with_options(spark):
    from docloom.operators import workbook as B
    from docloom.plans.requests import convert_requests, info_requests, split_requests

    made = B.write_xlsx([B.Sheet(n, {(0, 0): B.Cell("string", n)}, n == "C") for n in "ABC"])
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
    rows = [(1, made, kind, "csv", "B", None, None), (2, made, kind, "csv", None, "secret", None), (3, made, kind, "csv", None, None, None)]
    asked = spark.createDataFrame(rows, "request_id long, body binary, content_type string, target string, sheet string, password string, exclude_hidden string").selectExpr("*", "CAST(NULL AS STRING) AS backend", "CAST(NULL AS STRING) AS detect")
    got = {r.request_id: (r.status, bytes(r.body)) for r in convert_requests(spark, asked).collect()}
    assert got[1] == (200, b"B") and got[2][0] == 503 and got[3] == (200, b"A")
    import io
    import zipfile

    parts = split_requests(spark, asked.where("request_id = 3").withColumns({"sheet": F.lit("A,C"), "exclude_hidden": F.lit("true")})).first()
    assert zipfile.ZipFile(io.BytesIO(parts.body)).namelist() == ["1__A.xlsx"]
    import json

    found = {r.request_id: json.loads(r.json) for r in info_requests(spark, asked.unionByName(asked.limit(1).withColumns({"request_id": F.lit(9).cast("long"), "body": F.lit(b"%PDF-junk").cast("binary"), "content_type": F.lit("application/pdf")}))).collect()}
    assert found[3]["fragmentCount"] == 3 and found[3]["size"] == len(made) and "metadata" not in found[9] and "fragmentCount" not in found[9] and found[9]["canSplit"]
