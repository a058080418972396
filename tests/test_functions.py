import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import errors, mime as M, naming, paths, text as T
from docloom.functions.options import ConvertOptions, paper_size


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_type_parts(spark):
    m = F.lit(" Application/PDF; v=1")
    r = one(spark, M.parse(m), M.base_type(F.lit("text")), M.sub_type(F.lit("text")), M.sub_type(F.lit("a/b;c")), M.known(F.lit("TEXT/Plain")), M.known(F.lit("x/y")))
    assert tuple(r) == ("application/pdf", "text", "", "b", "text/plain", None)


@pytest.mark.parametrize("name,want", [("my.file.name.pdf", "application/pdf"), ("README", M.OCTET), (".gitignore", M.OCTET), ("a.", M.OCTET), ("A.JPEG", "image/jpeg"), ("x.heif", "image/heic")])
def test_from_filename(spark, name, want):
    assert one(spark, M.from_filename(F.lit(name)))[0] == want


def test_detection_reads_the_whole_content(spark):
    def zipped(*entries, comment=b""):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for name, data in entries:
                z.writestr(name, data)
            z.comment = comment
        return raw.getvalue()

    long = ("[Content_Types].xml", b"x" * 9000)
    inner = zipped(("word/document.xml", b"w"))
    cases = [zipped(long, ("word/document.xml", b"w")), zipped(long, ("xl/workbook.xml", b"w"), comment=b"c" * 3000), zipped(long, ("ppt/presentation.xml", b"w")), zipped(("a.docx", inner), ("keyword/x", b"")), b" " * 300 + b"<html>", b" " * 5000 + b"<?xml?>"]
    want = [M.SHORT["docx"], M.SHORT["xlsx"], M.SHORT["pptx"], M.SHORT["zip"], "text/html", M.SHORT["xml"]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, content binary")
    assert [r.m for r in df.select("i", M.sniff("content").alias("m")).orderBy("i").collect()] == want


def test_detection(spark):
    pdf = F.lit(b"%PDF-1.4")
    r = one(spark, M.detect_lazily(pdf, F.lit("renamed.txt")), M.detect(pdf, F.lit("renamed.txt")), M.sniff(F.lit(b"")), M.sniff(F.lit(b"\xff\xfe\x00")), M.sniff(F.lit(b"PK\x03\x04" + b"\0" * 26 + b"xl/workbook.xml")), M.sniff(F.lit(b"  <HTML>")))
    assert tuple(r) == ("text/plain", "application/pdf", M.OCTET, M.OCTET, M.SHORT["xlsx"], "text/html")
    header = F.lit("text/csv")
    html = F.lit(b"<html></html>")
    r = one(spark, M.detect_request(header, html), M.detect_request(header, html, F.lit(True)), M.detect_request(F.lit(M.OCTET), html), M.detect_request(F.lit(None).cast("string"), html))
    assert tuple(r) == ("text/csv", "text/html", "text/html", "text/html")


@pytest.mark.parametrize("i,n,name,ext,want", [(1, 5, "Sheet 1", "xlsx", "1__Sheet 1.xlsx"), (3, 15, "Q1 Results", "xlsx", "03__Q1 Results.xlsx"), (42, 100, "Page 42", "pdf", "042__Page 42.pdf"), (7, 1000, "Slide 7", ".pptx", "0007__Slide 7.pptx"), (1, 10, "Sheet: Q1/Q2", "xlsx", "01__Sheet_ Q1_Q2.xlsx"), (1234, 10, "x", "a", "1234__x.a")])
def test_fragment_filename(spark, i, n, name, ext, want):
    assert one(spark, naming.fragment_filename(F.lit(i), F.lit(n), F.lit(name), F.lit(ext)))[0] == want


def test_names(spark):
    r = one(spark, naming.sanitize(F.lit('a\\b/c:d*e?f"g<h>i|j.é')), F.length(naming.sanitize(F.lit("A" * 250))), naming.label_or_default(F.lit(None).cast("string"), F.lit(2)), naming.padding_width(F.lit(0)))
    assert tuple(r) == ("a_b_c_d_e_f_g_h_i_j.é", 200, "part-3", 1)


@pytest.mark.parametrize("n,want", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.3 KB"), (5 << 20, "5.0 MB"), (3 << 30, "3.0 GB")])
def test_format_size(spark, n, want):
    assert one(spark, T.format_size(F.lit(n)))[0] == want


def test_text(spark):
    r = one(spark, T.trim_controls(F.lit("\x00 a\xa0\x1f")), T.decode_utf8(F.lit(b"a\xffb")), T.escape_xml(F.lit("<a b=\"'\">&")), T.html_to_text(F.lit("<head>x</head><p>a<script>s</script>&lt;b</p>")))
    assert tuple(r) == ("a\xa0", "a�b", "&lt;a b=&quot;&apos;&quot;&gt;&amp;", "a <b")


def test_metadata(spark):
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    r = one(spark, T.metadata_text(T.with_metadata(m, "a", F.lit("9"))), T.metadata_text(T.without_metadata(m, "a")), T.metadata_text(T.merge_metadata(m, F.create_map(F.lit("b"), F.lit("3"), F.lit("c"), F.lit("4")))), T.first_of(m, "x", "b"))
    assert tuple(r) == ("a=9;b=2", "b=2", "a=1;b=3;c=4", "2")


@pytest.mark.parametrize("path,entry,listed", [("__MACOSX/a", True, True), ("x/__MACOSX/a", True, True), ("._a", True, True), ("a/._x", False, True), ("a/.DS_Store", True, True), ("x/.Trashes", False, True), ("a.txt", False, False), ("DS_Store", False, False)])
def test_mac_names(spark, path, entry, listed):
    assert tuple(one(spark, paths.is_mac_entry(F.lit(path)), paths.is_mac_metadata(F.lit(path)))) == (entry, listed)


@pytest.mark.parametrize("w,h,want", [(10, 10, (10, 10)), (1600, 600, (800, 300)), (100, 6000, (10, 600)), (1, 90_000, (1, 600))])
def test_fit(spark, w, h, want):
    assert tuple(one(spark, paths.fit_dimensions(F.lit(w), F.lit(h), F.lit(800), F.lit(600)))[0]) == want


def test_errors_and_options(spark):
    r = one(spark, errors.error("Resource", F.lit("x")), errors.composite_message(F.array(F.lit("a"), F.lit("b"))))
    assert tuple(r[0]) == ("Resource", "x", None, 503) and r[1] == "2 errors occurred: a; b"
    o = ConvertOptions(password="p", landscape=False, sheet_names=("A", "B"), flowing_layout=False)
    assert o.summary() == "password, portrait, sheet=A,B, fixed-layout" and not o.is_default() and ConvertOptions().is_default()
    assert paper_size("a4") == "A4" and paper_size("b9") is None
