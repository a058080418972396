import io
import json
import struct
import zipfile
import zlib

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.functions.mime import SHORT
from docloom.functions.options import ConvertOptions
from docloom.operators import archive, convert as C, info, mail, pdf, slides, text_split, watermark as W, word, workbook as B
from docloom.operators.base import ConversionError, split_documents


def fragments(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy("index").collect()]


@pytest.mark.parametrize("text,want", [("", []), ("a", ["a"]), ("a\n\nb", ["a", "b"]), ("a\n \t\n\nb", ["a", "b"]), ("\n\n a \n\n\n\n b\t\n\n", ["a", "b"]), (" \n\n ", []), ("a\r\n\r\nb", ["a", "b"]), ("a\n\x0b\nb", ["a", "b"]), ("a\n\xa0\nb", ["a\n\xa0\nb"]), ("\x1fa\x1f\n\nb", ["a", "b"]), (None, [])])
def test_paragraphs(spark, text, want):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = fragments(text_split.split_paragraphs(df), "index", "label", "total", "text")
    assert got == [(i, f"Paragraph {i + 1}", len(want), t) for i, t in enumerate(want)]
    if text is not None:
        assert [f[0].decode() for f in C.splitter("core", "plain")(text.encode())] == want


@pytest.mark.parametrize("text,want", [("", []), ("h", []), ("h\n", []), ("h\r\na\r\n\r\nb\n", [("Row 2", "h\na"), ("Row 3", "h\nb")]), ('h\n"a\nb"', [("Row 2", 'h\n"a'), ("Row 3", 'h\nb"')]), ("\nx", [("Row 2", "\nx")])])
def test_csv_rows(spark, text, want):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [x[1:] for x in fragments(text_split.split_csv_rows(df), "index", "label", "text")] == want
    assert [(f[3], f[0].decode()) for f in C.splitter("core", "csv")(text.encode())] == want


def zip_of(entries):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return raw.getvalue()


def test_zip_modes(spark):
    content = zip_of([("folder/", b""), ("folder/file.txt", b"x"), ("__MACOSX/a", b""), ("._b", b""), ("pdf", b"p"), ("a.txt.", b"t"), ("b.unknown", b"")])
    assert [(f[3], f[2], f[1]) for f in archive.split_zip(content)] == [("file.txt", 0, "text/plain"), ("pdf", 1, "application/pdf"), ("a.txt.", 2, "text/plain"), ("b.unknown", 3, "application/octet-stream")]
    assert [(f[3], f[2]) for f in archive.split_zip(content, "full")][:3] == [("folder/file.txt", 1), ("__MACOSX/a", 2), ("._b", 3)]
    df = spark.createDataFrame([(1, content), (2, b"no zip"), (3, None), (4, zip_of([]))], "doc_id long, content binary")
    got = {d: (n, e) for d, n, e in [tuple(r) for r in archive.split_archives(df).groupBy("doc_id").agg(F.count("*"), F.max("error.type")).collect()]}
    assert got == {1: (4, None), 2: (1, "Split")}


def test_too_large_entry_leaves_the_others(spark, monkeypatch):
    content = zip_of([("a.txt", b"1"), ("big.txt", b"x" * 50), ("b.txt", b"2")])
    monkeypatch.setattr(archive, "MAX_ENTRY_BYTES", 10)
    found = archive.split_zip(content)
    assert [f[3] for f in found] == ["a.txt", "big.txt", "b.txt"]

    def bounded(c):
        was, archive.MAX_ENTRY_BYTES = archive.MAX_ENTRY_BYTES, 10
        try:
            return archive.split_zip(c)
        finally:
            archive.MAX_ENTRY_BYTES = was

    got = split_documents(spark.createDataFrame([(1, content)], "doc_id long, content binary"), bounded).collect()
    assert [(r.label, r.content and bytes(r.content), r.total, r.error and r.error.type) for r in got] == [("a.txt", b"1", 3, None), ("big.txt", None, 3, "Resource"), ("b.txt", b"2", 3, None)]
    with pytest.raises(ConversionError):
        C.any_text(content, "zip")


def test_zip_sink_orders_entries_and_repeats_bytes(spark):
    df = spark.createDataFrame([(1, i, f"{i:02d}.txt", b"x" * i) for i in (3, 1, 2, 300)], "doc_id long, index int, filename string, content binary")
    zips = [archive.zip_fragments(df.repartition(n), ["doc_id"]).first().content for n in (1, 4)]
    assert zips[0] == zips[1] and [f[3] for f in archive.split_zip(zips[0])] == ["01.txt", "02.txt", "03.txt", "300.txt"]


def test_mail():
    raw = mail.build_mail("Subject é", "body", [("a.txt", b"1"), ("b.txt", b"2")])
    assert [(f[0].strip(), f[1], f[2], f[3]) for f in mail.split_mail(raw)] == [(b"body", "text/plain", 0, "Subject é"), (b"1", "text/plain", 1, "a.txt"), (b"2", "text/plain", 2, "b.txt")]
    assert [f[3] for f in mail.split_mail(raw, False)] == ["a.txt", "b.txt"]
    plain = b"From: a@b\r\n\r\nx <y>\r\n"
    assert [(f[3], f[1]) for f in mail.split_mail(plain)] == [("body", "text/plain")] and "x &lt;y&gt;" in mail.mail_to_html(plain)
    inline = b'MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: image/png\r\nContent-Disposition: inline\r\nContent-Transfer-Encoding: base64\r\n\r\neA==\r\n--B\r\nContent-Type: text/html\r\n\r\n<b>\r\n--B\r\nContent-Type: text/plain\r\n\r\nlater\r\n--B--\r\n'
    assert [(f[3], f[1]) for f in mail.split_mail(inline)] == [("attachment_0", "image/png"), ("body", "text/html")]


def book():
    data = B.Sheet("Data", {(r, c): B.Cell("number" if c == 1 and r else "string", v) for r, row in enumerate([("Name", "Value", "Category"), ("x", "100", "A"), ("y", "200", "B"), ("z", "300", "A")]) for c, v in enumerate(row)})
    total = B.Sheet("Summary", {(0, 0): B.Cell("string", "Category"), (0, 1): B.Cell("string", "Total"), (1, 0): B.Cell("string", "A"), (1, 1): B.Cell("number", "", "SUMIF(Data!C2:C4,A2,Data!B2:B4)"), (2, 0): B.Cell("string", "B"), (2, 1): B.Cell("number", "", "=SUM(Data!B2:B3)/2-(1+2)*5"), (3, 1): B.Cell("number", "", "NOPE(A1)")})
    return B.write_xlsx([data, total, B.Sheet("Gone <&>", {(0, 0): B.Cell("boolean", "true")}, hidden=True)])


def test_workbook_sheets_and_formulas():
    found = B.split_workbook(book())
    assert [(f[3], f[2], f[1]) for f in found] == [("Data", 0, SHORT["xlsx"]), ("Summary", 1, SHORT["xlsx"]), ("Gone <&>", 2, SHORT["xlsx"])]
    summary = B.read_workbook(found[1][0])[0]
    assert summary.cells[1, 1].value == "400" and summary.cells[2, 1].value == "135" and summary.cells[3, 1].formula == "NOPE(A1)"
    assert [f[3] for f in B.split_workbook(book(), ("Summary", "Gone <&>"), exclude_hidden=True)] == ["Summary"]
    assert B.read_workbook(found[2][0])[0].cells[0, 0] == B.Cell("boolean", "true")
    with pytest.raises(ConversionError):
        B.split_workbook(B.write_xlsx([]))


def test_workbook_targets():
    assert B.to_csv(book(), ("Summary",)) == "Category,Total\nA,400\nB,135\n,"
    assert json.loads(B.to_json(book()))[0] == {"Name": "x", "Value": "100", "Category": "A"}
    assert B.to_markdown(book()).split("\n")[1] == "| --- | --- | --- |"
    assert "Gone" not in B.to_html(book()) and "<td>400</td>" in B.to_html(book())
    ods = B.xlsx_to_ods(book())
    sheets = B.read_workbook(ods)
    assert [s.name for s in sheets] == ["Data", "Summary", "Gone <&>"] and sheets[2].hidden and sheets[1].cells[1, 1] == B.Cell("string", "SUMIF(Data!C2:C4,A2,Data!B2:B4)")
    assert [f[1] for f in B.split_workbook(ods)] == [SHORT["ods"]] * 3
    assert B.read_workbook(B.ods_to_xlsx(ods))[0].grid() == sheets[0].grid()
    gaps = B.Sheet("g", {(5, 3): B.Cell("string", 'a"b\nc,d'), (2, 0): B.Cell("number", "1.5")})
    for write in (B.write_xlsx, B.write_ods):
        assert B.read_workbook(write([gaps]))[0].cells == gaps.cells
    assert B.read_workbook(B.from_csv(b'a,"b,c"\r\n1,2.5'))[0].grid() == [["a", "b,c"], ["1", "2.5"]]


def ods_of(rows):
    names = " ".join(f'xmlns:{k}="urn:oasis:names:tc:opendocument:xmlns:{k}:1.0"' for k in ("office", "table", "text"))
    return zip_of([("content.xml", f'<office:document-content {names}><table:table table:name="S">{rows}</table:table></office:document-content>'.encode())])


def test_ods_repeats_with_content_are_whole(spark):
    one = lambda x, n=1: f'<table:table-cell office:value-type="float" office:value="{x}" table:number-columns-repeated="{n}"><text:p>{x}</text:p></table:table-cell>'
    rows = f'<table:table-row table:number-rows-repeated="50000">{one(2)}</table:table-row><table:table-row>{one(3, 12000)}</table:table-row>'
    empty = '<table:table-row table:number-rows-repeated="900000"><table:table-cell table:number-columns-repeated="16384"/></table:table-row>'
    sheet = B.read_workbook(ods_of(rows + empty))[0]
    assert len(sheet.cells) == 62000 and sheet.cells[49_999, 0].value == "2" and sheet.cells[50_000, 11_999].value == "3"
    assert len(B.to_csv(ods_of(rows.split("<table:table-row>")[0] + empty)).split("\n")) == 50_000
    total = '<table:table-row><table:table-cell/><table:table-cell office:value-type="float" table:formula="SUM(A1:A50000)"/></table:table-row>'
    assert B.freeze(made := B.read_workbook(ods_of(rows.split("<table:table-row>")[0] + total))[0], B.Values([made])).cells[50_000, 1].value == "100000"
    much = ods_of(f'<table:table-row table:number-rows-repeated="1048576">{one(1, 16384)}</table:table-row>')
    got = B.split_workbooks(spark.createDataFrame([(1, much)], "doc_id long, content binary")).collect()
    assert len(got) == 1 and got[0].error.type == "Resource" and got[0].content is None


def test_word():
    doc = word.write_docx([[("Heading1", "Top"), ("", "one <x>")], [[["a", "b"], ["c", "d"]]], [("", "last\nline")]])
    assert word.to_text(doc) == "Top\none <x>\na\tb\nc\td\n\nlast\nline" or word.to_text(doc).split("\n")[0] == "Top"
    parts = word.split_sections(doc)
    assert [(f[3], f[2]) for f in parts] == [("Section 1", 0), ("Section 2", 1), ("Section 3", 2)]
    assert word.to_text(parts[0][0]) == "Top\none <x>" and word.to_text(parts[2][0]) == "last\nline"
    assert word.to_html(parts[0][0]) == "<html><body><h1>Top</h1><p>one &lt;x&gt;</p></body></html>"
    assert word.to_markdown(parts[0][0]) == "# Top\n\none <x>" and word.to_markdown(parts[1][0]).startswith("| a | b |\n| --- | --- |")
    assert [f[3] for f in word.split_whole(doc)] == ["Document"]
    with pytest.raises(zipfile.BadZipFile):
        word.split_whole(b"no")


def test_macros_are_dropped():
    doc = word.write_docx([[("", "x")]])
    with zipfile.ZipFile(io.BytesIO(doc)) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["[Content_Types].xml"] = parts["[Content_Types].xml"].replace(b"application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml", b"application/vnd.ms-word.document.macroEnabled.main+xml").replace(b"</Types>", b'<Default Extension="bin" ContentType="application/vnd.ms-office.vbaProject"/></Types>')
    clean = word.drop_macros(zip_of([*parts.items(), ("word/vbaProject.bin", b"m")]))
    with zipfile.ZipFile(io.BytesIO(clean)) as z:
        assert "word/vbaProject.bin" not in z.namelist() and b"macroEnabled" not in z.read("[Content_Types].xml") and b"vba" not in z.read("[Content_Types].xml")
    assert word.to_text(clean) == "x"


def test_slides():
    deck = slides.write_pptx([("Intro & more", "a"), ("", "b\nc"), ("End", "")])
    parts = slides.split_slides(deck)
    assert [(f[3], f[2]) for f in parts] == [("Intro & more", 0), ("Slide 2", 1), ("End", 2)] and [f[3] for f in slides.split_slides(deck, False)] == ["Slide 1", "Slide 2", "Slide 3"]
    assert [slides.to_text(f[0]) for f in parts] == ["Intro & more\na", "b\nc", "End"]
    with zipfile.ZipFile(io.BytesIO(parts[1][0])) as z:
        assert [n for n in z.namelist() if n.startswith("ppt/slides/")] == ["ppt/slides/slide2.xml"]
    assert "<h2>Intro &amp; more</h2><p>a</p>" in slides.to_html(deck)
    with pytest.raises(ConversionError):
        slides.split_slides(slides.write_pptx([]))
    assert slides.split_slides(slides.write_pptx([]), False) == []


def test_pdf_pages():
    doc = pdf.from_text(["Page (one)\\", "two\nlines", ""])
    parts = pdf.split_pages(doc)
    assert [f[3] for f in parts] == ["Page 1", "Page 2", "Page 3"] and all(f[0].startswith(b"%PDF-") for f in parts)
    assert [pdf.to_text(f[0]) for f in parts] == ["Page (one)\\", "two\nlines", ""]
    assert len(parts[0][0]) < len(doc)
    assert "<p>two</p>" in pdf.to_html(doc)
    for bad in (b"text", b"%PDF-1.4\ntrailer << /Encrypt 5 0 R >>"):
        with pytest.raises(ConversionError):
            pdf.split_pages(bad)


def test_images_to_pdf():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" + bytes(6))) + chunk(b"IEND", b"")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x03\x00\x05\x03" + bytes(9) + b"\xff\xd9"
    for image, size, how in ((png, b"/Width 2 /Height 1", b"/FlateDecode"), (jpeg, b"/Width 5 /Height 3", b"/DCTDecode")):
        out = pdf.from_image(image)
        assert len(pdf.Pdf(out).pages()) == 1 and size in out and how in out


MARK = b"/Artifact << /Subtype /Watermark >> BDC\nq\n1 0 0 rg\n10 10 m\n90 90 l\nS\nQ\nEMC\n"
LOGO = b"q\n0 1 0 rg\n5 5 m\n6 6 l\nS\nQ\n"


def test_watermarks():
    clean = lambda pages, **o: [pdf.Pdf(x).contents(pdf.Pdf(x).pages()[0]) for x, *_ in pdf.split_pages(pdf.remove_watermarks(pdf.write_pdf(pages), **o))]
    text = [pdf.text_page(t) for t in ("a", "b", "c")]
    assert all(b"Watermark" not in p and b"Tj" in p for p in clean([t + MARK for t in text]))
    # drawing that stands before the text, or on one page only, stays
    assert all(b" rg" in p for p in clean([LOGO + t for t in text]))
    assert b" rg" in clean([text[0] + LOGO, text[1]])[0]
    # the same on several pages goes
    assert not any(b" rg" in p for p in clean([t + LOGO for t in text]))
    long = b"".join(b"q\n/G%d gs\n%d 1 m\n2 2 l\nS\nQ\n" % (i, 3) for i in range(3))
    got = clean([t + long + extra for t, extra in zip(text, (b"", LOGO, LOGO))])
    assert b"gs" not in got[0] and b" rg" in got[1]
    assert b" rg" not in clean([text[0] + LOGO, text[1]], aggressive=True)[0]
    # an unsafe operator after the text keeps all of it
    assert all(b" rg" in p for p in clean([t + LOGO + b"/Im1 Do\n" for t in text]))


def test_watermark_expressions(spark):
    ops = [["BT", "(a) Tj", "ET", "q", "1 1 m", "S", "Q"], ["ET", "/Im Do", "S"], ["q", "Q"], ["1 1 m"], []]
    df = spark.createDataFrame([(i, o) for i, o in enumerate(ops)], "i int, ops array<string>")
    assert [tuple(r) for r in df.orderBy("i").select(F.size(W.trailing_ops(F.col("ops"))), W.trailing_count(F.col("ops"))).collect()] == [(4, 4), (2, 0), (0, 0), (0, 0), (0, 0)]  # nothing trails on a page without text


def test_convert_falls_back(spark):
    df = spark.createDataFrame([(1, b"a,b\r\n1,<2>"), (2, None)], "doc_id long, content binary")
    got = {r.doc_id: r for r in C.convert(df, "csv", "html").collect()}
    assert got[1].result == b"<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>&lt;2&gt;</td></tr></table>" and got[2].result is None and got[2].error is None
    r = C.convert(df.where("doc_id = 1"), "docx", "pdf").first()
    assert r.result is None and (r.error.type, r.error.http_status) == ("Resource", 503)
    assert C.convert(df.where("doc_id = 1"), "zip", "docx").first().error.type == "UnsupportedConversion"
    assert C.convert(df.where("doc_id = 1"), "xlsx", "csv").first().error.type == "Render"
    assert C.convert(df.where("doc_id = 1"), "csv", "csv").first().result == b"a,b\r\n1,<2>"
    empty = spark.createDataFrame([(1, b"")], "doc_id long, content binary")
    assert C.convert(empty, "docx", "plain", backend="core").first().error.type == "Parse"
    assert C.converter("commercial", "xlsx", "csv", ConvertOptions(sheet_names=("Summary",)))(book()).startswith("Category,Total")
    with pytest.raises(ConversionError):
        C.converter("commercial", "pdf", "pdf")(pdf.from_text(["x"]))
    assert pdf.to_text(C.converter("commercial", "pdf", "pdf", ConvertOptions(remove_watermarks=True))(pdf.from_text(["x"]))) == "x"


def test_text_of_containers():
    content = zip_of([("a.txt", b"hello"), ("b.html", b"<p>x &amp; y</p><script>z</script>"), ("c.docx", word.write_docx([[("", "w")]])), ("d.bin", b"\0")])
    assert C.any_text(content, "zip") == "a.txt\nhello\nb.html\nx & y\nc.docx\nw\nd.bin\n"
    assert "<p>400</p>" not in C.any_xml(book(), "xlsx") and "A\t400" in C.any_xml(book(), "xlsx")


def test_splits_by_backend():
    raw = mail.build_mail("s", "b", [("a.txt", b"1")])
    assert len(C.splitter("core", "eml")(raw)) == 2 and len(C.splitter("commercial", "eml")(raw)) == 1
    with pytest.raises(ConversionError, match="can't split"):
        C.splitter("office", "eml")(raw)
    with pytest.raises(ConversionError):
        C.splitter("commercial", "msg")(raw)


def test_clashing_names_are_refused(spark):
    df = spark.createDataFrame([(1, b"", "x")], "doc_id long, content binary, label string")
    with pytest.raises(ValueError):
        archive.split_archives(df)


def test_info(spark):
    assert info.metadata_of(b"") == {} and set(info.metadata_of(b"PKbroken")) == {"fileSize", "detectedType"}
    assert info.metadata_of(pdf.from_text(["a", "b"]))["xmpTPg:NPages"] == ["2"]
    core = zip_of([("docProps/core.xml", b'<x xmlns:dc="d"><dc:title>T</dc:title><dc:creator>A</dc:creator></x>'), ("docProps/app.xml", b"<x><Words>7</Words></x>")])
    df = info.extract_metadata(spark.createDataFrame([(1, core)], "doc_id long, content binary"))
    r = df.select(*[c.alias(n) for n, c in info.info_columns(F.col("raw_metadata")).items()]).first()
    assert (r.title, r.author, r.word_count, r.page_count, r.created) == ("T", "A", 7, 0, None)


def test_made_rows_are_handed_on_early(spark):
    """Fragments of many documents leave Python in small batches, whatever the batch they came in."""

    class Frame:
        columns, schema = ["doc_id", "content"], StructType.fromDDL("doc_id int, content binary")
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "content": [b"x"] * 100}, schema=pa.schema([("doc_id", pa.int32()), ("content", pa.binary())]))
    run = split_documents(Frame(), lambda c: [(c * 20_000, "m", i, "l") for i in range(5)])
    made = list(run(iter([docs])))
    assert max(b.nbytes for b in made) < 2 << 20
    assert [x for b in made for x in b.column(0).to_pylist()] == [i for i in range(100) for _ in range(5)] and sum(len(x) for b in made for x in b.column(1).to_pylist()) == 10_000_000


def test_upper_keeps_the_length():
    """A capital for a character, as SQL's upper has it."""
    given = "straße éñ ŉ ﬁ ᾳ ΐ 1a"
    book = B.write_xlsx([B.Sheet("S", {(0, 0): B.Cell("string", "", 'UPPER(B1)&LEN(UPPER("Fuß"))'), (0, 1): B.Cell("string", given)})])
    (content, *_), = B.split_workbook(book)
    assert B.read_workbook(content)[0].cells[0, 0].value == duckdb.execute("SELECT upper(?)", [given]).fetchone()[0] + "3" == "STRAẞE ÉÑ ŉ ﬁ ᾼ ΐ 1A3"


def test_formulas():
    cells = {(0, 0): 5.0, (1, 0): 9.0, (2, 0): "apple", (3, 0): "Apricot", (0, 1): "k", (1, 1): "m", (0, 2): 10.0, (1, 2): 20.0}
    data = B.Sheet("It's", {at: B.Cell("number" if isinstance(v, float) else "string", B.number_text(v) if isinstance(v, float) else v) for at, v in cells.items()})

    def value(text, **more):
        home = B.Sheet("H", {(0, 0): B.Cell("number", "", text)} | {B.parse_reference(k): B.Cell("number", "", v) for k, v in more.items()})
        return B.freeze(home, B.Values([home, data]), True).cells[0, 0]

    s = "'It''s'!"
    for text, want in {
        f'SUMIF({s}A1:A2,">6")': "9", f'SUMIF({s}A1:A4,"a*",{s}C1:C4)': "0", f"SUM({s}A1:C2,1)": "45", f"AVERAGE({s}A1:A4)": "7", f'COUNTIF({s}A1:A4,"ap*")': "2", f'COUNTIF({s}A1:A4,"<>9")': "3",
        f"COUNTIF({s}A1:A4,5)": "1", f'COUNTIFS({s}A1:A2,">1",{s}B1:B2,"m")': "1", f"VLOOKUP(\"m\",{s}B1:C2,2,FALSE)": "20", f"MIN({s}A1:A4)&\"-\"&MAX({s}A1:A4)": "5-9", f"COUNT({s}A1:C4)": "4", f"COUNTA({s}A1:A9)": "4",
        "ROUND(2.5,0)": "3", "ROUND(-1.25,1)": "-1.3", "-2^2": "4", "2+3*4-10/4": "11.5", "50%*8": "4", 'IF(1>2,1/0,"no")': "no", 'IF(AND(1<2,NOT(FALSE)),"yes",1/0)': "yes", "IFERROR(1/0,7)": "7", "IFERROR(3,7)": "3",
        'CONCATENATE("a",1,TRUE)': "a1TRUE", 'LEN("a""b")': "3", 'LEFT("abc",2)&RIGHT("abc")&MID("abc",2,1)': "abcb", '"b">"A"': "true", "MOD(-3,2)": "1", 'TRIM("  a   b ")': "a b", "Z9+1": "1",
    }.items():
        assert value(text).value == want, text
    for refused in ("NOSUCH(1)", "1/0", '"a"+1', "VLOOKUP(1,A2:B3,9)", "SUM(", "A1", f"VLOOKUP(\"zz\",{s}B1:C2,2,FALSE)"):
        found = value(refused)
        assert found.formula == refused if "!" not in refused else found.value == "#REF!", refused
    assert value("B1+1", B1="C1", C1="B1").formula == "B1+1"
    # a chain in which each cell needs the one before twice
    n = 3000
    chain = B.Sheet("S", {(0, 0): B.Cell("number", "1")} | {(i, 0): B.Cell("number", "", f"(A{i}+A{i})/2") for i in range(1, n)})
    assert B.freeze(chain, B.Values([chain])).cells[n - 1, 0].value == "1"


def test_watermarks_leave_other_content():
    ops = lambda text: [(t.encode(), t.rsplit(" ", 1)[-1].encode()) for t in text.split(";")]
    mark, draw = "/Artifact << /Subtype /Watermark >> BDC;1 1 m;S;EMC", "0 0 m;9 9 l;S"
    assert pdf.strip_marked(ops(f"ET;{mark}")) == ops("ET")
    for kept in (f"0 0 m;9 9 l;S;{mark}", f"ET;{draw};{mark}", f"ET;/Span BMC;{draw};EMC;{mark}", f"ET;{mark};EMC", f"ET;/Watermark BMC;{draw}", f"ET;{mark};/Im1 Do", "ET;/Watermark BMC;EMC", draw):
        assert pdf.strip_marked(ops(kept)) == ops(kept), kept
    assert pdf.strip_marked(ops(f"ET;/Watermark BMC;q;{draw};Q;EMC")) == ops("ET")
    assert pdf.removable(ops(draw)) == 0 and pdf.removable(ops(f"ET;{draw}")) == 3
    assert pdf.clean_pages([ops(draw)] * 3, aggressive=True) == [ops(draw)] * 3


def test_what_cannot_be_read_is_a_parse_error(spark):
    from docloom.operators import convert as C

    junk = spark.createDataFrame([(1, bytearray(b"junk"))], "id long, content binary")
    for source in ("docx", "xlsx", "pptx", "pdf"):
        for target in ("plain", "xml"):
            e = C.convert(junk, source, target).first().error
            assert (e.type, e.http_status) == ("Parse", 400), (source, target, e)
