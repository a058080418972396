"""Information without the body: few bytes read, and the same as the readers of whole files find."""

import os
import re
import time
import zipfile
import zlib

from docloom.functions.mime import SHORT
from docloom.operators import pdf, workbook
from docloom.operators.archive import build_zip
from docloom.sources.information import information, read_information

CORE = b'<cp:coreProperties xmlns:cp="c" xmlns:dc="d" xmlns:dcterms="t"><dc:title>Big &amp; small</dc:title><dc:creator>A. Writer</dc:creator><dcterms:created>2024-01-02</dcterms:created></cp:coreProperties>'


def of(path):
    names = ["path", "size", "mime", "entries", "parts", "raw", "bytes_read", "error"]
    row = dict(zip(names, information(str(path))))
    row["raw"] = dict(row["raw"])
    return row


def test_a_large_workbook_costs_no_more_than_a_small_one(tmp_path):
    path = tmp_path / "large.xlsx"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", '<workbook xmlns="m"><sheets><sheet name="First"/><sheet name="Second"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            for _ in range(208):
                f.write(bytes(1 << 20))
        z.writestr("docProps/core.xml", CORE)
    began = time.time()
    row = of(path)
    assert time.time() - began < 1
    assert row["size"] > 208 << 20 and row["bytes_read"] < 1 << 20
    assert (row["entries"], row["parts"], row["error"]) == (4, 2, None)
    assert row["raw"]["dc:title"] == ["Big & small"] and row["raw"]["sheetNames"] == ["First", "Second"]


def packed_pdf(pages=7):
    """A file of version 1.5: objects in an object stream, a cross-reference stream with a predictor."""
    inner = {2: b"<< /Type /Pages /Count %d /Kids [] >>" % pages, 3: rb"<< /Title (In \(brackets\)) /Author <feff> /CreationDate (D:2024) >>", 4: b"<< /Type /Catalog /Pages 2 0 R >>"}
    heads, body = [], b""
    for n, o in inner.items():
        heads.append(b"%d %d" % (n, len(body)))
        body += o + b" "
    first = b" ".join(heads) + b" "
    packed = zlib.compress(first + body)
    out = b"%PDF-1.5\n" + b"% filler " * 40_000 + b"\n"
    at5 = len(out)
    out += b"5 0 obj\n<< /Type /ObjStm /N 3 /First %d /Length 7 0 R /Filter /FlateDecode >>\nstream\r\n%s\r\nendstream\nendobj\n" % (len(first), packed)
    at7 = len(out)
    out += b"7 0 obj\n%d\nendobj\n" % len(packed)
    at6 = len(out)
    rows = [(0, 0, 255), (2, 5, 0), (2, 5, 1), (2, 5, 2), (1, at5, 0), (1, at6, 0), (1, at7, 0)]
    plain = [bytes([k]) + a.to_bytes(4, "big") + bytes([b]) for k, a, b in rows]
    up, above = b"", bytes(6)
    for r in plain:
        up += b"\x02" + bytes((x - y) & 255 for x, y in zip(r, above))
        above = r
    data = zlib.compress(up)
    out += b"6 0 obj\n<< /Type /XRef /Size 8 /Index [0 1 2 6] /W [1 4 1] /Root 4 0 R /Info 3 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 6 >> /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(data), data)
    return out + b"startxref\n%d\n%%%%EOF\n" % at6


def test_pdf_by_table_and_by_stream(tmp_path):
    (tmp_path / "table.pdf").write_bytes(pdf.from_text([f"page {i}" for i in range(40)]))
    row = of(tmp_path / "table.pdf")
    assert (row["parts"], row["raw"]["xmpTPg:NPages"], row["error"]) == (40, ["40"], None)
    (tmp_path / "stream.pdf").write_bytes(packed_pdf())
    row = of(tmp_path / "stream.pdf")
    assert (row["parts"], row["error"]) == (7, None) and row["raw"]["dc:title"] == ["In (brackets)"] and row["raw"]["dcterms:created"] == ["D:2024"]
    assert row["bytes_read"] < row["size"]


def test_an_update_at_the_end_counts(tmp_path):
    data = pdf.from_text(["one"])
    old = int(re.findall(rb"startxref\s+(\d+)", data)[-1])
    at = len(data)
    new = data + b"2 0 obj\n<< /Type /Pages /Count 9 /Kids [] >>\nendobj\n"
    table = len(new)
    new += b"xref\n2 1\n%010d 00000 n \ntrailer\n<< /Size 9 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (at, old, table)
    (tmp_path / "u.pdf").write_bytes(new)
    assert of(tmp_path / "u.pdf")["parts"] == 9


def test_odd_files(spark, tmp_path):
    made = {
        "empty.xlsx": b"", "broken.xlsx": b"PK\x03\x04 broken", "not.pdf": b"text", "cut.pdf": pdf.from_text(["a"])[:300], "locked.pdf": pdf.from_text(["a"]).replace(b"trailer\n<<", b"trailer\n<< /Encrypt 9 0 R"),
        "plain.txt": b"hello", "book.ods": workbook.from_csv(b"a\n1\n", "ods"), "x.zip": build_zip([("a", b"1"), ("__MACOSX/b", b"2"), ("c", b"3")]), "noname": pdf.from_text(["p", "q"]), "bad.docx": build_zip([("docProps/core.xml", b"<not xml")]),
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    rows = {os.path.basename(r["path"]): r for r in read_information(spark, str(tmp_path), files=3).collect()}
    assert set(rows) == set(made) and all(rows[n]["size"] == len(d) for n, d in made.items())
    assert {n for n, r in rows.items() if r["error"]} == {"broken.xlsx", "not.pdf", "cut.pdf", "locked.pdf", "bad.docx"} and {r["error"]["type"] for r in rows.values() if r["error"]} == {"Parse"}
    assert rows["empty.xlsx"]["raw_metadata"] == {} and rows["plain.txt"]["parts"] is None and rows["plain.txt"]["size_text"] == "5 B"
    assert (rows["x.zip"]["entries"], rows["x.zip"]["parts"]) == (3, 2) and (rows["noname"]["mime"], rows["noname"]["page_count"]) == (SHORT["pdf"], 2)
    assert set(rows["broken.xlsx"]["raw_metadata"]) == {"fileSize", "detectedType"}
