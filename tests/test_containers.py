"""Outlook messages and 7z archives. The archives are written by the library that Spark carries, the solid one by hand."""

import lzma
import random
import struct
import zlib

import pytest

from docloom.operators import archive, convert as C, mail, outlook as O, sevenzip as S
from docloom.operators.base import ConversionError, split_documents

MAIL = b"""From: Ann Example <ann@example.org>
To: Bob <bob@example.org>, carol@example.org
Cc: Dan <dan@example.org>
Subject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=
Date: Tue, 05 Mar 2024 10:20:30 +0100
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary="x"

--x
Content-Type: multipart/alternative; boundary="y"

--y
Content-Type: text/plain; charset=utf-8

plain body
--y
Content-Type: text/html; charset=utf-8

<p>html body</p>
--y--
--x
Content-Type: application/pdf
Content-Disposition: attachment; filename="a.pdf"

%PDF-1.4
--x--
"""


def test_compound_files():
    tree = {"a": b"x" * 10, "large": b"y" * 5000, "empty": b"", "s": {"in": b"z" * 64, "t": {"deep": b"q" * 4096}, "none": {}}}
    raw = O.write_compound(tree)
    assert O.read_compound(raw) == tree and O.write_compound(tree) == raw and O.read_compound(O.write_compound({})) == {}
    many = {f"n{i}": bytes([i % 256]) * (i * 37 % 9000) for i in range(300)} | {"huge": b"h" * (9 << 20)}  # more sectors of numbers than the head lists
    assert O.read_compound(O.write_compound(many)) == many
    for bad in (b"", b"no", raw[:600], raw[:-700], O.MAGIC + b"\xff" * 600):
        with pytest.raises(ConversionError):
            O.read_compound(bad)
    circle = bytearray(O.write_compound({"large": b"y" * 5000}))
    fat_at = struct.unpack_from("<I", circle, 76)[0]
    struct.pack_into("<I", circle, (fat_at + 1) * 512 + 4, 0)  # the stream's second sector leads back to its first
    with pytest.raises(ConversionError, match="doesn't end"):
        O.read_compound(bytes(circle))


def test_messages(spark):
    msg = O.from_mail(MAIL)
    assert O.from_mail(MAIL) == msg
    m = O.read_message(msg)
    assert (m.subject, m.sender, m.recipients) == ("Grüße", ("Ann Example", "ann@example.org"), [(1, "Bob", "bob@example.org"), (1, "carol@example.org", "carol@example.org"), (2, "Dan", "dan@example.org")])
    assert m.sent.isoformat() == "2024-03-05T09:20:30+00:00"
    # the text is put out, under the type of the HTML body beside it
    assert [(f[0].strip(), *f[1:]) for f in C.splitter("core", "msg")(msg)] == [(b"plain body", "text/html", 0, "Grüße"), (b"%PDF-1.4", "application/pdf", 1, "a.pdf")]
    assert [(f[0].strip(), *f[1:]) for f in C.splitter("commercial", "msg")(msg)] == [(b"%PDF-1.4", "application/pdf", 0, "a.pdf")]
    assert C.converter("commercial", "msg", "html")(msg).strip() == "<p>html body</p>" and C.any_text(msg, "msg").strip() == "plain body"
    back = C.converter("commercial", "msg", "eml")(msg)
    assert back == O.to_mail(msg) and b"From: Ann Example <ann@example.org>" in back and b"Cc: Dan" in back and b"Date: Tue, 05 Mar 2024 09:20:30 +0000" in back
    assert mail.mail_to_html(back).strip() == "<p>html body</p>" and [f[1:] for f in mail.split_mail(back)] == [("text/plain", 0, "Grüße"), ("application/pdf", 1, "a.pdf")]
    df = spark.createDataFrame([(1, msg), (2, b"junk"), (3, None)], "doc_id long, content binary")
    got = {(r.doc_id, r["index"], r.label, r.error and r.error.type) for r in C.split(df, "msg").collect()}
    assert got == {(1, 0, "a.pdf", None), (2, None, None, "Parse")}
    assert O.split_message(O.from_mail(b"Subject:\r\n\r\n")) == [] and O.to_text(O.from_mail(b"")) == ""


def property_rows(*rows):
    return b"".join(struct.pack("<IIq", number << 16 | 3, 6, value) for number, value in rows)


def test_messages_of_other_writers():
    """8-bit strings by code page, HTML as bytes, an embedded message, a display name, a body in RTF only."""
    tree = {
        O.PROPERTIES: b"\0" * 32 + property_rows((O.CODE_PAGE, 1251), (O.INTERNET_CODE_PAGE, 65001)),
        "__substg1.0_0037001E": "Привет".encode("cp1251"), "__substg1.0_10130102": "<b>ё</b>".encode(),
        "__attach_version1.0_#00000000": {O.PROPERTIES: b"\0" * 8, "__substg1.0_3701000D": {O.PROPERTIES: b"\0" * 24}, "__substg1.0_3001001E": "внутри".encode("cp1251")},
        "__attach_version1.0_#00000001": {O.PROPERTIES: b"\0" * 8, "__substg1.0_37010102": b"1,2", "__substg1.0_3704001F": "SHORT~1.CSV".encode("utf-16-le"), "__substg1.0_3001001F": "shown.txt".encode("utf-16-le")},
    }
    raw = O.write_compound(tree)
    assert O.split_message(raw) == [("<b>ё</b>".encode(), "text/html", 0, "Привет"), (b"", "application/octet-stream", 1, "attachment_1"), (b"1,2", "text/csv", 2, "SHORT~1.CSV")]
    assert O.split_message(raw, False) == [(b"", "application/octet-stream", 0, "внутри"), (b"1,2", "text/plain", 1, "shown.txt")]
    del tree["__substg1.0_10130102"]
    raw = O.write_compound(tree | {"__substg1.0_10090102": b"LZFu"})
    body, *others = O.split_message(raw)
    assert isinstance(body[0], ConversionError) and body[0].kind == "Resource" and len(others) == 2
    with pytest.raises(ConversionError, match="RTF"):
        O.to_text(raw)
    with pytest.raises(ConversionError, match="no message"):
        O.read_message(O.write_compound({"WordDocument": b"x"}))


FILES = [("folder/a.txt", b"hello " * 2000), ("b.csv", b""), ("c é.bin", random.Random(1).randbytes(70_000)), ("__MACOSX/x", b"m")]


@pytest.mark.parametrize("methods", [["COPY"], ["LZMA"], ["LZMA2"], ["DEFLATE"], ["BZIP2"], ["DELTA_FILTER", "LZMA2"], ["BCJ_X86_FILTER", "LZMA2"], ["BCJ_X86_FILTER", "LZMA"]])
def test_7z_coders(spark, tmp_path, methods):
    jvm = spark._jvm
    pack = jvm.org.apache.commons.compress.archivers.sevenz
    out = pack.SevenZOutputFile(jvm.java.io.File(str(tmp_path / "a.7z")))
    chain = jvm.java.util.ArrayList()
    for m in methods:
        chain.add(pack.SevenZMethodConfiguration(getattr(pack.SevenZMethod, m)))
    out.setContentMethods(chain)
    for name, data in [("folder", None), *FILES]:
        entry = pack.SevenZArchiveEntry()
        entry.setName(name)
        entry.setDirectory(data is None)
        out.putArchiveEntry(entry)
        if data:
            out.write(data)
        out.closeArchiveEntry()
    out.close()
    raw = (tmp_path / "a.7z").read_bytes()
    assert [(n, d) for n, d, folder in S.entries(raw) if not folder] == FILES
    assert [(f[3], f[2], f[1]) for f in C.splitter("commercial", "7z")(raw)] == [("folder/a.txt", 1, "text/plain"), ("b.csv", 2, "text/csv"), ("c é.bin", 3, "application/octet-stream"), ("__MACOSX/x", 4, "application/octet-stream")]
    assert [(f[3], f[2]) for f in S.split_7z(raw, "core")] == [("a.txt", 0), ("b.csv", 1), ("c é.bin", 2)]


def solid(parts, coder="030101", broken=False):
    """A block of all parts, and a header that is packed itself."""
    one = [{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16, "lc": 3, "lp": 0, "pb": 2}]
    properties = bytes([(2 * 5 + 0) * 9 + 3]) + struct.pack("<I", 1 << 16)

    def number(n):
        return bytes([n]) if n < 128 else b"\xc0" + struct.pack("<H", n) if n < 1 << 14 else b"\xf0" + struct.pack("<I", n)

    def streams(at, packed, whole, more=b""):
        own = bytes.fromhex(coder) if more else bytes.fromhex("030101")
        return b"\x06" + number(at) + b"\x01\x09" + number(len(packed)) + b"\0" + b"\x07\x0b\x01\0\x01" + bytes([32 | len(own)]) + own + b"\x05" + properties + b"\x0c" + number(len(whole)) + b"\0" + more + b"\0"

    whole = b"".join(d for _, d in parts)
    packed = lzma.compress(whole, lzma.FORMAT_RAW, filters=one)
    sums = b"".join(struct.pack("<I", zlib.crc32(d) ^ broken) for _, d in parts)
    inner = b"\x08\x0d" + number(len(parts)) + b"\x09" + b"".join(number(len(d)) for _, d in parts[:-1]) + b"\x0a\x01" + sums + b"\0"
    names = b"\0" + b"".join(n.encode("utf-16-le") + b"\0\0" for n, _ in parts)
    head = b"\x01\x04" + streams(0, packed, whole, inner) + b"\x05" + number(len(parts)) + b"\x11" + number(len(names)) + names + b"\0\0"
    small = lzma.compress(head, lzma.FORMAT_RAW, filters=one)
    last = b"\x17" + streams(len(packed), small, head)
    start = struct.pack("<QQI", len(packed) + len(small), len(last), zlib.crc32(last))
    return S.SIGNATURE + b"\0\x04" + struct.pack("<I", zlib.crc32(start)) + start + packed + small + last


def test_7z_solid_blocks_and_faults(spark, monkeypatch):
    parts = [("d/a.txt", b"one"), ("b.html", b"<p>two</p>" * 40), ("c.bin", bytes(3000))]
    raw = solid(parts)
    assert [(n, d) for n, d, _ in S.entries(raw)] == parts
    assert C.any_text(solid(parts[:1]), "7z") == "a.txt\none"
    assert [str(f[0]) for f in S.split_7z(solid(parts, broken=True))] == ["an entry whose checksum differs"] * 3
    unknown = S.split_7z(solid(parts, coder="06f10701"))
    assert [(f[0].kind, f[3]) for f in unknown] == [("Resource", n) for n, _ in parts]
    for bad in (b"", raw[:20], raw[:-1], S.SIGNATURE + bytes(40) + b"x", raw[:40] + b"\xff" * 8 + raw[48:]):
        try:
            assert all(isinstance(f[0], ConversionError) or not f[0] for f in S.split_7z(bad))
        except ConversionError:
            pass
    df = spark.createDataFrame([(1, raw), (2, b"junk"), (3, None)], "doc_id long, content binary")
    got = {(r.doc_id, r["index"], r.label, r.total, r.error and r.error.type) for r in split_documents(df, S.split_7z).collect()}
    assert got == {(1, 0, "d/a.txt", 3, None), (1, 1, "b.html", 3, None), (1, 2, "c.bin", 3, None), (2, None, None, None, "Split")}
    monkeypatch.setattr(archive, "MAX_ENTRY_BYTES", 150)
    assert [(f[0].kind, f[3]) for f in S.split_7z(solid([("a", b"x" * 200)]))] == [("Resource", "a")]
    assert S.split_7z(solid([("a", b"x" * 150)]))[0][0] == b"x" * 150
