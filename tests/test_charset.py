"""Character sets, and that no binary data is decoded as text."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from docloom.functions.charset import charset, charset_of, decode_text, text_of
from docloom.operators.archive import build_zip
from docloom.operators.base import ConversionError
from docloom.operators.convert import any_text, convert
from docloom.queries import QUERIES

TEXTS = {
    "windows-1252": ["Café déjà vu, naïve façade. Élève à l'école: où est-ce?", "Größe über Straße – schön", "El niño mañana comió piñata, ¿qué? ¡Sí!", "“quoted” text with — dashes and 5 €"],
    "windows-1251": ["Привет, мир! Это простой текст на русском языке.", "Київ — столиця України, є їжа", "слово"],
    "koi8-r": ["Привет, мир! Это простой текст на русском языке."],
    "iso-8859-5": ["Привет, мир! Это простой текст на русском языке."],
    "iso-8859-2": ["Zażółć gęślą jaźń, źródło i świat", "Příliš žluťoučký kůň úpěl ďábelské ódy"],
    "utf-8": ["plain ascii", "é 中文 \U0001f600", "\x1b[1mterminal"],
    "utf-16-le": ["ascii in pairs", "Größe über Straße", "mixed latin и немного"], "utf-16-be": ["ascii in pairs", "Größe über Straße"],
    "utf-32-le": ["wide \U0001f600"], "utf-32-be": ["wide \U0001f600"],
}
MARKED = {"utf-8": "﻿é", "utf-16-le": "﻿中文", "utf-16-be": "﻿中文", "utf-32-le": "﻿x中", "utf-32-be": "﻿x中"}
BINARY = [b"\x00\x01\x02binary", b"\x89PNG\r\n\x1a\n\x00\x00", b"text then \x00 one", b"\x01\x02\x03", bytes(range(256)), b"a" * 5000 + b"\x00\x00\x00tail" + b"b" * 3]


def cases():
    found = [(s, t, t.encode(s)) for s, texts in TEXTS.items() for t in texts] + [(s, t[1:], t.encode(s)) for s, t in MARKED.items()]
    return found + [(None, None, b) for b in BINARY] + [("utf-8", "", b"")]


def test_columns_and_python_agree(spark):
    rows = [(i, b) for i, (_, _, b) in enumerate(cases())]
    rnd = random.Random(3)
    more = [(len(rows) + i, rnd.choice([rnd.randbytes(rnd.randrange(9)), bytes(rnd.choice(b"ab \xe9\xe0\xd0\xf1\x00\xbf") for _ in range(rnd.randrange(12)))])) for i in range(300)]
    df = spark.createDataFrame(rows + more, "i int, content binary")
    got = {r.i: (r.name, r.text) for r in df.select("i", charset(F.col("content")).alias("name"), decode_text(F.col("content")).alias("text")).collect()}
    for i, (name, text, content) in enumerate(cases()):
        assert got[i] == (name, text) and (charset_of(content), text_of(content)) == (name, text), (content, got[i])
    for i, b in more:
        assert got[i][0] == charset_of(b), b


LONE = ["Lich die verte einerte chau cheiniesch öö auau entz der ü ertzheitch.", "thlyouin, èê, outh nterb", "Ää ist so", "Re et çê, çê, çê, çê,", "sur éêêè, enier", "Re éçêè Re éçêè Re éçêè"]
CYRILLIC = ["Да", "<p class='text'>Привет, мир!</p><p class='more'>Это простой текст</p>", "the word слово means word"]


def test_lone_words_beyond_ascii(spark):
    """Words of letters beyond ASCII only are Latin among Latin words; Cyrillic ones are found without ASCII letters, in markup and beside a few words."""
    want = [(t, "windows-1252") for t in LONE] + [(t, "windows-1251") for t in CYRILLIC]
    df = spark.createDataFrame([(i, t.encode(s)) for i, (t, s) in enumerate(want)], "i int, content binary")
    got = {r.i: (r.text, r.name) for r in df.select("i", charset(F.col("content")).alias("name"), decode_text(F.col("content")).alias("text")).collect()}
    assert [got[i] for i in range(len(want))] == want
    assert [(text_of(t.encode(s)), charset_of(t.encode(s))) for t, s in want] == want


ODD = ["", " ", "plain", "é \U0001f600", "\ufeffmarked", "\ufeff", "{\\rtf1 Hello {\\b bold}}", "bell \x07", "a\x00b", "a\x00b\x00", "\x00a\x00b", "\x1f\x8b", None]


def test_known_charset_keeps_each_character(spark, tmp_path):
    """Of known character set, texts are what they are: empty, marked, with control characters, like RTF or like UTF-16."""
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.text for r in QUERIES["convert_fallback_to_core"](spark, str(tmp_path)).orderBy("doc_id").collect()] == ODD
    kept = convert(spark.createDataFrame([("слово".encode("koi8-r"),), (b"",), (None,)], "content binary"), "csv", "plain", charset="koi8-r")
    assert [(r.result, r.error) for r in kept.collect()] == [("слово".encode(), None), (b"", None), (None, None)]
    bad = convert(spark.createDataFrame([(b"caf\xe9",)], "content binary"), "markdown", "plain", charset="utf-8").first()
    assert (bad.result, bad.error.type) == (None, "Parse")
    with pytest.raises(ValueError, match="docx to plain"):
        convert(spark.createDataFrame([(b"x",)], "content binary"), "docx", "plain", charset="utf-8")


def test_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(b"x",)], "content binary").select(decode_text(F.col("content")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("content", [*BINARY, b"{\\rtf1 Hello {\\b bold}}"])
def test_binary_data_is_refused(spark, content):
    with pytest.raises(ConversionError) as e:
        any_text(content, "bin")
    assert e.value.kind == "UnsupportedConversion"
    row = convert(spark.createDataFrame([(content,)], "content binary"), "bin", "plain").first()
    assert row.result is None and row.error.type == "UnsupportedConversion"


def test_texts_of_containers():
    odp = build_zip([("mimetype", b"application/vnd.oasis.opendocument.presentation"), ("content.xml", b'<office:document-content xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><office:body><office:presentation><text:p>slide text</text:p></office:presentation></office:body></office:document-content>')])
    assert any_text(odp, "odp").strip() == "slide text"
    assert any_text(gzip.compress("née".encode("windows-1252")), "gz") == "née"
    nested = build_zip([("inner.zip", build_zip([("a.txt", "é".encode("utf-16"))])), ("b.txt", b"top"), ("c.png", b"\x89PNG\x00")])
    assert any_text(nested, "zip") == "inner.zip\na.txt\né\nb.txt\ntop\nc.png\n"
    deep = b"x"
    for _ in range(10):
        deep = build_zip([("n.zip", deep)])
    with pytest.raises(ConversionError, match="levels"):
        any_text(deep, "zip")
    with pytest.raises(ConversionError, match="cut short"):
        any_text(gzip.compress(b"text" * 100)[:-9], "gz")
