"""Conversion and splitting by route: tries backends in order, keeps errors as values.

Routes that this library has are Python or column operators; routes that need an office process use `soffice` where a worker has it; the
rest are registered and answer with a Resource error. A backend's UnsupportedConversion or Resource error passes the row on to
the next one; any other error stays.
"""

from __future__ import annotations

import os
import shutil
import struct
import subprocess
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Sequence
from functools import cache
from html.parser import HTMLParser
from xml.etree.ElementTree import ParseError
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from docloom.functions.charset import text_of
from docloom.functions.mime import SHORT
from docloom.functions.options import ConvertOptions
from docloom.operators import archive, mail, outlook, pdf, sevenzip, slides, text_split, watermark, word, workbook  # noqa: F401
from docloom.operators.base import ConversionError, Fragment, convert_documents, split_documents
from docloom.plans.registry import _SPLITS, BACKENDS, COMMERCIAL, OFFICE, product_for_split, products_for

_SHORT_OF = {m: s for s, m in SHORT.items()} | {SHORT["plain"]: "plain", SHORT["markdown"]: "markdown", SHORT["jpeg"]: "jpeg", "text/xml": "xml"}
OFFICE_SECONDS = 120
#: Documents after which the office process gets a fresh profile.
OFFICE_TASKS = 200

# Routes of the licensed backend that an office process can take too.
OFFICE_TOO = [(a, b) for line in """
xls: html csv
xlsb: html csv
xlsx: xlsm xlsb
ppt: html
pdf: png jpeg docx doc
doc: plain markdown
docx: rtf
eml: pdf
msg: pdf
""".strip().splitlines() for a, _, rest in [line.partition(":")] for b in rest.split()]
#: Types without a reader here, and what an office process makes of them to be read.
MODERN = {"xls": "xlsx", "xlsb": "xlsx", "doc": "docx", "ppt": "pptx"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def html_text(content: bytes) -> str:
    p = _Text()
    p.feed(text_of(content) or content.decode("utf-8", "replace"))
    p.close()
    return " ".join(" ".join(p.parts).split())


#: Bytes that a gzip member may inflate to.
MAX_GZIP_BYTES = 1 << 30
#: Levels of archives within archives whose texts are read.
NESTED = 8
#: Types whose text is their bytes.
TEXTS = ("plain", "markdown", "csv", "tsv", "json", "xml", "css")


def plain_text(content: bytes) -> str:
    """Bytes in whatever character set they are; what is no text is refused, never decoded."""
    if content.startswith(b"{\\rtf"):
        raise ConversionError("UnsupportedConversion", "there is no reader for RTF")
    text = text_of(content)
    if text is None:
        raise ConversionError("UnsupportedConversion", "these bytes are no text")
    return text


def any_text(content: bytes, source: str, level: int = 0) -> str:
    """The text of any document; empty input is a parse error, a container its entries' texts, nested ones too; other binary data is refused."""
    if not content:
        raise ConversionError("Parse", "empty input")
    how = {"xlsx": workbook.to_text, "xlsm": workbook.to_text, "ods": workbook.to_text, "docx": word.to_text, "docm": word.to_text, "odt": word.to_text, "odp": word.to_text, "pptx": slides.to_text, "pptm": slides.to_text, "pdf": pdf.to_text, "eml": mail.mail_to_text, "msg": outlook.to_text, "html": html_text}
    if source in how:
        return how[source](content)
    if source in ("zip", "7z"):
        if level >= NESTED:
            raise ConversionError("Resource", f"archives within archives, over {NESTED} levels")
        parts = []
        for data, mime, _, name in archive.split_zip(content) if source == "zip" else sevenzip.split_7z(content, "core"):
            if isinstance(data, Exception):
                raise data
            inner = _SHORT_OF.get(mime, "bin")
            readable = inner in how or inner in ("zip", "7z") or mime.startswith("text/")
            parts.append(f"{name}\n" + (any_text(data, inner, level + 1) if data and readable else ""))
        return "\n".join(parts)
    if content.startswith(b"\x1f\x8b"):
        if level >= NESTED:
            raise ConversionError("Resource", f"archives within archives, over {NESTED} levels")
        unpack = zlib.decompressobj(31)
        inner = unpack.decompress(content, MAX_GZIP_BYTES)
        if not unpack.eof:
            raise ConversionError("Resource" if unpack.unconsumed_tail else "Parse", f"over {MAX_GZIP_BYTES} bytes" if unpack.unconsumed_tail else "cut short")
        return any_text(inner, "bin", level + 1) if inner else ""
    if source in MODERN:
        return how[MODERN[source]](office_convert(content, source, MODERN[source]))
    return plain_text(content)


def any_xml(content: bytes, source: str) -> str:
    body = "".join(f"<p>{escape(x)}</p>" for x in any_text(content, source).split("\n"))
    return f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title></title></head><body>{body}</body></html>'


@cache
def office_path() -> str | None:
    return os.environ.get("SOFFICE_PATH") or shutil.which("soffice")


class _Profile:
    """An office profile of this worker, made once and for OFFICE_TASKS documents; a failed task ends it."""

    def __init__(self):
        self.folder: tempfile.TemporaryDirectory | None = None
        self.tasks = 0

    def take(self) -> str:
        if self.folder is None or self.tasks >= OFFICE_TASKS:
            self.drop()
            self.folder = tempfile.TemporaryDirectory()
        self.tasks += 1
        return self.folder.name

    def drop(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()
        self.folder, self.tasks = None, 0


_PROFILE = _Profile()


def office_convert(content: bytes, source: str, target: str, options: ConvertOptions = ConvertOptions()) -> bytes:
    if not (path := office_path()):
        raise ConversionError("Resource", "no office process on this machine")
    if target == "pdf" and source in ("xlsx", "xlsm", "ods"):
        content = workbook.page_setup(content, options)
    extra = ["--infilter=writer_pdf_import"] if source == "pdf" and target in ("docx", "doc") else []
    kind = {"plain": "txt", "jpeg": "jpg"}.get(target, target)
    with tempfile.TemporaryDirectory() as d:  # the process reads and writes files; they live as long as the call
        with open(f"{d}/in.{source}", "wb") as f:
            f.write(content)
        try:
            subprocess.run([path, f"-env:UserInstallation=file://{_PROFILE.take()}", "--headless", *extra, "--convert-to", kind, "--outdir", d, f"{d}/in.{source}"], check=True, capture_output=True, timeout=OFFICE_SECONDS)
        except subprocess.TimeoutExpired as e:
            _PROFILE.drop()
            raise ConversionError("Timeout", f"the office process took over {OFFICE_SECONDS} s") from e
        except subprocess.CalledProcessError as e:
            _PROFILE.drop()
            raise ConversionError("Render", e.stderr.decode(errors="replace")[-500:]) from e
        with open(f"{d}/in.{kind}", "rb") as f:
            return f.read()


def _office(source: str, target: str, o: ConvertOptions) -> Callable[[bytes], bytes | str]:
    """The office process's way of a route; two steps where it has no direct one."""
    if source in ("eml", "msg") and target == "pdf":
        page = mail.mail_to_html if source == "eml" else outlook.to_html
        return lambda c: office_convert(page(c).encode(), "html", "pdf", o)
    if (source, target) == ("doc", "markdown"):
        return lambda c: word.to_markdown(office_convert(c, "doc", "docx"))
    return lambda c: office_convert(c, source, target, o)


def _parsed(how: Callable[[bytes], bytes | str]) -> Callable[[bytes], bytes | str]:
    """What can't be read as its type is a Parse error."""

    def run(content: bytes):
        try:
            return how(content)
        except ConversionError:
            raise
        except Exception as e:
            raise ConversionError("Parse", str(e) or type(e).__name__) from e

    return run


#: What readers raise on bytes that are not of their format.
MALFORMED = (zipfile.BadZipFile, ParseError, zlib.error, struct.error, KeyError, IndexError, UnicodeDecodeError, EOFError)


def _well_formed(how: Callable[[bytes], bytes | str]) -> Callable[[bytes], bytes | str]:
    """Bytes that are not of their format are a Parse error."""

    def run(content: bytes):
        try:
            return how(content)
        except MALFORMED as e:
            raise ConversionError("Parse", str(e) or type(e).__name__) from e

    return run


def _own(source: str, target: str, o: ConvertOptions) -> Callable[[bytes], bytes | str] | None:
    """The library's own converter of a route, if it has one."""
    sheets = ("xlsx", "xlsm", "ods")
    if o.password is not None:
        def refuse(_):
            raise ConversionError("Resource", "password-protected files can't be opened")

        return refuse
    if source in sheets and target in ("csv", "json", "markdown", "html"):
        how = {"csv": workbook.to_csv, "json": workbook.to_json, "markdown": workbook.to_markdown, "html": workbook.to_html}[target]
        return lambda c: how(c, o.sheet_names, o.evaluate_formulas)
    if source == "pdf" and target == "pdf":
        if o.remove_watermarks or o.remove_watermarks_aggressive:
            return lambda c: pdf.remove_watermarks(c, o.remove_watermarks_aggressive)

        def nothing(_):
            raise ConversionError("UnsupportedConversion", "PDF to PDF needs watermark removal")

        return nothing
    table = {
        ("docx", "html"): word.to_html, ("docm", "html"): word.to_html, ("odt", "html"): word.to_html, ("docx", "plain"): word.to_text, ("docx", "markdown"): word.to_markdown,
        ("docm", "docx"): word.drop_macros, ("xlsm", "xlsx"): word.drop_macros, ("pptm", "pptx"): word.drop_macros, ("pptx", "html"): slides.to_html,
        ("xlsx", "ods"): workbook.xlsx_to_ods, ("ods", "xlsx"): workbook.ods_to_xlsx, ("pdf", "html"): pdf.to_html, ("png", "pdf"): _well_formed(pdf.from_image), ("jpeg", "pdf"): _well_formed(pdf.from_image),
        ("eml", "html"): mail.mail_to_html, ("eml", "msg"): outlook.from_mail, ("msg", "html"): outlook.to_html, ("msg", "eml"): outlook.to_mail,
        ("csv", "xlsx"): lambda c: workbook.from_csv(c, "xlsx"), ("csv", "ods"): lambda c: workbook.from_csv(c, "ods"), ("csv", "html"): _csv_html,
    }
    return table.get((source, target))


def _csv_html(content: bytes) -> str:
    rows = [x for x in content.decode("utf-8", "replace").replace("\r\n", "\n").split("\n") if x.strip()]
    return "<table>" + "".join("<tr>" + "".join(f"<td>{escape(c, {chr(34): '&quot;', chr(39): '&apos;'})}</td>" for c in r.split(",")) + "</tr>" for r in rows) + "</table>"


def converter(backend: str, source: str, target: str, options: ConvertOptions = ConvertOptions(), charset: str | None = None) -> Callable[[bytes], bytes | str]:
    """What a backend does for a route of short names; raises ConversionError when called if it can't. charset as for convert."""

    def fail(kind: str, why: str):
        def run(_):
            raise ConversionError(kind, why)

        return run

    routes = {"commercial": COMMERCIAL, "office": OFFICE}.get(backend)
    if routes is not None and (source, target) not in routes:
        return fail("UnsupportedConversion", f"{source} to {target} isn't a route of {backend}")
    if backend == "core":
        if target == "plain" and charset is not None:
            return _parsed(lambda c: c.decode(charset))
        if target == "plain":
            return _parsed(lambda c: any_text(c, source))
        if target == "xml":
            return _parsed(lambda c: any_xml(c, source))
        if (source, target) == ("xlsx", "ods"):
            return workbook.xlsx_to_ods
        return fail("UnsupportedConversion", f"{source} to {target} isn't a route of core")
    if own := _own(source, target, options):
        return _parsed(own) if target == "plain" else own
    if backend == "office" or (source, target) in OFFICE_TOO:
        return _office(source, target, options)
    return fail("Resource", f"no licence for {source} to {target}")


def first_success(tries: list[Callable[[bytes], bytes | str]]) -> Callable[[bytes], bytes | str]:
    def run(content: bytes):
        last: ConversionError | None = None
        for one in tries:
            try:
                return one(content)
            except ConversionError as e:
                if e.kind not in ("UnsupportedConversion", "Resource"):
                    raise
                # an unsupported route says less than a missing resource
                last = e if last is None or e.kind == "Resource" or last.kind != "Resource" else last
        raise last or ConversionError("UnsupportedConversion", "no backend")

    return run


def converters(source: str, target: str, backend: str | None = None, options: ConvertOptions = ConvertOptions(), products: Sequence[str] | None = None, charset: str | None = None) -> list[Callable[[bytes], bytes | str]]:
    """A named backend's converter alone, else each backend's in order. With a list of licensed products, the commercial one needs those of the route."""
    names = [backend] if backend else BACKENDS
    return [converter(b, source, target, options, charset) for b in names if b != "commercial" or products is None or set(products_for(source, target)) <= set(products)]


def splitters(source: str, backend: str | None = None, options: ConvertOptions = ConvertOptions(), products: Sequence[str] | None = None) -> list[Callable[[bytes], list[Fragment]]]:
    names = [backend] if backend else BACKENDS
    return [splitter(b, source, options) for b in names if b != "commercial" or products is None or product_for_split(source) in products]


def convert(df: DataFrame, source: str, target: str, backend: str | None = None, options: ConvertOptions = ConvertOptions(), products: Sequence[str] | None = None, charset: str | None = None) -> DataFrame:
    """df(..., content) with result and error; a named backend is used alone, else each in order. Equal types pass through.

    products: the licensed ones, without which the commercial backend is passed over; null: licences aren't looked at.
    charset: the one that all texts are known to be in, on their way to plain text. Each character is then kept, byte order marks and control
    characters too, and an empty text is empty; null: it is found for each, and empty input and what is no text are errors.
    """
    s, t = _SHORT_OF.get(SHORT.get(source, source), source), _SHORT_OF.get(SHORT.get(target, target), target)
    if charset is not None and (s not in TEXTS or t != "plain"):
        raise ValueError(f"a charset is for {', '.join(TEXTS)} to plain, not {s} to {t}")
    if s == t and not (s == "pdf" and (options.remove_watermarks or options.remove_watermarks_aggressive)):
        return convert_documents(df, lambda c: c)
    return convert_documents(df, first_success(converters(s, t, backend, options, products, charset)))


def splitter(backend: str, source: str, options: ConvertOptions = ConvertOptions()) -> Callable[[bytes], list[Fragment]]:
    def fail(kind: str, why: str):
        def run(_):
            raise ConversionError(kind, why)

        return run

    if source not in _SPLITS.get(backend, "").split():
        return fail("UnsupportedConversion", f"{backend} can't split {source}")
    o, full = options, backend == "commercial"
    table: dict[str, Callable[[bytes], list[Fragment]]] = {
        "xlsx": lambda c: workbook.split_workbook(c, o.sheet_names, o.exclude_hidden, o.evaluate_formulas) if full else workbook.split_workbook(c),
        "pptx": lambda c: slides.split_slides(c, not full), "docx": word.split_sections if full else word.split_whole, "pdf": pdf.split_pages,
        "zip": lambda c: archive.split_zip(c, "full" if full else "core"), "eml": lambda c: mail.split_mail(c, not full),
        "msg": lambda c: outlook.split_message(c, not full), "7z": sevenzip.split_7z,
        "plain": lambda c: _paragraphs(c), "csv": lambda c: _rows(c),
    }
    table["xlsm"] = table["ods"] = table["xlsx"]
    if source in MODERN:
        return lambda c: table[MODERN[source]](office_convert(c, source, MODERN[source]))
    return table.get(source) or fail("Resource", f"no reader for {source}")


def _paragraphs(content: bytes) -> list[Fragment]:
    import re

    strip = "".join(map(chr, range(33)))
    parts = [p.strip(strip) for p in re.split("\n[ \t\n\x0b\f\r]*\n", content.decode("utf-8", "replace"))]
    return [(p.encode(), SHORT["plain"], i, f"Paragraph {i + 1}") for i, p in enumerate(x for x in parts if x)]


def _rows(content: bytes) -> list[Fragment]:
    head, *rows = content.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    return [(f"{head}\n{r}".encode(), SHORT["csv"], i, f"Row {i + 2}") for i, r in enumerate(x for x in rows if x.strip())]


def split(df: DataFrame, source: str, backend: str | None = None, options: ConvertOptions = ConvertOptions(), products: Sequence[str] | None = None) -> DataFrame:
    """df(..., content) to fragments; a named backend is used alone, else each in order; products as for convert."""
    s = _SHORT_OF.get(SHORT.get(source, source), source)
    return split_documents(df, first_success(splitters(s, backend, options, products)))
