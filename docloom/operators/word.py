"""DOCX and ODT: text, HTML, Markdown, sections; a small writer."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from docloom.functions.mime import SHORT
from docloom.operators.archive import build_zip
from docloom.operators.base import ConversionError, Fragment, convert_documents, split_documents

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_X = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'

#: (style, text) of a paragraph; a table is a list of rows of cells
Block = tuple[str, str] | list[list[str]]


def _part(content: bytes, name: str) -> ET.Element:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if name not in z.namelist():
            raise ConversionError("Parse", f"{name} is missing")
        return ET.fromstring(z.read(name))


def _text(p: ET.Element) -> str:
    return "".join({"t": e.text or "", "tab": "\t", "br": "\n"}.get(e.tag.removeprefix(_W), "") for e in p.iter() if e.tag.startswith(_W))


def _block(e: ET.Element) -> Block | None:
    if e.tag == _W + "p":
        style = e.find(f"{_W}pPr/{_W}pStyle")
        return (style.get(_W + "val") if style is not None else "", _text(e))
    if e.tag == _W + "tbl":
        return [["\n".join(_text(p) for p in c.iter(_W + "p")) for c in r.iter(_W + "tc")] for r in e.iter(_W + "tr")]
    return None


def read_docx(content: bytes) -> list[Block]:
    return [b for e in _part(content, "word/document.xml").find(_W + "body") if (b := _block(e)) is not None]


def read_odt(content: bytes) -> list[Block]:
    return [("Heading" + e.get(_X + "outline-level", "1") if e.tag == _X + "h" else "", "".join(e.itertext())) for e in _part(content, "content.xml").iter() if e.tag in (_X + "h", _X + "p")]


def read_blocks(content: bytes) -> list[Block]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return read_docx(content) if "word/document.xml" in z.namelist() else read_odt(content)


def _level(style: str) -> int:
    low = style.lower().replace(" ", "")
    return 1 if low == "title" else min(6, int(low[7:])) if low.startswith("heading") and low[7:].isdigit() else 0


def to_text(content: bytes) -> str:
    return "\n".join("\n".join("\t".join(r) for r in b) if isinstance(b, list) else b[1] for b in read_blocks(content))


def to_html(content: bytes) -> str:
    def one(b: Block) -> str:
        if isinstance(b, list):
            return "<table>" + "".join("<tr>" + "".join(f"<td>{escape(c)}</td>" for c in r) + "</tr>" for r in b) + "</table>"
        tag = f"h{_level(b[0])}" if _level(b[0]) else "p"
        return f"<{tag}>{escape(b[1])}</{tag}>"

    return "<html><body>" + "".join(map(one, read_blocks(content))) + "</body></html>"


def to_markdown(content: bytes) -> str:
    def one(b: Block) -> str:
        if isinstance(b, list):
            line = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in r) + " |"
            return "\n".join([line(b[0]), line(["---"] * len(b[0])), *map(line, b[1:])]) if b else ""
        return "#" * _level(b[0]) + " " * bool(_level(b[0])) + b[1]

    return "\n\n".join(x for x in map(one, read_blocks(content)) if x)


def write_docx(sections: list[list[Block]]) -> bytes:
    """A document of sections; each but the last ends with section properties of its own."""

    def paragraph(style: str, text: str, end: bool = False) -> str:
        inner = (f'<w:pStyle w:val="{escape(style)}"/>' if style else "") + "<w:sectPr/>" * end
        runs = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(t)}</w:t>' for t in text.split("\n"))
        return "<w:p>" + (f"<w:pPr>{inner}</w:pPr>" if inner else "") + f"<w:r>{runs}</w:r></w:p>"

    def block(b: Block) -> str:
        if isinstance(b, list):
            return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{paragraph('', c)}</w:tc>" for c in r) + "</w:tr>" for r in b) + "</w:tbl>"
        return paragraph(*b)

    body = ""
    for i, blocks in enumerate(sections):
        ends = i < len(sections) - 1
        if ends and blocks and not isinstance(blocks[-1], list):
            body += "".join(map(block, blocks[:-1])) + paragraph(*blocks[-1], end=True)
        else:
            body += "".join(map(block, blocks)) + paragraph("", "", end=True) * ends
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return build_zip([(n, (_HEAD + x).encode()) for n, x in (
        ("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'),
        ("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="word/document.xml"/></Relationships>'),
        ("word/document.xml", f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{body}<w:sectPr/></w:body></w:document>'),
    )])


def split_sections(content: bytes) -> list[Fragment]:
    """A document for each section, which ends where a paragraph carries section properties."""
    sections: list[list[Block]] = [[]]
    for e in _part(content, "word/document.xml").find(_W + "body"):
        if (b := _block(e)) is None:
            continue
        ends = e.tag == _W + "p" and e.find(f"{_W}pPr/{_W}sectPr") is not None
        if not ends or b[1]:
            sections[-1].append(b)
        if ends:
            sections.append([])
    if len(sections) > 1 and not sections[-1]:
        sections.pop()
    return [(write_docx([s]), SHORT["docx"], i, f"Section {i + 1}") for i, s in enumerate(sections)]


def split_whole(content: bytes) -> list[Fragment]:
    """The document itself as one fragment, if it can be read."""
    read_docx(content)
    return [(content, SHORT["docx"], 0, "Document")]


def drop_macros(content: bytes) -> bytes:
    """A macro-enabled OOXML file as its plain kind: without the macro project, content types rewritten."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        entries = []
        for name in z.namelist():
            data = z.read(name)
            if name.endswith(("vbaProject.bin", "vbaData.xml")):
                continue
            if name == "[Content_Types].xml":
                text = data.decode()
                for kind, plain in (("application/vnd.ms-word.document.macroEnabled.main+xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"), ("application/vnd.ms-excel.sheet.macroEnabled.main+xml", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"), ("application/vnd.ms-powerpoint.presentation.macroEnabled.main+xml", "application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml")):
                    text = text.replace(kind, plain)
                root = ET.fromstring(text)
                for e in list(root):
                    if "vba" in (e.get("PartName") or "").lower() or e.get("Extension") == "bin":
                        root.remove(e)
                ET.register_namespace("", "http://schemas.openxmlformats.org/package/2006/content-types")
                data = ET.tostring(root, xml_declaration=True, encoding="UTF-8")
            elif name.endswith(".rels") and b"vbaProject" in data:
                root = ET.fromstring(data)
                for e in list(root):
                    if "vbaProject" in (e.get("Target") or ""):
                        root.remove(e)
                ET.register_namespace("", "http://schemas.openxmlformats.org/package/2006/relationships")
                data = ET.tostring(root, xml_declaration=True, encoding="UTF-8")
            entries.append((name, data))
    return build_zip(entries)


def split_documents_by_section(df: DataFrame, mode: str = "core") -> DataFrame:
    """core: the document whole; full: by sections."""
    return split_documents(df, split_whole if mode == "core" else split_sections)


def convert_word(df: DataFrame, target: str) -> DataFrame:
    return convert_documents(df, {"text": to_text, "html": to_html, "markdown": to_markdown, "plain_kind": drop_macros}[target])
