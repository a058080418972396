"""PPTX: slides split off, text and HTML; a small writer."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from docloom.functions.mime import SHORT
from docloom.operators.archive import build_zip
from docloom.operators.base import ConversionError, Fragment, convert_documents, split_documents

_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REL = "http://schemas.openxmlformats.org/package/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def write_pptx(slides: list[tuple[str, str]]) -> bytes:
    """A deck of (title, text)."""
    rel = _R[1:-1]

    def shape(kind: str, text: str) -> str:
        paragraphs = "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in text.split("\n"))
        return f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="{kind}"/><p:cNvSpPr/><p:nvPr>' + f'<p:ph type="{kind}"/>' + f"</p:nvPr></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/>{paragraphs}</p:txBody></p:sp>"

    n = range(1, len(slides) + 1)
    types = "".join(f'<Override PartName="/ppt/slides/slide{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.presentationml.slide+xml"/>' for i in n)
    parts = [
        ("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/ppt/presentation.xml" ContentType="application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml"/>{types}</Types>'),
        ("_rels/.rels", f'<Relationships xmlns="{_REL}"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="ppt/presentation.xml"/></Relationships>'),
        ("ppt/presentation.xml", f'<p:presentation xmlns:p="{_P[1:-1]}" xmlns:r="{rel}"><p:sldIdLst>' + "".join(f'<p:sldId id="{255 + i}" r:id="rId{i}"/>' for i in n) + "</p:sldIdLst></p:presentation>"),
        ("ppt/_rels/presentation.xml.rels", f'<Relationships xmlns="{_REL}">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/slide" Target="slides/slide{i}.xml"/>' for i in n) + "</Relationships>"),
    ]
    for i, (title, text) in enumerate(slides, 1):
        shapes = (shape("title", title) if title else "") + shape("body", text)
        parts.append((f"ppt/slides/slide{i}.xml", f'<p:sld xmlns:p="{_P[1:-1]}" xmlns:a="{_A[1:-1]}"><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>'))
    return build_zip([(n, (_HEAD + x).encode()) for n, x in parts])


class Deck:
    def __init__(self, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            self.parts = {n: z.read(n) for n in z.namelist()}
        if "ppt/presentation.xml" not in self.parts:
            raise ConversionError("Parse", "no presentation in the archive")
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.parts["ppt/_rels/presentation.xml.rels"])}
        self.root = ET.fromstring(self.parts["ppt/presentation.xml"])
        ids = [s.get(_R + "id") for s in self.root.iter(_P + "sldId")]
        self.slides = [(i, posixpath.normpath(posixpath.join("ppt", targets[i])) if not targets[i].startswith("/") else targets[i].lstrip("/")) for i in ids]

    def text(self, path: str) -> tuple[str, str]:
        """(title, text) of a slide."""
        title, rest = "", []
        for shape in ET.fromstring(self.parts[path]).iter(_P + "sp"):
            text = "\n".join("".join(t.text or "" for t in p.iter(_A + "t")) for p in shape.iter(_A + "p"))
            kind = next((ph.get("type") for ph in shape.iter(_P + "ph")), None)
            if kind in ("title", "ctrTitle") and not title:
                title = text
            elif text:
                rest.append(text)
        return title, "\n".join(rest)

    def only(self, keep: str) -> bytes:
        """The deck with one slide: the others leave the list, the relations, the content types and the archive."""
        gone = {p for i, p in self.slides if i != keep}
        ids = {i for i, p in self.slides if p in gone}
        drop = lambda data, pattern: re.sub(pattern, b"", data)
        out = []
        for name, data in self.parts.items():
            base = posixpath.basename(name)
            if name in gone or name.startswith("ppt/slides/_rels/") and f"ppt/slides/{base.removesuffix('.rels')}" in gone:
                continue
            if name == "ppt/presentation.xml":
                for i in ids:
                    data = drop(data, rb'<p:sldId\b[^>]*r:id="' + re.escape(i.encode()) + rb'"[^>]*/>')
            elif name == "ppt/_rels/presentation.xml.rels":
                for i in ids:
                    data = drop(data, rb'<Relationship\b[^>]*\bId="' + re.escape(i.encode()) + rb'"[^>]*/>')
            elif name == "[Content_Types].xml":
                for p in gone:
                    data = drop(data, rb'<Override\b[^>]*PartName="/' + re.escape(p.encode()) + rb'"[^>]*/>')
            out.append((name, data))
        return build_zip(out)


def split_slides(content: bytes, named_by_title: bool = True) -> list[Fragment]:
    """A deck for each slide; slides that can't be read are left out and keep their number."""
    deck = Deck(content)
    if not deck.slides:
        if named_by_title:
            raise ConversionError("Split", "the presentation has no slides")
        return []
    out: list[Fragment] = []
    for i, (rid, path) in enumerate(deck.slides):
        try:
            title = deck.text(path)[0] if named_by_title else ""
            out.append((deck.only(rid), SHORT["pptx"], i, title or f"Slide {i + 1}"))
        except (KeyError, ET.ParseError):
            continue
    return out


def to_text(content: bytes) -> str:
    deck = Deck(content)
    return "\n".join("\n".join(x for x in deck.text(p) if x) for _, p in deck.slides)


def to_html(content: bytes) -> str:
    deck = Deck(content)
    slide = lambda t: "<section>" + (f"<h2>{escape(t[0])}</h2>" if t[0] else "") + "".join(f"<p>{escape(x)}</p>" for x in t[1].split("\n") if x) + "</section>"
    return "<html><body>" + "".join(slide(deck.text(p)) for _, p in deck.slides) + "</body></html>"


def split_decks(df: DataFrame, named_by_title: bool = True) -> DataFrame:
    return split_documents(df, lambda c: split_slides(c, named_by_title))


def convert_slides(df: DataFrame, target: str) -> DataFrame:
    return convert_documents(df, {"text": to_text, "html": to_html}[target])
