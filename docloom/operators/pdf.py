"""PDF: pages split off, text layer, text and images to pages, watermark removal. Unencrypted files.

Objects are found through the file rather than its cross-reference table, object streams included; a page's own file holds
only the objects it reaches.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from docloom.functions.mime import SHORT
from docloom.operators.base import ConversionError, Fragment, convert_documents, split_documents
from docloom.operators.watermark import MIN_PREFIX, PAINTS, PATHS, WRAPPERS

_OBJ = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_REF = re.compile(rb"(\d+)\s+(\d+)\s+R\b")
_STREAM = re.compile(rb"stream\r?\n")


def write_pdf(pages: list[bytes], resources: bytes = b"<< /Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >> >> >>", box: tuple[float, float] = (595, 842), extra: list[bytes] | None = None) -> bytes:
    """A file of pages given as content streams. extra: objects from number 3 on, which `resources` may refer to."""
    extra = extra or []
    first = 3 + len(extra)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (first + 2 * i) for i in range(len(pages))), len(pages)), *extra]
    for i, content in enumerate(pages):
        packed = zlib.compress(content)
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %g %g] /Resources %s /Contents %d 0 R >>" % (*box, resources, first + 2 * i + 1))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed))
    return assemble({i + 1: o for i, o in enumerate(objects)}, 1)


def assemble(objects: dict[int, bytes], root: int) -> bytes:
    out, at = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), {}
    for n, body in sorted(objects.items()):
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    top = max(objects, default=0) + 1
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % top
    out += b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 65535 f \n" for n in range(1, top))
    return bytes(out + b"trailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (top, root, start))


def text_page(text: str) -> bytes:
    """The content stream of one page of text lines; characters outside Latin-1 become question marks."""
    lines = [x.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for x in text.split("\n")]
    return b"BT\n/F1 12 Tf\n50 792 Td\n14 TL\n" + b"".join(b"(%s) Tj\nT*\n" % x for x in lines) + b"ET\n"


class Pdf:
    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-":
            raise ConversionError("Parse", "not a PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ConversionError("Resource", "encrypted PDF")
        self.objects: dict[int, bytes] = {}
        for m in _OBJ.finditer(data):
            end = data.find(b"endobj", m.end())
            body = data[m.end() : end if end >= 0 else len(data)]
            if s := _STREAM.search(body):
                length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", body[: s.start()])
                if length:
                    stop = m.end() + s.end() + int(length[1])
                    body = data[m.end() : stop] + b"\nendstream"
            self.objects[int(m[1])] = body.strip()
        for n, body in list(self.objects.items()):
            if b"/ObjStm" in body[:300]:
                head, raw = self.dictionary(n), self.stream(n)
                first, count = int(re.search(rb"/First\s+(\d+)", head)[1]), int(re.search(rb"/N\s+(\d+)", head)[1])
                numbers = list(map(int, raw[:first].split()))[: 2 * count]
                ends = [*numbers[3::2], len(raw) - first]
                for k, (num, off) in enumerate(zip(numbers[::2], numbers[1::2])):
                    self.objects.setdefault(num, raw[first + off : first + ends[k]].strip())

    def dictionary(self, n: int) -> bytes:
        body = self.objects.get(n, b"")
        s = _STREAM.search(body)
        return body[: s.start()] if s else body

    def stream(self, n: int) -> bytes:
        body = self.objects[n]
        s = _STREAM.search(body)
        if not s:
            return b""
        raw = body[s.end() :].removesuffix(b"endstream").removesuffix(b"\n").removesuffix(b"\r")
        if b"/FlateDecode" in body[: s.start()]:
            return zlib.decompressobj().decompress(body[s.end() :].removesuffix(b"endstream"))
        if b"/Filter" in body[: s.start()]:
            raise ConversionError("Resource", "a stream filter that isn't known")
        return raw

    def pages(self) -> list[int]:
        """Object numbers of the pages, in order of the page tree."""
        root = next((n for n in self.objects if re.search(rb"/Type\s*/Catalog\b", self.dictionary(n))), None)
        if root is None:
            raise ConversionError("Parse", "no catalog")
        out: list[int] = []
        todo, seen = [int(re.search(rb"/Pages\s+(\d+)", self.dictionary(root))[1])], set()
        while todo:
            n = todo.pop()
            d = self.dictionary(n)
            if n in seen:
                continue
            seen.add(n)
            if kids := re.search(rb"/Kids\s*\[(.*?)\]", d, re.S):
                todo += [int(m[1]) for m in reversed(list(_REF.finditer(kids[1])))]
            else:
                out.append(n)
        return out

    def contents(self, page: int) -> bytes:
        found = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", self.dictionary(page), re.S)
        return b"\n".join(self.stream(int(m[1])) for m in _REF.finditer(found[1])) if found else b""

    def inherited(self, page: int) -> bytes:
        """The page's dictionary, with what its parents give it."""
        d, parent = self.dictionary(page), re.search(rb"/Parent\s+(\d+)", self.dictionary(page))
        while parent:
            up = self.dictionary(int(parent[1]))
            for key in (rb"/MediaBox\s*\[.*?\]", rb"/Resources\s*(?:\d+\s+\d+\s+R|<<.*>>)", rb"/Rotate\s+\d+"):
                name = key.split(rb"\s")[0]
                if name not in d and (m := re.search(key, up, re.S)):
                    d = d.rstrip().removesuffix(b">>") + b" " + m[0] + b" >>"
            parent = re.search(rb"/Parent\s+(\d+)", up)
        return d

    def single(self, page: int) -> bytes:
        """A file of one page, with the objects that it reaches."""
        body = re.sub(rb"/Parent\s+\d+\s+\d+\s+R", b"", self.inherited(page))
        order, number = [], {}

        def renumber(raw: bytes) -> bytes:
            s = _STREAM.search(raw)
            head, tail = (raw[: s.start()], raw[s.start() :]) if s else (raw, b"")

            def ref(m):
                n = int(m[1])
                if n not in number:
                    number[n] = 4 + len(order)
                    order.append(n)
                return b"%d 0 R" % number[n]

            return _REF.sub(ref, head) + tail

        out = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>"}
        out[3] = renumber(body.rstrip().removesuffix(b">>") + b" >>")
        out[3] = out[3].rstrip().removesuffix(b">>") + b" /Parent 2 0 R >>"
        k = 0
        while k < len(order):
            out[4 + k] = renumber(self.objects.get(order[k], b"null"))
            k += 1
        return assemble(out, 1)


def operators(stream: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(text, command) of each operator of a content stream; an inline image is one operator."""
    token = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]*|[^\s/<>\[\]()]+", re.S)
    start, depth = None, 0
    for m in token.finditer(stream):
        start = m.start() if start is None else start
        t = m[0]
        depth += (t in (b"[", b"<<")) - (t in (b"]", b">>"))
        if not depth and re.fullmatch(rb"[A-Za-z'\"][A-Za-z0-9*]*", t) and t not in (b"true", b"false", b"null"):
            yield stream[start : m.end()], t
            start = None


def _string(raw: bytes) -> str:
    if raw.startswith(b"<"):
        return bytes.fromhex(raw[1:-1].decode().ljust(len(raw) - 2 + len(raw) % 2, "0")).decode("latin-1")
    out = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return out.decode("latin-1")


def page_text(stream: bytes) -> str:
    """The text shown, a line for each move to another line."""
    out, line, shown = [], "", re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>", re.S)
    for text, cmd in operators(stream):
        if cmd in (b"T*", b"Td", b"TD", b"Tm", b"'", b'"', b"ET") and (line or cmd == b"T*"):
            out.append(line)
            line = ""
        if cmd in (b"Tj", b"TJ", b"'", b'"'):
            line += "".join(_string(m[0]) for m in shown.finditer(text))
    return "\n".join(out)


def split_pages(content: bytes) -> list[Fragment]:
    pdf = Pdf(content)
    pages = pdf.pages()
    if not pages:
        raise ConversionError("Split", "the PDF has no pages")
    return [(pdf.single(p), SHORT["pdf"], i, f"Page {i + 1}") for i, p in enumerate(pages)]


def to_text(content: bytes) -> str:
    pdf = Pdf(content)
    return "\n".join(page_text(pdf.contents(p)) for p in pdf.pages())


def to_html(content: bytes) -> str:
    from xml.sax.saxutils import escape

    pdf = Pdf(content)
    return "<html><body>" + "".join("<div>" + "".join(f"<p>{escape(x)}</p>" for x in page_text(pdf.contents(p)).split("\n")) + "</div>" for p in pdf.pages()) + "</body></html>"


def from_text(pages: list[str]) -> bytes:
    return write_pdf([text_page(p) for p in pages])


def from_image(content: bytes) -> bytes:
    """One page of the image's size. JPEG data goes in as it is; PNG data without interlacing and alpha too, row filters and all."""
    if content.startswith(b"\xff\xd8"):
        at = 2
        while content[at + 1] not in (0xC0, 0xC1, 0xC2):
            at += 2 + struct.unpack(">H", content[at + 2 : at + 4])[0]
        height, width, parts = struct.unpack(">HHB", content[at + 5 : at + 10])
        data, how, space, bits = content, b"/DCTDecode", {1: b"/DeviceGray", 3: b"/DeviceRGB", 4: b"/DeviceCMYK"}[parts], 8
    elif content.startswith(b"\x89PNG"):
        at, data, palette = 8, b"", b""
        while at < len(content):
            size, kind = struct.unpack(">I4s", content[at : at + 8])
            chunk = content[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunk)
            elif kind == b"IDAT":
                data += chunk
            elif kind == b"PLTE":
                palette = chunk
            at += 12 + size
        if interlaced or colour > 3:
            raise ConversionError("Resource", "interlaced and transparent PNG files aren't supported")
        parts = 3 if colour == 2 else 1
        space = b"[/Indexed /DeviceRGB %d <%s>]" % (len(palette) // 3 - 1, palette.hex().encode()) if colour == 3 else b"/DeviceRGB" if colour == 2 else b"/DeviceGray"
        how = b"/FlateDecode /DecodeParms << /Predictor 15 /Colors %d /BitsPerComponent %d /Columns %d >>" % (parts, bits, width)
    else:
        raise ConversionError("Parse", "neither JPEG nor PNG")
    image = b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace %s /BitsPerComponent %d /Filter %s /Length %d >>\nstream\n%s\nendstream" % (width, height, space, bits, how, len(data), data)
    return write_pdf([b"q\n%d 0 0 %d 0 0 cm\n/Im1 Do\nQ\n" % (width, height)], b"<< /XObject << /Im1 3 0 R >> >>", (width, height), [image])


# --- watermarks ------------------------------------------------------------------------------

_SAFE = {x.encode() for x in WRAPPERS + PATHS + PAINTS}
_DRAW = {x.encode() for x in PATHS + PAINTS}


def _tail(ops: list[tuple[bytes, bytes]]) -> int:
    """Index of the first operator after the last text block; the end of a page that has none, as nothing trails there."""
    return max((i + 1 for i, (_, c) in enumerate(ops) if c == b"ET"), default=len(ops))


def strip_marked(ops: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """Without trailing blocks that are marked as watermarks and hold the only drawing there; anything else there keeps it all."""
    at = _tail(ops)
    depth, drawn, marked = 0, False, False
    for text, c in ops[at:]:
        if c in (b"BMC", b"BDC"):
            if not re.search(rb"/watermark\b", text, re.I) or b"/Watermark" not in text and not re.match(rb"\s*/watermark\b", text, re.I):
                return ops
            depth, marked = depth + 1, True
        elif c == b"EMC":
            depth -= 1
            if depth < 0:
                return ops
        elif c not in _SAFE or c in _DRAW and not depth:
            return ops
        else:
            drawn = drawn or c in _DRAW
    return ops[:at] if marked and drawn and not depth else ops


def removable(ops: list[tuple[bytes, bytes]]) -> int:
    tail = ops[_tail(ops) :]
    return len(tail) if all(c in _SAFE for _, c in tail) and any(c in _DRAW for _, c in tail) else 0


def clean_pages(pages: list[list[tuple[bytes, bytes]]], aggressive: bool = False) -> list[list[tuple[bytes, bytes]]]:
    """Marked blocks go. Of unmarked trailing drawing: all if aggressive; else what all such pages begin it with, or, if that
    is short, all of it on the pages that have the most frequent number of operators."""
    pages = [strip_marked(p) for p in pages]
    counts = [removable(p) for p in pages]
    if aggressive:
        return [p[: len(p) - n] for p, n in zip(pages, counts)]
    own = [i for i, n in enumerate(counts) if n]
    if len(own) < 2:
        return pages
    tails = {i: pages[i][len(pages[i]) - counts[i] :] for i in own}
    same = lambda t: re.sub(rb"/G\d+ gs", b"/GX gs", t)
    prefix = 0
    while all(prefix < len(t) for t in tails.values()) and len({same(t[prefix][0]) for t in tails.values()}) == 1:
        prefix += 1
    if prefix >= MIN_PREFIX:
        if any(c in (b"m", b"c", b"l") for _, c in next(iter(tails.values()))[:prefix]):
            for i in own:
                at = len(pages[i]) - counts[i]
                pages[i] = pages[i][:at] + pages[i][at + prefix :]
        return pages
    often = min({counts[i] for i in own}, key=lambda n: (-sum(counts[i] == n for i in own), n))
    if sum(counts[i] == often for i in own) >= 2:
        pages = [p[: len(p) - n] if n == often else p for p, n in zip(pages, counts)]
    return pages


def remove_watermarks(content: bytes, aggressive: bool = False) -> bytes:
    """The file with cleaned content streams and without watermark annotations."""
    pdf = Pdf(content)
    pages = pdf.pages()
    before = [list(operators(pdf.contents(p))) for p in pages]
    objects = dict(pdf.objects)
    marks = {n for n in objects if re.search(rb"/Subtype\s*/Watermark\b", pdf.dictionary(n))}
    top = max(objects) + 1
    for k, (page, old, new) in enumerate(zip(pages, before, clean_pages(before, aggressive))):
        d = objects[page]
        if len(new) != len(old):
            packed = zlib.compress(b"\n".join(t for t, _ in new))
            objects[top + k] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed)
            d = re.sub(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", b"/Contents %d 0 R" % (top + k), d, flags=re.S)
        for n in marks:
            d = re.sub(rb"(/Annots\s*\[[^\]]*?)\b%d\s+\d+\s+R" % n, rb"\1", d)
        objects[page] = d
    root = next(n for n in objects if re.search(rb"/Type\s*/Catalog\b", pdf.dictionary(n)))
    kept = {n: b for n, b in objects.items() if n not in marks and b"/ObjStm" not in b[:300] and b"/XRef" not in b[:300]}
    return assemble(kept, root)


def split_pdfs(df: DataFrame) -> DataFrame:
    return split_documents(df, split_pages)


def convert_pdfs(df: DataFrame, target: str, aggressive: bool = False) -> DataFrame:
    how = {"text": to_text, "html": to_html, "clean": lambda c: remove_watermarks(c, aggressive)}
    return convert_documents(df, how[target])
