"""What a document is, without reading it: `spark.read.format("docloom_info").load(path)`.

A task gets many files and reads of each its last bytes and its directory: of a ZIP-based document the central directory and the small parts with
properties, of a PDF the cross-reference table or stream and the few objects that it leads to. No body ever is in a row or in
memory, so a workbook of many gigabytes costs as much as one of a few kilobytes. `bytes_read` says how much that was.

Rows: path, size, mime (by name, else by the first bytes), entries (of a ZIP directory; null for others), parts (sheets, slides, pages or
entries that a split would give; null if unknown), raw_metadata (many-valued), bytes_read, error. Option: `splitBytes`, `files` (at most so many files a task).

Defined cases: an empty file has no metadata; a file that can't be read as what its name or beginning says has its size and type only, and a
Parse error; an encrypted PDF, or one whose directory is broken, counts as such.
"""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docloom.functions.mime import BY_EXTENSION, OCTET, SHORT
from docloom.functions.text import format_size
from docloom.operators.archive import mac_entry
from docloom.operators.base import ConversionError, as_error
from docloom.operators.info import OFFICE_PARTS, info_columns, office_properties
from docloom.schema import ERROR
from docloom.sources.archives import Ranges
from docloom.sources.ranges import RangeFile, list_files

SCHEMA = f"path string, size long, mime string, entries int, parts int, raw_metadata map<string, array<string>>, bytes_read long, error {ERROR}"
FILES = 2000
#: A part with properties that is larger than this is not one.
PROPERTY_BYTES = 4 << 20
#: Levels of a PDF's chain of updates, and of its tree of pages, that are followed.
LEVELS = 64


class InformationSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docloom_info"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return InformationReader(self.options, schema)


class InformationReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.files, self.arrow = options["path"], int(options.get("files", FILES)), to_arrow_schema(schema)

    def partitions(self) -> Sequence[InputPartition]:
        found = [(p, 0, n) for p, n in list_files(self.path)]
        tasks = max(1, -(-len(found) // self.files))
        return [Ranges(found[k::tasks]) for k in range(tasks)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(partition.parts), 500):
            rows = [information(path) for path, _, _ in partition.parts[at : at + 500]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.arrow)], schema=self.arrow)


def information(path: str) -> tuple:
    try:
        with RangeFile(path) as file:
            head = file.read(1024)
            mime = BY_EXTENSION.get(path.rpartition("/")[2].rpartition(".")[2].lower(), "") or (SHORT["pdf"] if head.startswith(b"%PDF-") else SHORT["zip"] if head.startswith(b"PK") else OCTET)
            if not file.size:
                return path, 0, mime, None, None, {}, 0, None
            raw, entries, parts, fault = {"fileSize": [str(file.size)], "detectedType": [mime]}, None, None, None
            try:
                if head.startswith(b"PK"):
                    entries, parts, more = of_zip(file, mime)
                    raw |= more
                elif head.startswith(b"%PDF-"):
                    parts, more = of_pdf(file)
                    raw |= more
                elif mime in (SHORT["pdf"], SHORT["zip"], SHORT["docx"], SHORT["xlsx"], SHORT["pptx"], SHORT["ods"], SHORT["odt"]):
                    raise ConversionError("Parse", f"this is no {mime}")
            except (ConversionError, zipfile.BadZipFile, NotImplementedError, ET.ParseError, zlib.error, struct.error, ValueError, KeyError, IndexError, RuntimeError) as e:
                fault = as_error(e if isinstance(e, ConversionError) else ConversionError("Parse", str(e) or type(e).__name__), "Parse")
            return path, file.size, mime, entries, parts, list(raw.items()), file.bytes_read, fault
    except OSError as e:
        return path, None, None, None, None, {}, 0, as_error(ConversionError("Resource", str(e)), "Resource")


def of_zip(file: RangeFile, mime: str) -> tuple[int, int, dict[str, list[str]]]:
    """Entries, parts and properties by the central directory."""
    with zipfile.ZipFile(file) as z:
        listed = z.infolist()
        names = {i.filename: i for i in listed}

        def small(name: str) -> bytes | None:
            return z.read(name) if name in names and names[name].file_size <= PROPERTY_BYTES else None

        found: dict[str, list[str]] = {}
        for part in OFFICE_PARTS:
            if (data := small(part)) is not None:
                office_properties(data, found)
        parts = sum(not i.is_dir() and not mac_entry(i.filename) for i in listed)
        if mime == SHORT["xlsx"] and (book := small("xl/workbook.xml")) is not None:
            found["sheetNames"] = [e.get("name", "") for e in ET.fromstring(book).iter() if e.tag.rpartition("}")[2] == "sheet"]
            parts = len(found["sheetNames"])
        elif mime == SHORT["pptx"]:
            parts = sum(re.fullmatch(r"ppt/slides/slide\d+\.xml", n) is not None for n in names)
        elif mime in (SHORT["docx"], SHORT["odt"]):
            parts = 1
        return len(listed), parts, found


class PdfObjects:
    """Objects of a PDF by its cross-reference tables and streams, each read where it lies."""

    def __init__(self, file: RangeFile):
        self.file = file
        self.places: dict[int, tuple[int, int]] = {}  # number -> (offset, -1), or (number of the stream that holds it, place there)
        self.held: dict[int, list[bytes]] = {}
        tail = self._at(max(0, file.size - 2048), 2048)
        if not (m := list(re.finditer(rb"startxref\s+(\d+)", tail))):
            raise ConversionError("Parse", "no cross-reference table")
        self.trailer = b""
        at: int | None = int(m[-1][1])
        for _ in range(LEVELS):
            if at is None:
                break
            at = self._section(at)

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def _until(self, offset: int, mark: bytes) -> bytes:
        """From an offset until after a mark, in growing steps."""
        size = 4096
        while True:
            data = self._at(offset, size)
            if (k := data.find(mark)) >= 0:
                return data[: k + len(mark)]
            if len(data) < size or size > PROPERTY_BYTES:
                raise ConversionError("Parse", f"{mark.decode()} is missing")
            size *= 4

    def _section(self, at: int) -> int | None:
        if self._at(at, 4) == b"xref":
            data = self._until(at, b"trailer")
            for start, n, rows in re.findall(rb"(\d+) (\d+)\s*?\r?\n?((?:\d{10} \d{5} [nf]\s*)*)", data):
                for k, row in enumerate(re.findall(rb"(\d{10}) \d{5} ([nf])", rows)[: int(n)]):
                    if row[1] == b"n":
                        self.places.setdefault(int(start) + k, (int(row[0]), -1))
            head = self._until(at + len(data), b"startxref")
        else:
            head, body = self._stream(at)
            widths = [int(x) for x in re.search(rb"/W\s*\[\s*(\d+)\s+(\d+)\s+(\d+)", head).groups()]
            size = int(re.search(rb"/Size\s+(\d+)", head)[1])
            listed = re.search(rb"/Index\s*\[([\d\s]*)\]", head)
            index = [int(x) for x in listed[1].split()] if listed else [0, size]
            row = 0
            for start, n in zip(index[::2], index[1::2]):
                for k in range(n):
                    cells, base = [], row * sum(widths)
                    for w in widths:
                        cells.append(int.from_bytes(body[base : base + w], "big") if w else None)
                        base += w
                    kind = 1 if cells[0] is None else cells[0]
                    if kind == 1:
                        self.places.setdefault(start + k, (cells[1], -1))
                    elif kind == 2:
                        self.places.setdefault(start + k, (cells[1], cells[2] or 0))
                    row += 1
        self.trailer += head
        m = re.search(rb"/Prev\s+(\d+)", head)
        return int(m[1]) if m else None

    def _stream(self, at: int) -> tuple[bytes, bytes]:
        """Dictionary and data of a stream, inflated, and the rows' predictor undone."""
        head = self._until(at, b"stream")
        m = re.search(rb"/Length\s+(\d+)(\s+\d+\s+R)?", head)
        length = int(re.search(rb"obj\s+(\d+)", self.get(int(m[1])))[1]) if m[2] else int(m[1])
        skip = 2 if self._at(at + len(head), 2) == b"\r\n" else 1
        data = self._at(at + len(head) + skip, length)
        if b"/FlateDecode" in head:
            data = zlib.decompressobj().decompress(data, PROPERTY_BYTES * 4)
        if (p := re.search(rb"/Predictor\s+(\d+)", head)) and int(p[1]) >= 10:
            width = int(m[1]) if (m := re.search(rb"/Columns\s+(\d+)", head)) else 1
            above, rows = bytes(width), []
            for k in range(0, len(data) - width, width + 1):
                row = data[k + 1 : k + 1 + width]
                if data[k] == 2:
                    row = bytes((a + b) & 255 for a, b in zip(row, above))
                elif data[k]:
                    raise ConversionError("Parse", f"predictor {data[k]} of a cross-reference stream")
                rows.append(above := row)
            data = b"".join(rows)
        return head, data

    def get(self, number: int) -> bytes:
        place, inside = self.places[number]
        if inside < 0:
            return self._until(place, b"endobj")
        if place not in self.held:
            head, data = self._stream(self.places[place][0])
            first, n = (int(re.search(rb"/" + k + rb"\s+(\d+)", head)[1]) for k in (b"First", b"N"))
            offsets = [int(x) for x in data[:first].split()[1 : 2 * n : 2]]
            self.held[place] = [data[first + a : first + b] for a, b in zip(offsets, [*offsets[1:], len(data)])]
        return self.held[place][inside]

    def follow(self, holder: bytes, key: bytes) -> bytes | None:
        m = re.search(rb"/" + key + rb"\s+(\d+)\s+\d+\s+R", holder)
        return self.get(int(m[1])) if m else None


def of_pdf(file: RangeFile) -> tuple[int | None, dict[str, list[str]]]:
    """Pages and properties."""
    objects = PdfObjects(file)
    if b"/Encrypt" in objects.trailer:
        raise ConversionError("Parse", "encrypted")
    root = objects.follow(objects.trailer, b"Root")
    tree = objects.follow(root, b"Pages") if root else None
    count = re.search(rb"/Count\s+(\d+)", tree) if tree else None
    found: dict[str, list[str]] = {}
    if count:
        found["xmpTPg:NPages"] = [count[1].decode()]
    info = objects.follow(objects.trailer, b"Info") or b""
    for key, name in ((b"Title", "dc:title"), (b"Author", "dc:creator"), (b"CreationDate", "dcterms:created"), (b"ModDate", "dcterms:modified")):
        if m := re.search(rb"/" + key + rb"\s*\(((?:[^()\\]|\\.)*)\)", info):
            text = re.sub(rb"\\(.)", rb"\1", m[1], flags=re.S)
            found[name] = [text[2:].decode("utf-16-be", "replace") if text.startswith(b"\xfe\xff") else text.decode("latin-1")]
    return int(count[1]) if count else None, found


def read_information(spark: SparkSession, path: str, files: int = FILES) -> DataFrame:
    """The rows of the source, with title, author, created, modified, page_count, word_count and size_text."""
    spark.dataSource.register(InformationSource)
    found = spark.read.format("docloom_info").option("files", files).load(path)
    return found.select("*", *(c.alias(n) for n, c in info_columns(F.col("raw_metadata")).items()), format_size(F.col("size")).alias("size_text"))
