"""MIME types as columns: parsing, extensions, file names, content detection. Built-in expressions only."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

OCTET = "application/octet-stream"

# Type, extensions it is recognised by, extension it is written with ("-": none).
_TABLE = """
text/plain | txt | txt
text/html | html htm | html
text/markdown | md markdown | md
text/csv | csv | csv
text/tab-separated-values | tsv | tsv
text/xml | - | xml
text/css | css | css
text/javascript | js | js
application/json | json | json
application/xml | xml | xml
application/pdf | pdf | pdf
application/zip | zip | zip
application/gzip | gz gzip | gz
application/x-7z-compressed | 7z | 7z
application/x-tar | tar | tar
application/x-bzip2 | bz2 | bz2
application/x-xz | xz | xz
application/vnd.rar | rar | rar
application/octet-stream | - | bin
application/xhtml+xml | - | xhtml
application/javascript | - | js
application/rtf | rtf | rtf
application/msword | doc | doc
application/vnd.ms-excel | xls | xls
application/vnd.ms-powerpoint | ppt | ppt
application/vnd.ms-outlook | msg | msg
application/vnd.openxmlformats-officedocument.wordprocessingml.document | docx | docx
application/vnd.openxmlformats-officedocument.spreadsheetml.sheet | xlsx | xlsx
application/vnd.openxmlformats-officedocument.presentationml.presentation | pptx | pptx
application/vnd.ms-excel.sheet.macroenabled.12 | xlsm | xlsm
application/vnd.ms-excel.sheet.binary.macroenabled.12 | xlsb | xlsb
application/vnd.ms-word.document.macroenabled.12 | docm | docm
application/vnd.ms-powerpoint.presentation.macroenabled.12 | pptm | pptm
application/vnd.oasis.opendocument.text | odt | odt
application/vnd.oasis.opendocument.spreadsheet | ods | ods
application/vnd.oasis.opendocument.presentation | odp | odp
application/vnd.oasis.opendocument.graphics | odg | odg
application/vnd.oasis.opendocument.formula | odf | odf
image/jpeg | jpg jpeg | jpg
image/png | png | png
image/gif | gif | gif
image/bmp | bmp | bmp
image/svg+xml | svg | svg
image/tiff | tif tiff | tiff
image/webp | webp | webp
image/x-icon | ico | ico
image/heic | heic heif | heic
image/avif | avif | avif
message/rfc822 | eml | eml
audio/mpeg | mp3 | mp3
audio/ogg | ogg | ogg
audio/wav | wav | wav
audio/flac | flac | flac
audio/aac | aac | aac
audio/webm | - | webm
audio/mp4 | m4a | m4a
video/mp4 | mp4 | mp4
video/webm | webm | webm
video/ogg | - | ogv
video/x-msvideo | avi | avi
video/quicktime | mov | mov
video/x-matroska | mkv | mkv
font/woff | woff | woff
font/woff2 | woff2 | woff2
font/ttf | ttf | ttf
font/otf | otf | otf
multipart/form-data | - | -
multipart/mixed | - | -
"""

_ROWS = [[x.strip() for x in line.split("|")] for line in _TABLE.strip().splitlines()]
KNOWN = [r[0] for r in _ROWS]
BY_EXTENSION = {e: r[0] for r in _ROWS for e in r[1].split() if e != "-"}
EXTENSION_OF = {r[0]: r[2] for r in _ROWS if r[2] != "-"}
#: short name -> type, for the registry
SHORT = {r[2]: r[0] for r in _ROWS if r[2] not in ("-", "xml", "js")} | {"xml": "application/xml", "plain": "text/plain", "markdown": "text/markdown", "jpeg": "image/jpeg"}

# First bytes (hex) of file formats.
_MAGIC = [
    ("255044462D", "application/pdf"),
    ("D0CF11E0A1B11AE1", "application/x-ole-storage"),
    ("FFD8FF", "image/jpeg"),
    ("89504E47", "image/png"),
    ("47494638", "image/gif"),
    ("424D", "image/bmp"),
    ("49492A00", "image/tiff"),
    ("4D4D002A", "image/tiff"),
    ("1F8B", "application/gzip"),
    ("377ABCAF271C", "application/x-7z-compressed"),
    ("425A68", "application/x-bzip2"),
    ("FD377A585A00", "application/x-xz"),
    ("526172211A07", "application/vnd.rar"),
    ("7B5C727466", "application/rtf"),
]

# Generic types that say nothing about the content.
GENERIC = [OCTET, "application/x-www-form-urlencoded"]


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain(*table.items()))), key)


def base_type(m) -> Column:
    """Up to the first slash; the whole string if there is none."""
    return F.split_part(m, F.lit("/"), F.lit(1))


def sub_type(m) -> Column:
    """After the first slash, up to a semicolon; empty without a slash."""
    return F.split_part(F.regexp_extract(m, r"^[^/]*/(.*)$", 1), F.lit(";"), F.lit(1))


def strip_parameters(m) -> Column:
    return F.trim(F.split_part(m, F.lit(";"), F.lit(1)))


def parse(m) -> Column:
    return F.lower(strip_parameters(m))


def is_kind(m, kind: str) -> Column:
    """kind: text, application, image, message, audio or video."""
    return base_type(m) == kind


def known(m) -> Column:
    """The parsed type if it is registered, else null."""
    return F.when(parse(m).isin(KNOWN), parse(m))


def from_extension(e) -> Column:
    """Case and one leading dot don't count; unknown extensions are octet streams."""
    return F.coalesce(_lookup(BY_EXTENSION, F.regexp_replace(F.lower(e), r"^\.", "")), F.lit(OCTET))


def from_filename(name) -> Column:
    return from_extension(F.regexp_extract(name, r"\.([^.]+)$", 1))


def file_extension(path) -> Column:
    """Lower-case extension of a path whose dot is neither its first nor its last character; else empty."""
    return F.regexp_extract(F.lower(path), r"^.+\.([^.]+)$", 1)


def extension_for(m, default: str = "bin") -> Column:
    return F.coalesce(_lookup(EXTENSION_OF, F.lower(strip_parameters(m))), F.lit(default))


def _directory(content: Column) -> Column:
    """A ZIP's central directory, bytes as characters; null if its end record isn't there."""
    # the end record may be followed by a comment of 64 KB at most
    tail = F.decode(F.substring(content, -65_557, 65_557), "ISO-8859-1")
    before = F.length(F.regexp_extract(tail, r"(?s)^(.*)PK\x05\x06.{18}", 1))
    size = F.hex(F.encode(F.substring(tail, before + 13, F.lit(4)), "ISO-8859-1"))
    size = F.conv(F.concat(*(F.substring(size, k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("long")
    start = F.length(content) - F.length(tail) + before - size + 1
    return F.when((before > 0) & (start >= 1), F.decode(F.substring(content, start.cast("int"), size.cast("int")), "ISO-8859-1"))


def sniff(content) -> Column:
    """The type by first bytes: magic numbers, then markup and mail headers, then text or octet stream.

    Office containers are told apart by the names in the ZIP's central directory; in the first 4 KB if it has none.
    """
    content = F.col(content) if isinstance(content, str) else content
    # bound once: the cases look at them many times
    seen = F.struct(content.alias("content"), F.substring(content, 1, 4096).alias("head"), F.hex(F.substring(content, 1, 264)).alias("hexed"))
    return F.element_at(F.transform(F.array(seen), lambda s: _sniffed(s["content"], s["head"], s["hexed"])), 1)


def _sniffed(content: Column, head: Column, hexed: Column) -> Column:
    out = F.when(F.length(content) == 0, OCTET)
    for magic, mime in _MAGIC:
        out = out.when(hexed.startswith(magic), mime)
    has = lambda s: F.contains(head, F.lit(s.encode()))
    zipped = hexed.startswith("504B0304")
    for part, short in (("mimetypeapplication/vnd.oasis.opendocument.text", "odt"), ("mimetypeapplication/vnd.oasis.opendocument.spreadsheet", "ods"), ("mimetypeapplication/vnd.oasis.opendocument.presentation", "odp"), ("mimetypeapplication/vnd.oasis.opendocument.graphics", "odg")):
        out = out.when(zipped & has(part), SHORT[short])
    directory = _directory(content)
    for part, short in (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx")):
        out = out.when(zipped & F.when(directory.isNull(), has(part)).otherwise(directory.rlike(rf"(?s)PK\x01\x02.{{42}}{part}")), SHORT[short])
    out = out.when(zipped, SHORT["zip"]).when(F.substring(hexed, 515, 10) == "7573746172", SHORT["tar"])
    out = out.when(hexed.startswith("52494646") & (F.substring(hexed, 17, 8) == "57454250"), SHORT["webp"])
    text = F.lower(F.make_valid_utf8(F.substring(F.ltrim(content.cast("string")), 1, 256)))
    out = out.when(text.startswith("<!doctype html") | text.startswith("<html"), SHORT["html"]).when(text.startswith("<?xml"), SHORT["xml"])
    out = out.when(text.rlike(r"^(from|received|mime-version|return-path|message-id):"), SHORT["eml"])
    return out.when(~F.contains(head, F.lit(b"\x00")) & F.is_valid_utf8(content.cast("string")), SHORT["txt"]).otherwise(OCTET)


def detect(content, filename) -> Column:
    """Content first; the file name if that says nothing."""
    found = sniff(content)
    return F.when(found != OCTET, found).otherwise(from_filename(filename))


def detect_lazily(content, filename) -> Column:
    """File name first; the content is looked at only if the name says nothing."""
    named = from_filename(filename)
    return F.when(named != OCTET, named).otherwise(sniff(content))


def detect_or_text(content, filename) -> Column:
    """Content first; plain text gives way to what the name says, and what is unknown is plain text."""
    found, named = sniff(content), from_filename(filename)
    return F.when(found.isin("text/plain", OCTET), F.when(named != OCTET, named).otherwise("text/plain")).otherwise(found)


def detect_request(header, content, force_sniff=None) -> Column:
    """A request's type: its header unless generic or absent, else its content."""
    given = parse(header)
    trust = header.isNotNull() & ~given.isin(GENERIC) if isinstance(header, Column) else F.col(header).isNotNull() & ~given.isin(GENERIC)
    if force_sniff is not None:
        trust = trust & ~force_sniff
    return F.when(trust, given).otherwise(sniff(content))


def target_shorthand(s) -> Column:
    """A target given as a type, as plain, text, xml or json, or as an extension."""
    low = F.lower(F.trim(s))
    return F.when(F.instr(low, "/") > 0, parse(s)).when(low.isin("plain", "text"), "text/plain").when(low == "xml", "application/xml").when(low == "json", "application/json").otherwise(from_extension(low))
