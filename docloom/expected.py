"""Rows that the registry's queries must give, written out on their own: nothing here is taken from the engine's tables.

Fixed values: types, routes by licensed product, routes of the office process, splits and report lists.
"""

MIME = {
    "7z": "application/x-7z-compressed",
    "csv": "text/csv",
    "doc": "application/msword",
    "docm": "application/vnd.ms-word.document.macroenabled.12",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "eml": "message/rfc822",
    "html": "text/html",
    "jpeg": "image/jpeg",
    "json": "application/json",
    "markdown": "text/markdown",
    "msg": "application/vnd.ms-outlook",
    "odg": "application/vnd.oasis.opendocument.graphics",
    "odp": "application/vnd.oasis.opendocument.presentation",
    "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "odt": "application/vnd.oasis.opendocument.text",
    "pdf": "application/pdf",
    "plain": "text/plain",
    "png": "image/png",
    "ppt": "application/vnd.ms-powerpoint",
    "pptm": "application/vnd.ms-powerpoint.presentation.macroenabled.12",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "rtf": "application/rtf",
    "svg": "image/svg+xml",
    "tsv": "text/tab-separated-values",
    "txt": "text/plain",
    "xls": "application/vnd.ms-excel",
    "xlsb": "application/vnd.ms-excel.sheet.binary.macroenabled.12",
    "xlsm": "application/vnd.ms-excel.sheet.macroenabled.12",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xml": "application/xml",
    "zip": "application/zip",
}

COMMERCIAL = {
    "words": """
docx>pdf doc>pdf doc>docx docx>doc docm>docx docm>doc doc>docm docx>docm docx>html doc>html
docm>html docx>plain doc>plain docx>markdown doc>markdown rtf>pdf rtf>docx rtf>html docx>rtf docx>png
docx>jpeg
""",
    "cells": """
xlsx>pdf xls>pdf xlsm>pdf xlsb>pdf ods>pdf xlsx>html xls>html xlsm>html xlsb>html ods>html
xls>xlsx xlsx>xls xlsm>xlsx xlsb>xlsx xlsx>xlsm xlsx>xlsb ods>xlsx xlsx>ods xlsx>csv xls>csv
xlsm>csv xlsb>csv ods>csv xlsx>json xlsx>markdown
""",
    "slides": """
pptx>pdf ppt>pdf pptx>html ppt>html html>pptx html>ppt ppt>pptx pptx>ppt pptm>pptx pptm>ppt
pdf>pptx pdf>ppt pptx>png pptx>jpeg ppt>png ppt>jpeg
""",
    "pdf": """
pdf>html pdf>pdf pdf>png pdf>jpeg png>pdf jpeg>pdf html>pdf pdf>docx pdf>doc pdf>xlsx
""",
    "email+words": """
eml>pdf msg>pdf eml>html msg>html
""",
    "email": """
eml>msg msg>eml
""",
}

OFFICE = """
docx>pdf doc>pdf docm>pdf xlsx>pdf xls>pdf xlsm>pdf xlsb>pdf ods>pdf pptx>pdf ppt>pdf
pptm>pdf odt>pdf odp>pdf odg>pdf rtf>pdf csv>pdf csv>xlsx csv>ods csv>html html>pdf
html>docx html>odt docx>html doc>html odt>html rtf>html odg>svg odg>png docx>png doc>png
pptx>png ppt>png docx>jpeg doc>jpeg pptx>jpeg ppt>jpeg doc>docx docx>doc docm>docx docm>doc
xls>xlsx xlsx>xls xlsb>xlsx xlsm>xlsx ods>xlsx xlsx>ods xls>ods ods>xls ppt>pptx pptx>ppt
pptm>pptx pptm>ppt odt>docx docx>odt odp>pptx pptx>odp odp>ppt ppt>odp odt>rtf rtf>docx
"""

SPLITS = {
    "commercial": "7z doc docx eml msg ods pdf ppt pptx xls xlsb xlsm xlsx zip",
    "core": "csv docx eml msg ods pdf plain pptx xls xlsx zip",
}

REPORT_TYPES = "7z csv doc docx eml html json markdown msg odp ods odt pdf plain ppt pptx rtf tsv xls xlsb xlsm xlsx xml zip"
REPORT_TARGETS = "csv docx eml html jpeg json markdown msg odp ods odt pdf plain png pptx rtf xlsx xml"
SERVER_TARGETS = "csv docx html jpeg odp ods odt pdf plain png pptx xlsx xml"

OTHER_TYPES = """
application/gzip application/octet-stream application/vnd.oasis.opendocument.formula application/vnd.rar application/x-bzip2 application/x-tar application/x-xz application/xhtml+xml
audio/aac audio/flac audio/mp4 audio/mpeg audio/ogg audio/wav font/otf font/ttf font/woff font/woff2
image/avif image/bmp image/gif image/heic image/tiff image/webp image/x-icon text/css
video/mp4 video/ogg video/quicktime video/webm video/x-matroska video/x-msvideo
"""


def pairs(text: str) -> list[tuple[str, str]]:
    return [tuple(MIME[x] for x in p.split(">")) for p in text.split()]


def commercial() -> list[tuple[str, str, list[str]]]:
    """source, target, products."""
    return [(a, b, k.split("+")) for k, text in COMMERCIAL.items() for a, b in pairs(text)]


def all_types() -> list[str]:
    return sorted({*MIME.values(), *OTHER_TYPES.split()})
