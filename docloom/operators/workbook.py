"""Workbooks: XLSX and ODS read into cells and written from them; sheets split off; CSV, JSON, Markdown and HTML of a sheet.

Formulas are read with their cached values; those without one are worked out if they are made of values, references, operators and
the functions listed below, each cell once, and are refused otherwise.
"""

from __future__ import annotations

import io
import json
import math
import re
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame

from docloom.functions.mime import SHORT
from docloom.functions.options import PAPER_SIZES, ConvertOptions
from docloom.operators.archive import build_zip
from docloom.operators.base import ConversionError, Fragment, convert_documents, explode_documents, split_documents
from docloom.schema import CELL

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_T = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_O = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
_X = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
#: Cells with content that an ODS file's repeats may stand for, about 800 MB; a file with more is an error.
MAX_REPEATED_CELLS = 4_000_000


@dataclass
class Cell:
    type: str  # string, number, boolean
    value: str
    formula: str | None = None


@dataclass
class Sheet:
    name: str
    cells: dict[tuple[int, int], Cell] = field(default_factory=dict)
    hidden: bool = False

    def grid(self) -> list[list[str]]:
        """Values from the first cell to the last."""
        if not self.cells:
            return []
        rows, cols = max(r for r, _ in self.cells) + 1, max(c for _, c in self.cells) + 1
        return [[self.cells[r, c].value if (r, c) in self.cells else "" for c in range(cols)] for r in range(rows)]


def column_name(c: int) -> str:
    out = ""
    while c >= 0:
        out, c = chr(65 + c % 26) + out, c // 26 - 1
    return out


def parse_reference(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref.upper())
    c = 0
    for x in m[1]:
        c = 26 * c + ord(x) - 64
    return int(m[2]) - 1, c - 1


# --- reading ---------------------------------------------------------------------------------


def read_workbook(content: bytes) -> list[Sheet]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        if "xl/workbook.xml" in names:
            return _read_xlsx(z, names)
        if "content.xml" in names:
            return _read_ods(z)
    raise ConversionError("Parse", "no workbook in the archive")


def _read_xlsx(z: zipfile.ZipFile, names: set[str]) -> list[Sheet]:
    shared = ["".join(t.text or "" for t in si.iter(_M + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(_M + "si")] if "xl/sharedStrings.xml" in names else []
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ET.fromstring(z.read("xl/workbook.xml")).iter(_M + "sheet"):
        sheet = Sheet(s.get("name"), hidden=s.get("state") in ("hidden", "veryHidden"))
        path = targets[s.get(_R + "id")]
        path = path.lstrip("/") if path.startswith("/") else f"xl/{path}"
        for c in ET.fromstring(z.read(path)).iter(_M + "c"):
            kind, v, f = c.get("t", "n"), c.find(_M + "v"), c.find(_M + "f")
            formula = f.text if f is not None else None
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(_M + "t"))
            else:
                text = (v.text or "") if v is not None else ""
            if kind == "s":
                text = shared[int(text)]
            if text or formula or kind == "inlineStr":
                typ = {"b": "boolean", "n": "number"}.get(kind, "string")
                sheet.cells[parse_reference(c.get("r"))] = Cell(typ, {"1": "true", "0": "false"}.get(text, text) if typ == "boolean" else text, formula)
        out.append(sheet)
    return out


def _read_ods(z: zipfile.ZipFile) -> list[Sheet]:
    root = ET.fromstring(z.read("content.xml"))
    hidden = {s.get("{urn:oasis:names:tc:opendocument:xmlns:style:1.0}name") for s in root.iter("{urn:oasis:names:tc:opendocument:xmlns:style:1.0}style") for p in s if p.get(_T + "display") == "false"}
    out, repeated = [], 0
    for t in root.iter(_T + "table"):
        sheet, r = Sheet(t.get(_T + "name"), hidden=t.get(_T + "style-name") in hidden), 0
        for row in t.iter(_T + "table-row"):
            times, c = int(row.get(_T + "number-rows-repeated", 1)), 0
            found = {}
            for cell in row:
                again, kind = int(cell.get(_T + "number-columns-repeated", 1)), cell.get(_O + "value-type")
                if kind:
                    text = "\n".join("".join(p.itertext()) for p in cell.iter(_X + "p"))
                    value = {"float": cell.get(_O + "value"), "boolean": cell.get(_O + "boolean-value")}.get(kind, text)
                    one = Cell({"float": "number", "boolean": "boolean"}.get(kind, "string"), value or "", cell.get(_T + "formula"))
                    repeated += again - 1
                    if repeated > MAX_REPEATED_CELLS:
                        raise ConversionError("Resource", f"repeats stand for more than {MAX_REPEATED_CELLS} cells")
                    found |= {c + k: one for k in range(again)}
                c += again
            if found:
                repeated += (times - 1) * len(found)
                if repeated > MAX_REPEATED_CELLS:
                    raise ConversionError("Resource", f"repeats stand for more than {MAX_REPEATED_CELLS} cells")
                for k in range(times):
                    sheet.cells |= {(r + k, x): one for x, one in found.items()}
            r += times
        out.append(sheet)
    return out


# --- formulas --------------------------------------------------------------------------------
# A formula that can't be read or uses what isn't known here raises ValueError: it is refused, never guessed.

_TOKEN = re.compile(r"""\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?)|((?:'(?:[^']|'')+'|\w+)!)?(\$?[A-Za-z]{1,3}\$?\d+)(?::(\$?[A-Za-z]{1,3}\$?\d+))?(?![A-Za-z0-9_(])|([A-Za-z][A-Za-z.]*)\(|"((?:[^"]|"")*)"|(TRUE|FALSE)\b|(<>|<=|>=|[-+*/^&%<>=(),]))""", re.I)
_NUMBER = re.compile(r"\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*")


def _number(x) -> float:
    if isinstance(x, list):
        raise ValueError("a range where a number is needed")
    if isinstance(x, str):
        if not _NUMBER.fullmatch(x):
            raise ValueError(f"{x!r} is no number")
        return float(x)
    return float(x or 0.0)


def _text(x) -> str:
    if isinstance(x, list):
        raise ValueError("a range where text is needed")
    return "" if x is None else ("TRUE" if x else "FALSE") if isinstance(x, bool) else x if isinstance(x, str) else number_text(x)


def _upper(text: str) -> str:
    """A capital for each character, so that the length stays: ẞ for ß; what has none of a single character stays."""
    one = lambda c: "ẞ" if c == "ß" else next((u for u in (c.upper(), c.title()) if len(u) == 1), c)
    return text.upper() if text.isascii() else "".join(map(one, text))


def _truth(x) -> bool:
    if isinstance(x, str) and x.upper() in ("TRUE", "FALSE"):
        return x.upper() == "TRUE"
    return _number(x) != 0


def _compare(op: str, a, b) -> bool:
    """Numbers come before text, text before truth values; case doesn't count."""
    a, b = ("" if isinstance(b, str) else 0.0) if a is None else a, ("" if isinstance(a, str) else 0.0) if b is None else b
    rank = lambda x: (2, x) if isinstance(x, bool) else (1, x.lower()) if isinstance(x, str) else (0, float(x))
    if isinstance(a, list) or isinstance(b, list):
        raise ValueError("a range where a value is needed")
    x, y = rank(a), rank(b)
    return {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]


def _criterion(c) -> Callable:
    """A test of cells: an operator before a value, wildcards in text, else equality."""
    if not isinstance(c, str):
        return lambda v: v is not None and type(v) is type(c) and _compare("=", v, c)
    op, rest = re.match(r"(<>|<=|>=|[<>=])?(.*)", c, re.S).groups()
    if _NUMBER.fullmatch(rest):
        n = float(rest)
        same = lambda v: isinstance(v, float) or isinstance(v, str) and bool(_NUMBER.fullmatch(v)) and (op or "=") in ("=", "<>")
        if op == "<>":
            return lambda v: not (same(v) and float(v) == n)
        return lambda v: same(v) and _compare(op or "=", float(v), n)
    if op in ("<", ">", "<=", ">="):
        return lambda v: isinstance(v, str) and _compare(op, v, rest)
    pattern = re.compile("".join({"*": ".*", "?": "."}.get(p, re.escape(p.removeprefix("~"))) for p in re.findall(r"~[*?~]|.", rest, re.S)), re.I | re.S)
    meets = (lambda v: v is None or v == "") if not rest else lambda v: isinstance(v, str) and bool(pattern.fullmatch(v))
    return (lambda v: not meets(v)) if op == "<>" else meets


class _Range(list):
    """Values of a range by row; width: its columns."""

    width = 1


def _flat(args: list) -> list:
    return [x for a in args for x in (a if isinstance(a, list) else [a])]


def _numbers(args: list) -> list[float]:
    """Of ranges only the numbers count; values given themselves must be numbers."""
    return [x for a in args for x in ([v for v in a if isinstance(v, float)] if isinstance(a, list) else [_number(a)])]


def _round(x, digits=0.0) -> float:
    scale = 10.0 ** int(_number(digits))
    return math.copysign(math.floor(abs(_number(x)) * scale + 0.5), _number(x)) / scale


def _matching(ranges: list, criteria: list) -> list[int]:
    if len({len(r) for r in ranges}) != 1:
        raise ValueError("ranges of different sizes")
    tests = [_criterion(c) for c in criteria]
    return [i for i in range(len(ranges[0])) if all(t(r[i]) for t, r in zip(tests, ranges))]


def _some(kept: list[int], values: list) -> list[float]:
    return [values[i] for i in kept if i < len(values) and isinstance(values[i], float)]


def _mean(xs: list[float]) -> float:
    if not xs:
        raise ZeroDivisionError
    return sum(xs) / len(xs)


def _lookup(key, table: _Range, column, near=True):
    rows = [table[i : i + table.width] for i in range(0, len(table), table.width)]
    k = int(_number(column)) - 1
    if not 0 <= k < table.width:
        raise ValueError("no such column")
    if not _truth(near):
        hits = [r for r in rows if r[0] is not None and type(r[0]) is type(key) and _compare("=", r[0], key)]
    else:
        hits = [r for r in rows if type(r[0]) is type(key) and _compare("<=", r[0], key)][::-1]
    if not hits:
        raise ValueError("not found")
    return hits[0][k]


# The functions that are known, by their names.
_FUNCTIONS: dict[str, Callable] = {
    "SUM": lambda *a: sum(_numbers(a)), "AVERAGE": lambda *a: _mean(_numbers(a)), "MIN": lambda *a: min(_numbers(a), default=0.0), "MAX": lambda *a: max(_numbers(a), default=0.0),
    "PRODUCT": lambda *a: math.prod(_numbers(a)), "COUNT": lambda *a: float(sum(isinstance(x, float) for x in _flat(a))), "COUNTA": lambda *a: float(sum(x is not None for x in _flat(a))),
    "COUNTBLANK": lambda r: float(sum(x is None or x == "" for x in r)), "COUNTIF": lambda r, c: float(len(_matching([r], [c]))), "COUNTIFS": lambda *a: float(len(_matching(a[::2], a[1::2]))),
    "SUMIF": lambda r, c, v=None: sum(_some(_matching([r], [c]), r if v is None else v)), "SUMIFS": lambda v, *a: sum(_some(_matching(a[::2], a[1::2]), v)), "AVERAGEIF": lambda r, c, v=None: _mean(_some(_matching([r], [c]), r if v is None else v)),
    "ROUND": _round, "ABS": lambda x: abs(_number(x)), "INT": lambda x: float(math.floor(_number(x))), "MOD": lambda x, y: _number(x) - _number(y) * math.floor(_number(x) / _number(y)), "SQRT": lambda x: math.sqrt(_number(x)), "POWER": lambda x, y: _number(x) ** _number(y),
    "AND": lambda *a: all(_truth(x) for x in _flat(a) if x is not None), "OR": lambda *a: any(_truth(x) for x in _flat(a) if x is not None), "NOT": lambda x: not _truth(x),
    "CONCATENATE": lambda *a: "".join(map(_text, a)), "CONCAT": lambda *a: "".join(map(_text, _flat(a))), "LEN": lambda x: float(len(_text(x))), "UPPER": lambda x: _upper(_text(x)), "LOWER": lambda x: _text(x).lower(), "TRIM": lambda x: " ".join(_text(x).split(" ")).strip() if "  " not in _text(x) else " ".join(p for p in _text(x).split(" ") if p),
    "LEFT": lambda x, n=1.0: _text(x)[: int(_number(n))], "RIGHT": lambda x, n=1.0: _text(x)[max(0, len(_text(x)) - int(_number(n))) :], "MID": lambda x, s, n: _text(x)[int(_number(s)) - 1 :][: int(_number(n))],
    "VLOOKUP": _lookup, "ISBLANK": lambda x: x is None, "ISNUMBER": lambda x: isinstance(x, float), "ISTEXT": lambda x: isinstance(x, str),
}

_REFUSED = (ValueError, KeyError, TypeError, IndexError, ZeroDivisionError, OverflowError, RecursionError)


class Values:
    """Values of a workbook's cells, each worked out once; a cell that needs itself is refused."""

    def __init__(self, sheets: list[Sheet]):
        self.book = {s.name.lower(): s for s in sheets}
        self.known: dict[tuple[str, tuple[int, int]], object] = {}
        self.open: set[tuple[str, tuple[int, int]]] = set()

    def of(self, sheet: Sheet, at: tuple[int, int]):
        cell = sheet.cells.get(at)
        if cell is None:
            return None
        if not cell.formula or cell.value:
            return float(cell.value) if cell.type == "number" and cell.value else cell.value == "true" if cell.type == "boolean" else cell.value
        key = sheet.name.lower(), at
        if key not in self.known:
            if key in self.open:
                raise ValueError("a cell needs itself")
            self.open.add(key)
            try:
                self.known[key] = _Formula(cell.formula.lstrip("="), sheet, self).value()
            except _REFUSED as e:
                self.known[key] = e
            finally:
                self.open.discard(key)
        found = self.known[key]
        if isinstance(found, Exception):
            raise ValueError(str(found))
        return found


class _Formula:
    def __init__(self, text: str, home: Sheet, values: Values):
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't read {text[at:]}")
            self.tokens.append(m.groups())
            at = m.end()
        self.at, self.home, self.values = 0, home, values

    def value(self):
        out = self._comparison()
        if self.at < len(self.tokens):
            raise ValueError("more than one expression")
        if isinstance(out, list):
            if len(out) != 1:
                raise ValueError("a range is no value")
            out = out[0]
        return 0.0 if out is None else out

    def _peek(self) -> str | None:
        return self.tokens[self.at][7] if self.at < len(self.tokens) else None

    def _take(self, *ops: str) -> str | None:
        if (op := self._peek()) in ops:
            self.at += 1
            return op
        return None

    def _comparison(self):
        out = self._joined()
        while op := self._take("=", "<>", "<", ">", "<=", ">="):
            out = _compare(op, out, self._joined())
        return out

    def _joined(self):
        out = self._sum()
        while self._take("&"):
            out = _text(out) + _text(self._sum())
        return out

    def _sum(self):
        out = self._product()
        while op := self._take("+", "-"):
            right = _number(self._product())
            out = _number(out) + (right if op == "+" else -right)
        return out

    def _product(self):
        out = self._power()
        while op := self._take("*", "/"):
            right = _number(self._power())
            out = _number(out) * right if op == "*" else _number(out) / right
        return out

    def _power(self):
        out = self._signed()
        while self._take("^"):
            out = _number(out) ** _number(self._signed())
        return out

    def _signed(self):
        # a sign binds closer than a power here
        if op := self._take("-", "+"):
            return -_number(self._signed()) if op == "-" else self._signed()
        out = self._atom()
        while self._take("%"):
            out = _number(out) / 100
        return out

    def _atom(self):
        number, sheet, ref, end, name, text, truth, op = self.tokens[self.at]
        self.at += 1
        if number is not None:
            return float(number)
        if text is not None:
            return text.replace('""', '"')
        if truth:
            return truth.upper() == "TRUE"
        if ref:
            found = self._range(sheet, ref, end)
            return found if end else found[0]
        if name:
            return self._call(name.upper())
        if op == "(":
            out = self._comparison()
            if not self._take(")"):
                raise ValueError("a bracket is open")
            return out
        raise ValueError(f"unexpected {op}")

    def _range(self, sheet: str | None, ref: str, end: str | None) -> _Range:
        home = self.values.book[sheet[:-1].strip("'").replace("''", "'").lower()] if sheet else self.home
        (r1, c1), (r2, c2) = parse_reference(ref), parse_reference(end or ref)
        (r1, r2), (c1, c2) = sorted((r1, r2)), sorted((c1, c2))
        # no more than the cells that are there are looked at, but for the shape
        out = _Range(self.values.of(home, (r, c)) for r in range(r1, r2 + 1) for c in range(c1, c2 + 1))
        out.width = c2 - c1 + 1
        return out

    def _call(self, name: str):
        if name == "IF":
            return self._if()
        args = []
        if not self._take(")"):
            while True:
                start = self.at
                try:
                    args.append(self._comparison())
                except _REFUSED:
                    if name != "IFERROR" or args:
                        raise
                    self.at = self._end(start)
                    self._take(",")
                    return self._last()
                if not self._take(","):
                    break
            if not self._take(")"):
                raise ValueError("a bracket is open")
        if name == "IFERROR":
            return args[0]
        if name not in _FUNCTIONS:
            raise ValueError(f"{name} isn't known")
        out = _FUNCTIONS[name](*args)
        return float(out) if isinstance(out, int) and not isinstance(out, bool) else out

    def _last(self):
        out = self._comparison()
        if not self._take(")"):
            raise ValueError("a bracket is open")
        return out

    def _end(self, at: int) -> int:
        """The place of the comma or bracket that ends the argument that begins there."""
        depth = 0
        while at < len(self.tokens):
            name, op = self.tokens[at][4], self.tokens[at][7]
            if not depth and op in (",", ")"):
                return at
            depth += bool(name) + (op == "(") - (op == ")")
            at += 1
        raise ValueError("a bracket is open")

    def _if(self):
        """Only the branch that is taken is worked out."""
        chosen = _truth(self._comparison())
        if not self._take(","):
            raise ValueError("IF needs a value")
        if chosen:
            out = self._comparison()
            self.at = self._end(self.at)
            if self._take(","):
                self.at = self._end(self.at)
        else:
            self.at = self._end(self.at)
            out = self._comparison() if self._take(",") else False
        if not self._take(")"):
            raise ValueError("a bracket is open")
        return out


def number_text(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def freeze(sheet: Sheet, values: Values, alone: bool = False) -> Sheet:
    """The sheet with values for formulas. A formula that is refused stays; on a sheet that is to be alone, #REF! takes its place if it names other sheets."""
    out = Sheet(sheet.name, dict(sheet.cells), sheet.hidden)
    for at, cell in sorted(sheet.cells.items()):
        if cell.formula:
            if cell.value:
                out.cells[at] = Cell(cell.type, cell.value)
                continue
            try:
                v = values.of(sheet, at)
            except _REFUSED:
                if alone and "!" in cell.formula:
                    out.cells[at] = Cell("string", "#REF!")
                continue
            out.cells[at] = Cell("boolean", str(v).lower()) if isinstance(v, bool) else Cell("number", number_text(v)) if isinstance(v, float) else Cell("string", str(v))
    return out


# --- writing ---------------------------------------------------------------------------------

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def _rows(sheet: Sheet) -> list[tuple[int, list[tuple[int, Cell]]]]:
    rows: dict[int, list[tuple[int, Cell]]] = {}
    for (r, c), cell in sorted(sheet.cells.items()):
        rows.setdefault(r, []).append((c, cell))
    return sorted(rows.items())


def write_xlsx(sheets: list[Sheet]) -> bytes:
    def cell(r: int, c: int, x: Cell) -> str:
        ref = f"{column_name(c)}{r + 1}"
        formula = f"<f>{escape(x.formula.lstrip('='))}</f>" if x.formula else ""
        if x.type == "string" and not formula:
            return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(x.value)}</t></is></c>'
        value = {"true": "1", "false": "0"}.get(x.value, x.value) if x.type == "boolean" else x.value
        return f'<c r="{ref}" t="{dict(boolean="b", number="n", string="str")[x.type]}">{formula}' + (f"<v>{escape(value)}</v>" if value else "") + "</c>"

    main, rel = _M[1:-1], _R[1:-1]
    parts = [
        ("[Content_Types].xml", _HEAD + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1)) + "</Types>"),
        ("_rels/.rels", _HEAD + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>'),
        ("xl/workbook.xml", _HEAD + f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(s.name)} sheetId="{i}"' + ' state="hidden"' * s.hidden + f' r:id="rId{i}"/>' for i, s in enumerate(sheets, 1)) + "</sheets></workbook>"),
        ("xl/_rels/workbook.xml.rels", _HEAD + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>"),
    ]
    for i, s in enumerate(sheets, 1):
        data = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, x) for c, x in cells) + "</row>" for r, cells in _rows(s))
        parts.append((f"xl/worksheets/sheet{i}.xml", _HEAD + f'<worksheet xmlns="{main}"><sheetData>{data}</sheetData></worksheet>'))
    return build_zip([(n, x.encode()) for n, x in parts])


def write_ods(sheets: list[Sheet]) -> bytes:
    def cell(x: Cell) -> str:
        formula = f" table:formula={quoteattr(x.formula)}" if x.formula else ""
        if x.type == "number":
            return f'<table:table-cell office:value-type="float" office:value={quoteattr(x.value)}{formula}><text:p>{escape(x.value)}</text:p></table:table-cell>'
        if x.type == "boolean":
            return f'<table:table-cell office:value-type="boolean" office:boolean-value={quoteattr(x.value)}><text:p>{x.value.upper()}</text:p></table:table-cell>'
        return f'<table:table-cell office:value-type="string"{formula}>' + "".join(f"<text:p>{escape(p)}</text:p>" for p in x.value.split("\n")) + "</table:table-cell>"

    body = ""
    for s in sheets:
        rows, last = "", -1
        for r, cells in _rows(s):
            if r > last + 1:
                rows += f'<table:table-row table:number-rows-repeated="{r - last - 1}"><table:table-cell/></table:table-row>'
            line, at = "", 0
            for c, x in cells:
                if c > at:
                    line += f'<table:table-cell table:number-columns-repeated="{c - at}"/>'
                line, at = line + cell(x), c + 1
            rows, last = rows + f"<table:table-row>{line}</table:table-row>", r
        body += f'<table:table table:name={quoteattr(s.name)}{" table:style-name=%shid%s" % (chr(34), chr(34)) if s.hidden else ""}>{rows}</table:table>'
    style = '<office:automatic-styles><style:style style:name="hid" style:family="table"><style:table-properties table:display="false"/></style:style></office:automatic-styles>'
    names = " ".join(f'xmlns:{k}="urn:oasis:names:tc:opendocument:xmlns:{k}:1.0"' for k in ("office", "table", "text", "style"))
    mime = SHORT["ods"]
    manifest = f'<manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="{mime}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'
    content = f'<office:document-content {names} office:version="1.2">{style}<office:body><office:spreadsheet>{body}</office:spreadsheet></office:body></office:document-content>'
    return build_zip([("mimetype", mime.encode()), ("META-INF/manifest.xml", (_HEAD + manifest).encode()), ("content.xml", (_HEAD + content).encode())])


# --- operators -------------------------------------------------------------------------------


def select_sheets(sheets: list[Sheet], names: tuple[str, ...] = (), exclude_hidden: bool = False) -> list[Sheet]:
    return [s for s in sheets if (not names or s.name in names) and not (exclude_hidden and s.hidden)]


def split_workbook(content: bytes, names: tuple[str, ...] = (), exclude_hidden: bool = False, evaluate_formulas: bool = True) -> list[Fragment]:
    """A workbook for each sheet left by the filters, numbered without gaps; parsed once. No sheet at all is an error."""
    sheets = read_workbook(content)
    if not sheets:
        raise ConversionError("Split", "the workbook has no sheets")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        ods = "content.xml" in z.namelist()
    values = Values(sheets)
    write, mime = (write_ods, SHORT["ods"]) if ods else (write_xlsx, SHORT["xlsx"])
    kept = select_sheets(sheets, names, exclude_hidden)
    return [(write([freeze(s, values, True) if evaluate_formulas and not ods else s]), mime, i, s.name) for i, s in enumerate(kept)]


def _first(content: bytes, names: tuple[str, ...] = (), evaluate_formulas: bool = True) -> Sheet:
    sheets = read_workbook(content)
    kept = select_sheets(sheets, names, True) or sheets
    return (freeze(kept[0], Values(sheets)) if evaluate_formulas else kept[0]) if kept else Sheet("")


def to_csv(content: bytes, names: tuple[str, ...] = (), evaluate_formulas: bool = True) -> str:
    """The first visible selected sheet; cells are quoted where they need it."""
    quote = lambda v: '"' + v.replace('"', '""') + '"' if re.search('[",\r\n]', v) else v
    return "\n".join(",".join(map(quote, row)) for row in _first(content, names, evaluate_formulas).grid())


def to_json(content: bytes, names: tuple[str, ...] = (), evaluate_formulas: bool = True) -> str:
    """An object for each row below the first, keyed by the first."""
    head, *rows = _first(content, names, evaluate_formulas).grid() or [[]]
    return json.dumps([dict(zip(head, r)) for r in rows], ensure_ascii=False, separators=(",", ":"))


def to_markdown(content: bytes, names: tuple[str, ...] = (), evaluate_formulas: bool = True) -> str:
    head, *rows = _first(content, names, evaluate_formulas).grid() or [[]]
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *map(line, rows)]) if head else ""


def to_html(content: bytes, names: tuple[str, ...] = (), evaluate_formulas: bool = True) -> str:
    """A table for each visible selected sheet."""
    sheets = read_workbook(content)
    values = Values(sheets)
    table = lambda s: f"<h2>{escape(s.name)}</h2><table>" + "".join("<tr>" + "".join(f"<td>{escape(v)}</td>" for v in row) + "</tr>" for row in (freeze(s, values) if evaluate_formulas else s).grid()) + "</table>"
    return "<html><body>" + "".join(table(s) for s in select_sheets(sheets, names, True)) + "</body></html>"


def to_text(content: bytes) -> str:
    sheets = read_workbook(content)
    values = Values(sheets)
    return "\n".join([s.name + "".join("\n\t" + "\t".join(r) for r in freeze(s, values).grid()) for s in sheets])


def from_csv(content: bytes, to: str = "xlsx") -> bytes:
    import csv

    sheet = Sheet("Sheet1")
    for r, row in enumerate(csv.reader(io.StringIO(content.decode("utf-8", "replace")))):
        for c, v in enumerate(row):
            if v:
                sheet.cells[r, c] = Cell("number" if re.fullmatch(r"-?\d{1,15}(\.\d+)?", v) else "string", v)
    return (write_xlsx if to == "xlsx" else write_ods)([sheet])


def page_setup(content: bytes, options: ConvertOptions) -> bytes:
    """An XLSX file with the options' orientation, paper and fit to one page on its selected sheets; other sheets are hidden. Other files are as before."""
    wanted = options.landscape is not None or options.paper_size or options.one_sheet_per_page or options.sheet_names
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if not wanted or "xl/workbook.xml" not in z.namelist():
            return content
        parts = [(n, z.read(n)) for n in z.namelist()]
    setup = "<pageSetup" + (f' paperSize="{PAPER_SIZES[options.paper_size]}"' if options.paper_size else "") + ("" if options.landscape is None else f' orientation="{"landscape" if options.landscape else "portrait"}"') + (' fitToWidth="1" fitToHeight="1"' if options.one_sheet_per_page else "") + "/>"
    # parts that may come after the page setup in a sheet
    later = r"(?=<(?:headerFooter|rowBreaks|colBreaks|customProperties|cellWatches|ignoredErrors|smartTags|drawing|legacyDrawing|legacyDrawingHF|picture|oleObjects|controls|webPublishItems|tableParts|extLst)\b|</worksheet>)"

    def sheet(xml: str) -> str:
        xml = re.sub(r"<pageSetup\b[^>]*/>", "", xml)
        xml = re.sub(later, setup, xml, count=1)
        if options.one_sheet_per_page:
            xml = re.sub(r"<sheetPr\b[^>]*?(?:/>|>.*?</sheetPr>)", "", xml, flags=re.S)
            xml = re.sub(r"(<worksheet\b[^>]*>)", r'\1<sheetPr><pageSetUpPr fitToPage="1"/></sheetPr>', xml, count=1)
        return xml

    def book(xml: str) -> str:
        if not options.sheet_names:
            return xml
        hide = lambda m: m[0] if any(quoteattr(n)[1:-1] == m[1] for n in options.sheet_names) or "state=" in m[0] else m[0].replace("<sheet ", '<sheet state="hidden" ')
        return re.sub(r'<sheet [^>]*name="([^"]*)"[^>]*/>', hide, xml)

    return build_zip([(n, sheet(x.decode()).encode() if n.startswith("xl/worksheets/sheet") else book(x.decode()).encode() if n == "xl/workbook.xml" else x) for n, x in parts])


def xlsx_to_ods(content: bytes) -> bytes:
    """Text, numbers and truth values are kept; a formula is written as its text."""
    sheets = read_workbook(content)
    plain = [Sheet(s.name, {at: Cell("string", x.formula) if x.formula else x for at, x in s.cells.items()}, s.hidden) for s in sheets]
    return write_ods(plain)


def ods_to_xlsx(content: bytes) -> bytes:
    return write_xlsx([Sheet(s.name, {at: Cell(x.type, x.value) for at, x in s.cells.items()}, s.hidden) for s in read_workbook(content)])


def cells_of(content: bytes) -> list[tuple]:
    return [(i, s.name, r, c, x.type, x.value, x.formula, s.hidden) for i, s in enumerate(read_workbook(content)) for (r, c), x in sorted(s.cells.items())]


def read_cells(df: DataFrame) -> DataFrame:
    """df(..., content) to a row for each cell."""
    return explode_documents(df, cells_of, CELL)


def split_workbooks(df: DataFrame, names: tuple[str, ...] = (), exclude_hidden: bool = False, evaluate_formulas: bool = True) -> DataFrame:
    return split_documents(df, lambda c: split_workbook(c, names, exclude_hidden, evaluate_formulas))


def convert_workbooks(df: DataFrame, target: str) -> DataFrame:
    how = {"csv": to_csv, "json": to_json, "markdown": to_markdown, "html": to_html, "text": to_text, "ods": xlsx_to_ods, "xlsx": ods_to_xlsx}
    return convert_documents(df, how[target])
