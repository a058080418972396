"""Row schemas: a document is a row, a split makes rows, an error is a value."""

from __future__ import annotations

DOCUMENT = "doc_id long, path string, content binary, mime string, metadata map<string,string>"
ERROR = "struct<type: string, message: string, details: string, http_status: int>"
FRAGMENT = "content binary, mime string, index int, label string, total int"
CELL = "sheet_index int, sheet_name string, row int, col int, type string, value string, formula string, hidden boolean"
