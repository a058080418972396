"""Text expressions: trimming, markup removal and writing, sizes, metadata."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CONTROL_ENDS = r"^[\x00-\x20]+|[\x00-\x20]+$"


def trim_controls(s) -> Column:
    """Without leading and trailing characters up to U+0020; other white space stays."""
    return F.regexp_replace(s, CONTROL_ENDS, "")


def decode_utf8(content) -> Column:
    """Malformed bytes become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def html_to_text(html) -> Column:
    """Script, style and head blocks, comments and tags go; five character references are decoded; white space is one space."""
    out = html
    for name in ("script", "style", "head"):
        out = F.regexp_replace(out, rf"(?is)<{name}[^>]*>.*?</{name}>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", " ")
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(c))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f]+", " "))


def escape_xml(s) -> Column:
    out = s
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(c), F.lit(name))
    return out


def escape_json(s) -> Column:
    out = s
    for c, name in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(c), F.lit(name))
    return out


def text_to_xml(s) -> Column:
    """An XHTML document with the escaped text in one paragraph."""
    return F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml"><head><title></title></head><body><p>'), escape_xml(s), F.lit("</p></body></html>"))


def format_size(n) -> Column:
    def scaled(unit: int, name: str) -> Column:
        return F.format_string(f"%.1f {name}", F.round(n / F.lit(float(unit)), 1))

    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, scaled(1 << 10, "KB")).when(n < 1 << 30, scaled(1 << 20, "MB")).otherwise(scaled(1 << 30, "GB"))


def with_metadata(m, key: str, value) -> Column:
    """The map with the key set, whether it was there or not."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), value))


def without_metadata(m, key: str) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def merge_metadata(a, b) -> Column:
    """Entries of both; those of b win."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def metadata_text(m) -> Column:
    """key=value entries by key, joined by semicolons."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def first_of(m, *keys: str) -> Column:
    """The value of the first key that the map has."""
    return F.coalesce(*(F.try_element_at(m, F.lit(k)) for k in keys))
