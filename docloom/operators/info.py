"""Document information: sizes, fragment counts, metadata of office files and PDF."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, functions as F

from docloom.functions.mime import OCTET
from docloom.functions.text import first_of, format_size
from docloom.operators.base import explode_documents

# Where each piece of information is looked for.
KEYS = {"title": ("dc:title", "title"), "author": ("dc:creator", "Author"), "created": ("dcterms:created", "Creation-Date"), "modified": ("dcterms:modified", "Last-Modified"), "page_count": ("xmpTPg:NPages", "Page-Count"), "word_count": ("meta:word-count", "Word-Count")}


# Parts of office files that hold properties, and what the properties are called here.
OFFICE_PARTS = ("docProps/core.xml", "docProps/app.xml", "meta.xml")
_PROPERTIES = {"title": "dc:title", "creator": "dc:creator", "created": "dcterms:created", "modified": "dcterms:modified", "Pages": "xmpTPg:NPages", "Slides": "xmpTPg:NPages", "Words": "meta:word-count"}


def office_properties(part: bytes, found: dict[str, list[str]]) -> None:
    """Adds the properties of one part."""
    for e in ET.fromstring(part).iter():
        key = _PROPERTIES.get(e.tag.rpartition("}")[2])
        if key and e.text:
            found.setdefault(key, []).append(e.text)


def metadata_of(content: bytes, mime: str = OCTET) -> dict[str, list[str]]:
    """Properties of a document, many-valued; only its size and type if it can't be read, none for an empty one."""
    if not content:
        return {}
    out = {"fileSize": [str(len(content))], "detectedType": [mime]}
    try:
        if content.startswith(b"PK"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for part in OFFICE_PARTS:
                    if part in z.namelist():
                        office_properties(z.read(part), out)
        elif content.startswith(b"%PDF-"):
            from docloom.operators.pdf import Pdf

            out["xmpTPg:NPages"] = [str(len(Pdf(content).pages()))]
            for key, name in ((b"Title", "dc:title"), (b"Author", "dc:creator"), (b"CreationDate", "dcterms:created"), (b"ModDate", "dcterms:modified")):
                if m := re.search(rb"/" + key + rb"\s*\(((?:[^()\\]|\\.)*)\)", content):
                    out[name] = [m[1].decode("latin-1")]
    except Exception:  # what can't be read has no metadata
        return {k: out[k] for k in ("fileSize", "detectedType")}
    return out


def extract_metadata(df: DataFrame, mime: str = OCTET) -> DataFrame:
    """df(..., content) with raw_metadata."""
    return explode_documents(df, lambda c: [(list(metadata_of(c, mime).items()),)], "raw_metadata map<string, array<string>>")


def info_columns(raw) -> dict[str, F.Column]:
    """title, author, created, modified, page_count, word_count of a metadata map; counts that aren't numbers are 0."""
    joined = {name: F.array_join(first_of(raw, *keys), ", ") for name, keys in KEYS.items()}
    return {n: F.coalesce(c.try_cast("int"), F.lit(0)) if n.endswith("count") else c for n, c in joined.items()}


def with_fragment_counts(documents: DataFrame, fragments: DataFrame, key: str = "doc_id", size: str = "size") -> DataFrame:
    """documents with size_text and fragment_count: null for a document without fragments."""
    counts = fragments.groupBy(key).agg(F.count("*").alias("fragment_count"))
    return documents.join(counts, key, "left").withColumn("size_text", format_size(F.col(size)))
