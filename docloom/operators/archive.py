"""ZIP archives: entries to rows, rows to archives; TAR too."""

from __future__ import annotations

import io
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docloom.functions.mime import BY_EXTENSION, OCTET
from docloom.operators.base import ConversionError, Fragment, as_error, gather_fragments, split_documents
from docloom.schema import ERROR

EPOCH = (1980, 1, 1, 0, 0, 0)
#: An entry that would inflate to more is an error in its place.
MAX_ENTRY_BYTES = 1 << 30


def type_of_entry(name: str) -> str:
    """By what follows the last dot, dot or no dot."""
    return BY_EXTENSION.get(next((x for x in reversed(name.split(".")) if x), "").lower(), OCTET)


def mac_entry(name: str) -> bool:
    return "__MACOSX" in name or ".DS_Store" in name or name.startswith("._")


def split_zip(content: bytes, mode: str = "core") -> list[Fragment]:
    """Entries in archive order.

    core: base names, numbered without gaps, without what macOS adds; full: whole paths, numbers count directories too.
    """
    out: list[Fragment] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for place, info in enumerate(z.infolist()):
            if info.is_dir() or mode == "core" and mac_entry(info.filename):
                continue
            name = posixpath.basename(info.filename) if mode == "core" else info.filename
            large = info.file_size > MAX_ENTRY_BYTES
            out.append((ConversionError("Resource", f"{info.filename} inflates to {info.file_size} bytes") if large else z.read(info), type_of_entry(info.filename), len(out) if mode == "core" else place, name))
    return out


def split_tar(content: bytes) -> list[Fragment]:
    with tarfile.open(fileobj=io.BytesIO(content)) as t:
        files = [m for m in t if m.isfile() and not mac_entry(m.name)]
        return [(t.extractfile(m).read(), type_of_entry(m.name), i, posixpath.basename(m.name)) for i, m in enumerate(files)]


def build_zip(entries: list[tuple[str, bytes]]) -> bytes:
    """The same bytes for the same entries. An OpenDocument file's mimetype is stored, as readers look for it uncompressed."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(zipfile.ZipInfo(name, EPOCH), data, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return raw.getvalue()


def split_archives(df: DataFrame, mode: str = "core") -> DataFrame:
    """df(..., content) to fragments of its ZIP archives."""
    return split_documents(df, lambda c: split_zip(c, mode))


def zip_fragments(df: DataFrame, keys: list[str], filename: str = "filename", content: str = "content", order: str = "index") -> DataFrame:
    """keys, content, error: one ZIP archive of the fragments of each key, in order.

    An archive is one value, so its fragments meet in one task. A fragment without a name or content is left out.
    """
    named = df.where(F.col(filename).isNotNull() & F.col(content).isNotNull())
    gathered = gather_fragments(named, keys, F.struct(F.col(filename).alias("name"), F.col(content).alias("data")), order).select(*keys, "parts")
    schema = StructType([gathered.schema[k] for k in keys] + StructType.fromDDL(f"content binary, error {ERROR}").fields)
    arrow = to_arrow_schema(schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # an archive at a time
                try:
                    made, fault = build_zip([(p["name"], p["data"]) for p in batch.column(len(keys))[at].as_py()]), None
                except (ValueError, zipfile.LargeZipFile) as e:
                    made, fault = None, as_error(e, "Render")
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, 1) for k in range(len(keys))), pa.array([made], pa.binary()), pa.array([fault], arrow.field("error").type)], schema=arrow)

    return gathered.mapInArrow(build, schema)
