"""Python operators over document bytes: 1:1 conversions and 1:N splits as Arrow maps that keep errors as values."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docloom.functions.errors import STATUS
from docloom.schema import ERROR, FRAGMENT

#: Bytes of made rows that Python holds, as objects and then as Arrow arrays too, before it hands them on.
OUTPUT_BYTES = 1 << 20

#: (content, mime, index, label) of a fragment; an exception instead of content that can't be had
Fragment = tuple[bytes | Exception, str, int, str]


class ConversionError(Exception):
    """kind is one of the keys of functions.errors.STATUS."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def as_error(e: Exception, default: str) -> dict:
    kind = e.kind if isinstance(e, ConversionError) else default
    return {"type": kind, "message": str(e) or type(e).__name__, "details": None, "http_status": STATUS[kind]}


def _mapped(df: DataFrame, rows_of: Callable[[bytes | None], Iterable[tuple]], added: str) -> DataFrame:
    """The columns of df but content, and the added ones; rows_of gives their values for a document."""
    keep = [c for c in df.columns if c != "content"]
    taken = {f.name for f in StructType.fromDDL(added)} & set(keep)
    if taken:
        raise ValueError(f"rename {sorted(taken)} first: the operator adds columns of these names")
    kept = StructType([df.schema[c] for c in keep])
    schema = StructType(kept.fields + StructType.fromDDL(added).fields)
    arrow = to_arrow_schema(schema)

    def made(batch: pa.RecordBatch, source: list[int], values: list[tuple]) -> pa.RecordBatch:
        # arrays of the kept columns repeat for each row made of a document
        cols = [batch.column(k).take(pa.array(source, pa.int32())) for k in range(len(keep))]
        new = list(zip(*values)) or [()] * (len(arrow) - len(keep))
        return pa.RecordBatch.from_arrays(cols + [pa.array(v, f.type) for v, f in zip(new, list(arrow)[len(keep) :])], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, values, held = [], [], 0
            for i in range(batch.num_rows):
                for row in rows_of(batch.column(len(keep))[i].as_py()):
                    source.append(i)
                    values.append(row)
                    held += 64 + sum(len(v) for v in row if isinstance(v, bytes))
                    if held > OUTPUT_BYTES:
                        yield made(batch, source, values)
                        source, values, held = [], [], 0
            yield made(batch, source, values)

    return df.select(*keep, "content").mapInArrow(run, schema)


def split_documents(df: DataFrame, split: Callable[[bytes], list[Fragment]]) -> DataFrame:
    """df(..., content) to a row for each fragment: content, mime, index, label, total, error.

    A document that can't be split gives one row with an error and no fragment; an empty one none at all; a null
    content gives nothing. A fragment whose content can't be had is a row with an error; the others stay.
    """

    def rows(content):
        if content is None:
            return []
        try:
            found = split(content)
        except Exception as e:  # an error is a value of the row
            return [(None, None, None, None, None, as_error(e, "Split"))]
        return [(None, *f[1:], len(found), as_error(f[0], "Split")) if isinstance(f[0], Exception) else (*f, len(found), None) for f in found]

    return _mapped(df, rows, f"{FRAGMENT}, error {ERROR}")


def convert_documents(df: DataFrame, convert: Callable[[bytes], bytes | str], kind: str = "Render") -> DataFrame:
    """df(..., content) with result (binary) and error; null content stays null without an error."""

    def rows(content):
        if content is None:
            return [(None, None)]
        try:
            out = convert(content)
        except Exception as e:
            return [(None, as_error(e, kind))]
        return [(out.encode() if isinstance(out, str) else out, None)]

    return _mapped(df, rows, f"result binary, error {ERROR}")


def explode_documents(df: DataFrame, rows_of: Callable[[bytes], Iterable[tuple]], schema: str) -> DataFrame:
    """df(..., content) to the rows that rows_of finds in each document."""
    return _mapped(df, lambda c: [] if c is None else rows_of(c), schema)


def gather_fragments(df: DataFrame, keys: list[str], value: F.Column, order: str = "index") -> DataFrame:
    """keys and an array `parts` of values in order: the fragments of one document, which its archive holds together anyway."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda s: s["v"]).alias("parts"))
