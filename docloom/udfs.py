"""Conversion and splitting for SQL: register(spark) adds doc_convert, doc_text, doc_split and doc_split_table."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udf, udtf
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from docloom.functions.mime import SHORT
from docloom.operators.base import Fragment, as_error
from docloom.operators.convert import _SHORT_OF, converter, first_success, splitter
from docloom.plans.registry import BACKENDS
from docloom.schema import FRAGMENT


def _short(mime: str) -> str:
    plain = mime.split(";")[0].strip().lower()
    return _SHORT_OF.get(SHORT.get(plain, plain), plain)


@lru_cache(maxsize=512)
def _converter_of(source: str, target: str) -> Callable[[bytes], bytes | str]:
    return first_success([converter(b, source, target) for b in BACKENDS])


@lru_cache(maxsize=128)
def _splitter_of(source: str) -> Callable[[bytes], list[Fragment]]:
    return first_success([splitter(b, source) for b in BACKENDS])


def convert_bytes(content: bytes | None, source: str, target: str) -> bytes | None:
    """The same bytes for equal types, else by the first backend that can."""
    if content is None:
        return None
    if _short(source) == _short(target):
        return bytes(content)
    out = _converter_of(_short(source), _short(target))(bytes(content))
    return out.encode() if isinstance(out, str) else out


def extract_text(content: bytes | None, source: str, target: str = "text/plain") -> str | None:
    out = convert_bytes(content, source, target)
    return None if out is None else out.decode("utf-8", "replace")


@udtf(returnType=FRAGMENT, useArrow=True)
class SplitBytes:
    """(content, mime) to rows of content, mime, index, label, total."""

    def eval(self, content: bytes, source: str):
        if content is not None:
            found = _splitter_of(_short(source))(bytes(content))
            for data, mime, index, label in found:
                yield data, mime, index, label or f"part-{index + 1}", len(found)


@udtf(useArrow=True)
class SplitTable:
    """A table with content and mime to its other columns and each fragment's content, mime, index, label, total, error.

    Rows may be of any types; a null content has no rows, a type without a splitter an UnsupportedConversion error.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or not {"content", "mime"} <= set(table.dataType.fieldNames()):
            raise Exception("doc_split_table takes a table with the columns content and mime")  # noqa: TRY002  (what Spark shows to the user)
        fault = StructType([StructField("type", StringType()), StructField("message", StringType()), StructField("details", StringType()), StructField("http_status", IntegerType())])
        names = [("content", BinaryType()), ("mime", StringType()), ("index", IntegerType()), ("label", StringType()), ("total", IntegerType()), ("error", fault)]
        added = StructType([StructField(n, t) for n, t in names])  # there is no session here to parse DDL
        kept = [f for f in table.dataType.fields if f.name not in ("content", "mime")]
        if clash := {f.name for f in kept} & set(added.fieldNames()):
            raise Exception(f"rename {sorted(clash)} first: doc_split_table adds columns of these names")  # noqa: TRY002
        return AnalyzeResult(StructType(kept + added.fields))

    def eval(self, row: Row):
        content, mime = row["content"], row["mime"]
        if content is None:
            return
        kept = [row[c] for c in row.__fields__ if c not in ("content", "mime")]
        try:
            found = _splitter_of(_short(mime or "bin"))(bytes(content))
        except Exception as e:  # an error is a value of the row
            yield (*kept, None, None, None, None, None, as_error(e, "Split"))
            return
        for data, kind, index, label in found:
            fault = as_error(data, "Split") if isinstance(data, Exception) else None
            yield (*kept, None if fault else data, kind, index, label, len(found), fault)


def register(spark: SparkSession) -> None:
    spark.udf.register("doc_convert", udf(convert_bytes, "binary", useArrow=True))
    spark.udf.register("doc_text", udf(extract_text, "string", useArrow=True))
    spark.udtf.register("doc_split", SplitBytes)
    spark.udtf.register("doc_split_table", SplitTable)
