"""Documents of many types in one plan: each row takes its own route.

The registry's routes are a small fixed relation that rows are joined with by their type, which gives each its backends in order. Routes that are column
expressions (equal types, CSV to HTML) stay in the JVM; the others pass Python once, in one Arrow map that looks each row's converter up. Rows without a route are answered where they are. Those that pass Python are first rebalanced by their bytes, as
a converter's work grows with the document, so that a task gets neither all large ones nor all of one slow type.

Defined cases: a null content stays null without an error; a null or unknown source type is that of bytes, which only core's text and XML take;
a source that equals the target passes through; parameters and letter case of a type don't count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docloom.functions import errors, mime as M
from docloom.functions.options import ConvertOptions
from docloom.operators.base import OUTPUT_BYTES, Fragment, as_error
from docloom.operators.deadline import Guarded
from docloom.operators.convert import _SHORT_OF, converter, first_success, splitter
from docloom.operators.text_split import csv_to_html
from docloom.plans.registry import BACKENDS, licensed, routes, splits
from docloom.schema import ERROR, FRAGMENT


def _type(column: str) -> Column:
    """The type without parameters, in lower case; that of bytes if there is none."""
    return F.coalesce(M.parse(F.col(column)), F.lit(M.OCTET))


def with_routes(df: DataFrame, source: str = "mime", target: str = "target", backend: str | None = None, products: Sequence[str] | None = None) -> DataFrame:
    """df with `backends`: those that have the row's route, in the order they are tried; null if none has it."""
    found = routes(df.sparkSession, (backend,) if backend else BACKENDS)
    if products is not None:
        found = licensed(found, list(products))
    # some hundreds of rows, fixed
    per = found.groupBy(F.col("source").alias("__s"), F.col("target").alias("__t")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "backend"))), lambda b: b["backend"]).alias("backends"))
    return df.join(F.broadcast(per), (_type(source) == F.col("__s")) & (_type(target) == F.col("__t")), "left").drop("__s", "__t")


def _columns(content: Column, source: Column, target: Column) -> list[tuple[Column, Column]]:
    """(condition, result) of the routes that are expressions."""
    table = (source == M.SHORT["csv"]) & (target == M.SHORT["html"]) & F.is_valid_utf8(content.cast("string"))
    return [(source == target, content), (table, F.encode(csv_to_html(F.decode(content, "UTF-8")), "UTF-8"))]


def _guarded(work: Callable, seconds: float | None) -> Callable:
    return Guarded(work, seconds) if seconds else work


@lru_cache(maxsize=64)
def _converter(source: str, target: str, backends: tuple[str, ...], options: ConvertOptions, seconds: float | None) -> Callable[[bytes], bytes | str]:
    s, t = _SHORT_OF.get(source, "bin"), _SHORT_OF.get(target, target)
    return _guarded(first_success([converter(b, s, t, options) for b in backends]), seconds)


@lru_cache(maxsize=64)
def _splitter(source: str, backends: tuple[str, ...], options: ConvertOptions, seconds: float | None) -> Callable[[bytes], list[Fragment]]:
    return _guarded(first_success([splitter(b, _SHORT_OF.get(source, "bin"), options) for b in backends]), seconds)


def _by_row(df: DataFrame, inputs: Sequence[str], rows_of: Callable[..., list[tuple]], added: str) -> DataFrame:
    """df without `inputs` and with the added columns; rows_of(*values of inputs) gives their values, for each row as many times as it likes."""
    keep = [c for c in df.columns if c not in inputs]
    schema = StructType([df.schema[c] for c in keep] + StructType.fromDDL(added).fields)
    arrow = to_arrow_schema(schema)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source: list[int] = []
            values: list[tuple] = []
            held = 0

            def made() -> pa.RecordBatch:
                kept = [batch.column(k).take(pa.array(source, pa.int32())) for k in range(n)]
                new = list(zip(*values)) or [()] * (len(arrow) - n)
                return pa.RecordBatch.from_arrays(kept + [pa.array(v, f.type) for v, f in zip(new, list(arrow)[n:])], schema=arrow)

            for i in range(batch.num_rows):
                for row in rows_of(*(batch.column(n + k)[i].as_py() for k in range(len(inputs)))):
                    source.append(i)
                    values.append(row)
                    held += 64 + sum(len(v) for v in row if isinstance(v, bytes))
                    if held > OUTPUT_BYTES:
                        yield made()
                        source, values, held = [], [], 0
            yield made()

    return df.select(*keep, *inputs).mapInArrow(run, schema)


def convert_mixed(df: DataFrame, target: str | None = None, backend: str | None = None, options: ConvertOptions = ConvertOptions(), products: Sequence[str] | None = None, seconds: float | None = None) -> DataFrame:
    """df(..., content, mime[, target]) with result and error, each row by the route from its type to its target, or to one target for all.

    seconds: a row that takes longer is a Timeout error, whatever its converter does; null: none is stopped.
    """
    clash = {"result", "error", "backends", "__own", "__to"} & set(df.columns)
    if clash:
        raise ValueError(f"rename {sorted(clash)} first: the operator adds columns of these names")
    rows = df.withColumn("__to", F.lit(M.SHORT.get(target, target)) if target else F.col("target"))
    watermarks = options.remove_watermarks or options.remove_watermarks_aggressive
    routed = with_routes(rows, "mime", "__to", backend, products)
    kept = [c for c in df.columns if c != "content"]
    source, to, content = _type("mime"), _type("__to"), F.col("content")
    cases = [((c & (source != M.SHORT["pdf"])) if watermarks and k == 0 else c, r) for k, (c, r) in enumerate(_columns(content, source, to))]
    own = F.lit(False)
    for c, _ in cases:
        own = own | F.coalesce(c, F.lit(False))
    own = own | content.isNull()
    marked = routed.withColumn("__own", F.when(own, "column").when(F.col("backends").isNull(), "none").otherwise("python"))
    result = F.lit(None).cast("binary")
    for c, r in reversed(cases):
        result = F.when(c, r).otherwise(result)
    no_error = F.lit(None).cast(ERROR)
    columns = marked.where("__own = 'column'").select(*kept, result.alias("result"), no_error.alias("error"))
    none = marked.where("__own = 'none'").select(*kept, F.lit(None).cast("binary").alias("result"), errors.unsupported(source, to).alias("error"))

    def convert(content: bytes, mime: str, goal: str, backends: list[str]) -> list[tuple]:
        try:
            out = _converter(mime, goal, tuple(backends), options, seconds)(content)
        except Exception as e:  # an error is a value of the row
            return [(None, as_error(e, "Render"))]
        return [(out.encode() if isinstance(out, str) else out, None)]

    python = marked.where("__own = 'python'").select(*kept, source.alias("__mime"), to.alias("__goal"), "backends", "content").hint("rebalance")
    python = _by_row(python, ["content", "__mime", "__goal", "backends"], convert, f"result binary, error {ERROR}")
    return columns.unionByName(none).unionByName(python)


def split_mixed(df: DataFrame, backend: str | None = None, options: ConvertOptions = ConvertOptions(), products: Sequence[str] | None = None, seconds: float | None = None) -> DataFrame:
    """df(..., content, mime) to fragments, each row by the splitters of its type; a type without one is an UnsupportedConversion error."""
    names = {"index", "label", "total", "error", "backends"} & set(df.columns)
    if names:
        raise ValueError(f"rename {sorted(names)} first: the operator adds columns of these names")
    found = splits(df.sparkSession, (backend,) if backend else BACKENDS)
    if products is not None:
        found = licensed(found, list(products))
    per = found.groupBy(F.col("source").alias("__s")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "backend"))), lambda b: b["backend"]).alias("backends"))
    kept = [c for c in df.columns if c not in ("content", "mime")]
    source = _type("mime")
    routed = df.where(F.col("content").isNotNull()).join(F.broadcast(per), source == F.col("__s"), "left")
    fault = errors.error("UnsupportedConversion", F.concat(F.lit("No splitter for "), source))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("content", "binary"), ("mime", "string"), ("index", "int"), ("label", "string"), ("total", "int"))]
    none = routed.where("backends IS NULL").select(*kept, *nothing, fault.alias("error"))

    def split(content: bytes, mime: str, backends: list[str]) -> list[tuple]:
        try:
            parts = _splitter(mime, tuple(backends), options, seconds)(content)
        except Exception as e:
            return [(None, None, None, None, None, as_error(e, "Split"))]
        return [(None, *p[1:], len(parts), as_error(p[0], "Split")) if isinstance(p[0], Exception) else (*p, len(parts), None) for p in parts]

    python = routed.where("backends IS NOT NULL").select(*kept, source.alias("__mime"), "backends", F.col("content").alias("__content")).hint("rebalance")
    return _by_row(python, ["__content", "__mime", "backends"], split, f"{FRAGMENT}, error {ERROR}").select(*kept, "content", "mime", "index", "label", "total", "error").unionByName(none)
