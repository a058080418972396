"""Requests as rows: the service's convert, split and info calls over a table of requests.

A request has request_id, body, content_type, target (convert), backend and detect. The guards come in the order of the
service: empty body 400, target 400, backend 400, backend not there 503, no route 415, then the work itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docloom.functions.errors import error
from docloom.functions.mime import OCTET, detect_request, target_shorthand
from docloom.functions.options import PAPER_SIZES, ConvertOptions
from docloom.operators.base import as_error
from docloom.plans import registry
from docloom.schema import ERROR

VERSION = "0.1.0"


def parse_backend(b) -> Column:
    """The backend's name in lower case if it is one, null if none is given, else an empty string."""
    low = F.lower(F.trim(b))
    return F.when(b.isNull() | (low == ""), F.lit(None)).when(low.isin(*registry.BACKENDS), low).otherwise("")


def parse_options(params: dict[str, Column]) -> dict[str, Column]:
    """Option columns from request parameters: unknown paper sizes are dropped, sheet names are split at commas."""
    out = dict(params)
    if "sheet" in out:
        out["sheet_names"] = F.filter(F.transform(F.split(out.pop("sheet"), ","), lambda s: F.trim(s)), lambda s: s != "")
    if "paper_size" in out:
        size = out["paper_size"]
        out["paper_size"] = F.coalesce(*(F.when(F.lower(size) == p.lower(), F.lit(p)) for p in PAPER_SIZES))
    for name in ("one_sheet_per_page", "exclude_hidden", "strip_masters", "remove_watermarks", "remove_watermarks_aggressive", "landscape", "evaluate_formulas", "flowing_layout", "embed_resources"):
        if name in out:
            out[name] = F.lower(out[name]) == "true"
    return out


#: Request parameters that are options, and the option each sets.
PARAMETERS = {"password": "password", "sheet": "sheet_names", "paper_size": "paper_size"} | {f.name: f.name for f in fields(ConvertOptions) if f.name not in ("password", "sheet_names", "paper_size")}


def option_struct(requests: DataFrame) -> Column:
    """The options of a request from its columns of parameters; a parameter that is absent or null is at its default."""
    given = parse_options({p: F.col(p).cast("string") for p in PARAMETERS if p in requests.columns})
    return F.struct(*[c.alias(n) for n, c in given.items()]) if given else F.lit(None).cast("struct<none: boolean>")


def options_of(given: dict | None) -> ConvertOptions:
    found = {k: tuple(v) if k == "sheet_names" else v for k, v in (given or {}).items() if v is not None and k != "none"}
    found["remove_watermarks"] = found.get("remove_watermarks", False) or found.get("remove_watermarks_aggressive", False)
    return ConvertOptions(**found)


def _typed(requests: DataFrame) -> DataFrame:
    source = detect_request(F.col("content_type"), F.col("body"), F.coalesce(F.col("detect") == "content", F.lit(False)))
    return requests.withColumns({"source": source, "backend_name": parse_backend(F.col("backend"))})


def _guard(spark: SparkSession, df: DataFrame, relation: DataFrame, on: list[str], office: bool) -> DataFrame:
    """df with `fault`: the first guard that a request fails. relation: the routes or splits that there are."""
    known = relation.select("backend", *on).distinct()
    named = known.withColumnRenamed("backend", "backend_name").withColumn("by_name", F.lit(True))
    anyone = known.where(F.lit(office) | (F.col("backend") != "office")).select(*on).distinct().withColumn("by_any", F.lit(True))
    joined = df.join(F.broadcast(named), ["backend_name", *on], "left").join(F.broadcast(anyone), on, "left")
    can = F.when(F.col("backend_name").isNull(), F.col("by_any")).otherwise(F.col("by_name"))
    fault = (
        F.when(F.coalesce(F.length("body"), F.lit(0)) == 0, error("Parse", F.lit("empty body")))
        .when(F.col("target").isNull() | (F.trim("target") == ""), error("Parse", F.lit("no target")))
        .when(F.col("backend_name") == "", error("Parse", F.concat(F.lit("unknown backend "), "backend")))
        .when((F.col("backend_name") == "office") & ~F.lit(office), error("Resource", F.lit("no office process")))
        .when(can.isNull(), error("UnsupportedConversion", F.concat_ws(" to ", *(F.col(c) for c in on))))
    )
    return joined.withColumn("fault", fault).drop("by_name", "by_any")


def _apply(df: DataFrame, added: str, work) -> DataFrame:
    """request_id and the added columns; work(source, target, backend, options) gives a function of the body to rows."""
    kept = df.select("request_id", "source", F.col("target_mime"), "backend_name", "fault", option_struct(df).alias("options"), "body")
    schema = StructType(kept.select("request_id").schema.fields + StructType.fromDDL(f"{added}, error {ERROR}").fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, source, target, backend, fault, options, body in zip(*(c.to_pylist() for c in batch.columns)):
                if fault is not None:
                    out.append((rid, *[None] * (len(arrow) - 2), fault))
                    continue
                try:
                    out += [(rid, *row, None) for row in work(source, target, backend, options_of(options))(body)]
                except Exception as e:
                    out.append((rid, *[None] * (len(arrow) - 2), as_error(e, "Render")))
            cols = list(zip(*out)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return kept.mapInArrow(run, schema)


def convert_requests(spark: SparkSession, requests: DataFrame, office: bool = False, products: Sequence[str] | None = None) -> DataFrame:
    """request_id, status, content_type, content_length, body of the responses. Columns named as options (password, sheet, ...) are theirs."""
    from docloom.operators.convert import _SHORT_OF, converters, first_success

    typed = _typed(requests).withColumn("target_mime", target_shorthand(F.col("target")))
    relation = registry.routes(spark).withColumnRenamed("target", "target_mime")
    guarded = _guard(spark, typed, relation, ["source", "target_mime"], office)

    def work(source, target, backend, options):
        def run(body):
            s, t = _SHORT_OF.get(source, source), _SHORT_OF.get(target, target)
            out = first_success(converters(s, t, backend, options, products))(body)
            return [(target, out.encode() if isinstance(out, str) else out)]

        return run

    return _responses(_apply(guarded, "content_type string, body binary", work))


def split_requests(spark: SparkSession, requests: DataFrame, office: bool = False, products: Sequence[str] | None = None) -> DataFrame:
    """request_id, status, content_type, content_length, body: a ZIP archive of the fragments for each request."""
    from docloom.operators.archive import build_zip
    from docloom.operators.convert import _SHORT_OF, first_success, splitters

    typed = _typed(requests.withColumn("target", F.lit("zip"))).withColumn("target_mime", F.lit("application/zip"))
    guarded = _guard(spark, typed, registry.splits(spark), ["source"], office)

    def work(source, _, backend, options):
        from docloom.functions.mime import EXTENSION_OF

        def run(body):
            found = first_success(splitters(_SHORT_OF.get(source, source), backend, options, products))(body)
            for f in found:
                if isinstance(f[0], Exception):
                    raise f[0]
            width = len(str(max(1, len(found))))
            clean = str.maketrans({c: "_" for c in '\\/:*?"<>|'})
            entries = [(f"{i:0{width}d}__{(f[3] or f'fragment_{i}').translate(clean)[:200]}.{EXTENSION_OF.get(f[1], 'bin')}", f[0]) for i, f in enumerate(found, 1)]
            return [("application/zip", build_zip(entries))]

        return run

    return _responses(_apply(guarded, "content_type string, body binary", work))


def _responses(df: DataFrame) -> DataFrame:
    bad = F.encode(F.to_json(F.struct(F.col("error.type").alias("error"), F.col("error.message").alias("message"))), "UTF-8")
    body = F.when(F.col("error").isNull(), F.col("body")).otherwise(bad)
    status = F.when(F.col("error").isNull(), 200).otherwise(F.col("error.http_status"))
    kind = F.when(F.col("error").isNull(), F.coalesce("content_type", F.lit(OCTET))).otherwise("application/json")
    return df.select("request_id", status.alias("status"), kind.alias("content_type"), F.length(body).cast("long").alias("content_length"), body.alias("body"))


def info_requests(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """request_id, json: type, size, metadata, whether and into how many it splits, and what it converts to.

    The body is read once, where it lies: size, metadata and count come from one map, and only they go on.
    """
    from docloom.operators.convert import _SHORT_OF, first_success, splitters
    from docloom.operators.info import metadata_of

    typed = _typed(requests.withColumn("target", F.lit("info")))
    divisible = registry.splits(spark, ("commercial", "core")).select("source").distinct().withColumn("can_split", F.lit(True))
    marked = typed.join(F.broadcast(divisible), "source", "left").withColumn("fault", F.lit(None).cast(ERROR)).withColumn("target_mime", F.col("can_split").cast("string"))

    def work(source, divided, backend, options):
        def run(body):
            body = body or b""
            meta = [(k, v) for k, v in metadata_of(body, source).items() if k not in ("fileSize", "detectedType")]
            try:
                n = len(first_success(splitters(_SHORT_OF.get(source, source)))(body)) if divided else None
            except Exception:  # information is given of what can't be split too, without a count
                n = None
            return [(source, len(body), meta, divided is not None, n)]

        return run

    measured = _apply(marked, "mime string, size long, metadata map<string, array<string>>, can_split boolean, fragment_count int", work)
    targets = registry.available_targets(measured, spark, registry.SERVER_TARGETS, keep_self=True)
    out = F.struct(
        F.col("mime"), F.col("size"), F.when(F.size("metadata") > 0, F.col("metadata")).alias("metadata"), F.col("can_split").alias("canSplit"), F.col("fragment_count").alias("fragmentCount"),
        F.when(F.col("targets") == "", F.expr("CAST(array() AS array<string>)")).otherwise(F.split("targets", ",")).alias("availableConversions"),
    )
    return targets.select("request_id", F.to_json(out).alias("json"))


def health(spark: SparkSession, office: bool = False) -> DataFrame:
    """One row: status, version, and which backends answer."""
    return spark.createDataFrame([("healthy", VERSION, office)], "status string, version string, office boolean")


def capabilities_json(spark: SparkSession) -> DataFrame:
    """One row: the capability report as JSON. The lists have at most 24 x 18 entries."""
    divided = {registry.mime(s) for names in registry._SPLITS.values() for s in names.split()} & {registry.mime(s) for s in registry.REPORT_TYPES}
    found = registry.capability_matrix(spark).groupBy().agg(
        F.array_sort(F.collect_list(F.struct(F.col("source").alias("from"), F.col("target").alias("to")))).alias("conversions"),
        F.array_sort(F.array_union(F.collect_set("source"), F.array(*map(F.lit, sorted(divided))))).alias("inputTypes"),
        F.array_sort(F.collect_set("target")).alias("outputTypes"),
    )
    return found.select(F.to_json(F.struct("conversions", "inputTypes", "outputTypes")).alias("json"))


def server_config(given: dict[str, str], environment: dict[str, str]) -> dict[str, object]:
    """Settings: arguments first, then the environment, then defaults."""
    # Settings, their variables and defaults.
    settings = {"host": ("HOST", "0.0.0.0"), "port": ("PORT", 8080), "max_request_bytes": ("MAX_REQUEST_SIZE", 104857600), "office_processes": ("OFFICE_INSTANCES", 1), "tasks_per_process": ("OFFICE_RESTART_AFTER", 200), "task_timeout_ms": ("OFFICE_TASK_TIMEOUT", 120000), "queue_timeout_ms": ("OFFICE_QUEUE_TIMEOUT", 30000)}
    out: dict[str, object] = {}
    for name, (variable, default) in settings.items():
        value = given.get(name, environment.get(variable))
        out[name] = default if value is None else type(default)(value)
    return out

