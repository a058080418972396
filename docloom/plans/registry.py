"""Which backend converts and splits what: small relations, and queries over them.

Three backends: `commercial` (licensed products), `office` (an external office process) and `core` (always there).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.functions.mime import SHORT

BACKENDS = ("commercial", "office", "core")  # in the order they are tried

# Routes of the commercial backend, by source.
_COMMERCIAL = """
docx: pdf doc docm html plain markdown rtf png jpeg
doc: pdf docx docm html plain markdown
docm: docx doc html
rtf: pdf docx html
xlsx: pdf html xls xlsm xlsb ods csv json markdown
xls: pdf html xlsx csv
xlsm: pdf html xlsx csv
xlsb: pdf html xlsx csv
ods: pdf html xlsx csv
pptx: pdf html ppt png jpeg
ppt: pdf html pptx png jpeg
pptm: pptx ppt
html: pptx ppt pdf
pdf: html pdf pptx ppt png jpeg docx doc xlsx
png: pdf
jpeg: pdf
eml: pdf html msg
msg: pdf html eml
"""

# Routes of the office backend, by source.
_OFFICE = """
docx: pdf html png jpeg doc odt
doc: pdf html png jpeg docx
docm: pdf docx doc
xlsx: pdf xls ods
xls: pdf xlsx ods
xlsm: pdf xlsx
xlsb: pdf xlsx
ods: pdf xlsx xls
pptx: pdf png jpeg ppt odp
ppt: pdf png jpeg pptx odp
pptm: pdf pptx ppt
odt: pdf html docx rtf
odp: pdf pptx ppt
odg: pdf svg png
rtf: pdf html docx
csv: pdf xlsx ods html
html: pdf docx odt
"""

# What can be split, by backend; the types and targets that reports go over.
_SPLITS = {
    "commercial": "xlsx xls xlsm xlsb ods pptx ppt pdf docx doc zip 7z eml msg",
    "core": "xlsx xls ods pptx docx pdf plain csv eml msg zip",
}
REPORT_TYPES = "plain html markdown csv tsv xml json pdf rtf doc xls ppt docx xlsx pptx xlsm xlsb odt ods odp eml msg zip 7z".split()
REPORT_TARGETS = "plain html xml pdf docx xlsx pptx ods odt odp png jpeg csv json markdown rtf eml msg".split()
CLI_TARGETS = "pdf html plain csv json docx xlsx pptx odt ods odp png jpeg".split()
SERVER_TARGETS = "plain html xml pdf docx xlsx pptx ods odt odp png jpeg csv".split()


def _pairs(text: str) -> list[tuple[str, str]]:
    return [(a, b) for line in text.strip().splitlines() for a, _, rest in [line.partition(":")] for b in rest.split()]


COMMERCIAL, OFFICE = _pairs(_COMMERCIAL), _pairs(_OFFICE)


def products_for(source: str, target: str) -> list[str]:
    """Licensed products that a commercial route needs."""
    if source in ("eml", "msg"):
        return ["email"] if target in ("eml", "msg") else ["email", "words"]
    if source in ("pptx", "ppt", "pptm") or target in ("pptx", "ppt"):
        return ["slides"]
    if source in ("docx", "doc", "docm", "rtf"):
        return ["words"]
    if source in ("xlsx", "xls", "xlsm", "xlsb", "ods"):
        return ["cells"]
    return ["pdf"]


def product_for_split(source: str) -> str:
    return {"pptx": "slides", "ppt": "slides", "pdf": "pdf", "docx": "words", "doc": "words", "zip": "zip", "7z": "zip", "eml": "email", "msg": "email"}.get(source, "cells")


def mime(short: str) -> str:
    return SHORT[short]


def routes(spark: SparkSession, backends: tuple[str, ...] = BACKENDS) -> DataFrame:
    """backend, rank, source, target, products. The core backend turns every type into text and XML."""
    rows = []
    if "commercial" in backends:
        rows += [("commercial", 0, mime(a), mime(b), products_for(a, b)) for a, b in COMMERCIAL]
    if "office" in backends:
        rows += [("office", 1, mime(a), mime(b), []) for a, b in OFFICE]
    if "core" in backends:
        types = sorted({*SHORT.values()})
        rows += [("core", 2, a, b, []) for a in types for b in (mime("plain"), mime("xml"))] + [("core", 2, mime("xlsx"), mime("ods"), [])]
    return spark.createDataFrame(rows, "backend string, rank int, source string, target string, products array<string>")


def splits(spark: SparkSession, backends: tuple[str, ...] = BACKENDS) -> DataFrame:
    rows = [(b, BACKENDS.index(b), mime(s), [product_for_split(s)] if b == "commercial" else []) for b in backends for s in _SPLITS.get(b, "").split()]
    return spark.createDataFrame(rows, "backend string, rank int, source string, products array<string>")


def _types(spark: SparkSession, shorts: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(mime(s),) for s in shorts], f"{name} string")


def capability_matrix(spark: SparkSession, backends: tuple[str, ...] = BACKENDS) -> DataFrame:
    """source, target of every conversion between report types and targets, two fixed lists of 24 and 18."""
    pairs = spark.createDataFrame([(mime(a), mime(b)) for a in REPORT_TYPES for b in REPORT_TARGETS if a != b], "source string, target string")
    return pairs.join(F.broadcast(routes(spark, backends).select("source", "target").distinct()), ["source", "target"], "left_semi")


def capability_types(spark: SparkSession, backends: tuple[str, ...] = BACKENDS) -> DataFrame:
    """direction, mime: the inputs and outputs of all capabilities, distinct and in order."""
    found = capability_matrix(spark, backends)
    divided = splits(spark, backends).select("source").join(F.broadcast(_types(spark, REPORT_TYPES, "source")), "source", "left_semi")
    inputs = found.select("source").union(divided).distinct().select(F.lit("input").alias("direction"), F.col("source").alias("mime"))
    return inputs.union(found.select(F.lit("output"), "target").distinct()).orderBy("direction", "mime")


def licensed(df: DataFrame, products: list[str]) -> DataFrame:
    """Rows whose products are all licensed."""
    own = F.array(*map(F.lit, products)) if products else F.expr("CAST(array() AS array<string>)")
    return df.where(F.forall("products", lambda p: F.array_contains(own, p)))


def two_hop_paths(spark: SparkSession, backends: tuple[str, ...] = ("commercial", "office")) -> DataFrame:
    """source, target, via: a pair without a direct route, by way of a third type."""
    direct = routes(spark, backends).select("source", "target").distinct()
    second = direct.select(F.col("source").alias("via"), F.col("target").alias("end"))
    paths = direct.withColumnRenamed("target", "via").join(F.broadcast(second), "via").where("source <> end").select("source", F.col("end").alias("target"), "via")
    return paths.join(F.broadcast(direct), ["source", "target"], "left_anti")


def available_targets(df: DataFrame, spark: SparkSession, targets: list[str], backends: tuple[str, ...] = BACKENDS, keep_self: bool = False) -> DataFrame:
    """df(mime, ...) with targets: the comma-joined types that it can be converted to, in order."""
    listed = routes(spark, backends).select(F.col("source").alias("mime"), "target").distinct().join(F.broadcast(_types(spark, targets, "target")), "target")
    if not keep_self:
        listed = listed.where("mime <> target")
    per = listed.groupBy("mime").agg(F.array_join(F.array_sort(F.collect_list("target")), ",").alias("targets"))
    return df.join(F.broadcast(per), "mime", "left").withColumn("targets", F.coalesce("targets", F.lit("")))


def route_lineage(df: DataFrame, spark: SparkSession, backends: tuple[str, ...] = BACKENDS) -> DataFrame:
    """df(mime, target, ...) with implementation: identity for equal types, else the first backend with a route, else null."""
    best = routes(spark, backends).groupBy(F.col("source").alias("mime"), "target").agg(F.min_by("backend", "rank").alias("backend"))
    return df.join(F.broadcast(best), ["mime", "target"], "left").withColumn("implementation", F.when(F.col("mime") == F.col("target"), "identity").otherwise(F.col("backend"))).drop("backend")


# Licensed products.
PRODUCTS = ("words", "cells", "slides", "pdf", "email", "zip")


def licensed_products(environment: Mapping[str, str]) -> list[str]:
    """Products with a licence: all by DOCLOOM_LICENSE_TOTAL, else each by DOCLOOM_LICENSE_<PRODUCT>; DOCLOOM_LICENSE_OFF turns all off.

    Only whether a variable is set is looked at; values are neither kept nor logged.
    """
    if environment.get("DOCLOOM_LICENSE_OFF", "").lower() in ("1", "true", "yes"):
        return []
    if environment.get("DOCLOOM_LICENSE_TOTAL"):
        return list(PRODUCTS)
    return [p for p in PRODUCTS if environment.get(f"DOCLOOM_LICENSE_{p.upper()}")]


def backend_status(spark: SparkSession, environment: Mapping[str, str], office: bool = False) -> DataFrame:
    """backend, available, routes, divisible: a report."""
    ready = {"commercial": bool(licensed_products(environment)), "office": office, "core": True}
    flags = spark.createDataFrame([(b, ready[b]) for b in BACKENDS], "backend string, available boolean")
    n = routes(spark).groupBy("backend").agg(F.count("*").alias("routes"))
    m = splits(spark).groupBy("backend").agg(F.count("*").alias("divisible"))
    return flags.join(F.broadcast(n), "backend", "left").join(F.broadcast(m), "backend", "left").fillna(0, ["routes", "divisible"])


def require_conversion(source: str, target: str) -> None:
    """Fails, before any row is read, if no backend has the route of these short names."""
    if (source, target) not in COMMERCIAL + OFFICE and target not in ("plain", "xml") and (source, target) != ("xlsx", "ods"):
        raise LookupError(f"no conversion from {source} to {target}")


def require_splitter(source: str) -> None:
    if not any(source in s.split() for s in _SPLITS.values()):
        raise LookupError(f"no splitter for {source}")


def require_path(*types: str) -> None:
    for a, b in zip(types, types[1:]):
        require_conversion(a, b)
