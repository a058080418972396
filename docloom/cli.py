"""Command line: convert, split, info, capabilities.

    python -m docloom.cli split -i 'in/*.zip' -o out --extract
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession, functions as F

from docloom.functions.errors import STATUS
from docloom.functions.mime import SHORT, extension_for
from docloom.functions.naming import fragment_filename
from docloom.functions.options import PAPER_SIZES, ConvertOptions
from docloom.operators.archive import zip_fragments
from docloom.operators.mixed import convert_mixed, split_mixed
from docloom.plans import registry
from docloom.sources.files import read_documents, write_files
from docloom.sources.information import read_information

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docloom")
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)
    options = argparse.ArgumentParser(add_help=False)
    options.add_argument("-i", "--input", required=True)
    options.add_argument("--type", help="source type of all files, as an extension; by default each file has its own")
    options.add_argument("--backend", choices=registry.BACKENDS)
    options.add_argument("--password")
    for name in ("evaluate-formulas", "embed-resources"):
        options.add_argument(f"--no-{name}", action="store_false", dest=name.replace("-", "_"))
    for name in ("one-sheet-per-page", "exclude-hidden", "strip-masters", "remove-watermarks", "remove-watermarks-aggressive"):
        options.add_argument(f"--{name}", action="store_true")
    options.add_argument("--fixed-layout", action="store_false", dest="flowing_layout")
    options.add_argument("--landscape", action="store_true", default=None)
    options.add_argument("--portrait", action="store_false", dest="landscape")
    options.add_argument("--paper-size", choices=list(PAPER_SIZES))
    options.add_argument("--sheet", action="append", default=[], dest="sheet_names")
    c = sub.add_parser("convert", parents=[options])
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-t", "--to", required=True, help="target type, as an extension")
    s = sub.add_parser("split", parents=[options])
    s.add_argument("-o", "--output", required=True)
    s.add_argument("--extract", action="store_true", help="files instead of a ZIP archive for each document")
    i = sub.add_parser("info")
    i.add_argument("-i", "--input", required=True)
    sub.add_parser("capabilities")
    return p


def options_of(a: argparse.Namespace) -> ConvertOptions:
    names = ConvertOptions.__dataclass_fields__
    found = {k: v for k, v in vars(a).items() if k in names}
    found["sheet_names"] = tuple(a.sheet_names)
    found["remove_watermarks"] = a.remove_watermarks or a.remove_watermarks_aggressive
    return ConvertOptions(**found)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("docloom").getOrCreate()
    if a.command == "capabilities":
        registry.capability_matrix(spark).orderBy("source", "target").show(500, False)
        return 0
    if a.command == "info":
        found = read_information(spark, a.input).select("path", "mime", F.col("size_text").alias("size"), "parts").cache()
        found.orderBy("path").show(found.count(), False)
        return 0
    docs = read_documents(spark, a.input)
    base = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    rows = docs.select(base.alias("base"), "content", F.lit(SHORT.get(a.type, a.type)).alias("mime") if a.type else "mime")
    # licences count where any is set or they are turned off
    products = registry.licensed_products(os.environ) if any(k.startswith("DOCLOOM_LICENSE_") for k in os.environ) else None
    if a.command == "convert":
        done = convert_mixed(rows, a.to, a.backend, options_of(a), products).withColumn("filename", F.concat("base", F.lit(f".{a.to}"))).withColumnRenamed("result", "content")
    else:
        found = split_mixed(rows, a.backend, options_of(a), products)
        named = found.withColumn("filename", fragment_filename(F.col("index") + 1, F.col("total"), F.col("label"), extension_for(F.col("mime"))))
        if a.extract:
            done = named.withColumn("filename", F.concat("base", F.lit("/"), "filename"))
        else:
            bad = named.where("error IS NOT NULL").select("base", F.lit(None).cast("binary").alias("content"), "error", F.lit("").alias("filename"))
            done = zip_fragments(named.where("error IS NULL"), ["base"]).withColumn("filename", F.concat("base", F.lit(".zip"))).unionByName(bad)
    done = done.cache()
    write_files(done, a.output)
    errors = done.where("error IS NOT NULL").select("base", "error.type", "error.message").take(20)
    for e in errors:
        print(f"{e.base}: {e.type} ({STATUS.get(e.type)}): {e.message}", file=sys.stderr)
    return int(bool(errors))


if __name__ == "__main__":
    sys.exit(main())
