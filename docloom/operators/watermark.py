"""Watermarks in PDF content streams: which trailing drawing operators can go.

The operators of a page come as an array of strings, each ending with its command. The rules are expressions and
aggregations over such arrays; `operators.pdf` applies them to files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

# Commands that may follow the last text block in a watermark.
WRAPPERS = ["q", "Q", "cm", "w", "J", "j", "M", "d", "i", "ri", "gs", "g", "G", "rg", "RG"]
PATHS = ["m", "l", "c", "v", "y", "h", "re"]
PAINTS = ["S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n", "W", "W*"]
MIN_PREFIX = 10


def command(op: Column) -> Column:
    return F.substring_index(F.trim(op), " ", -1)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trailing_ops(ops) -> Column:
    """The operators after the last ET; none if there is no ET."""
    after = lambda o, last: F.when(last > 0, F.slice(o, F.size(o) - last + 2, F.greatest(last - 1, F.lit(0)))).otherwise(F.slice(o, 1, 0))
    place = lambda o: F.array_position(F.reverse(F.transform(o, command)), F.lit("ET")).cast("int")
    return _once(ops, lambda o: _once(F.struct(o.alias("o"), place(o).alias("last")), lambda s: after(s["o"], s["last"])))


def trailing_count(ops) -> Column:
    """Operators that can be removed: none if any of them is unsafe or none draws."""

    def count(commands: Column) -> Column:
        safe = F.forall(commands, lambda c: c.isin(WRAPPERS + PATHS + PAINTS))
        return F.when(safe & F.exists(commands, lambda c: c.isin(PATHS + PAINTS)), F.size(commands)).otherwise(0)

    return _once(F.transform(trailing_ops(ops), command), count)


def normalize_op(op: Column) -> Column:
    return F.regexp_replace(op, r"/G\d+ gs", "/GX gs")


def common_prefix_length(df: DataFrame, group: str, page: str, ops: str) -> DataFrame:
    """group, pages, prefix: how many leading operators all pages of a group share. A row per operator is grouped by place."""
    flat = df.select(group, page, F.posexplode(F.transform(F.col(ops), normalize_op)).alias("pos", "op"))
    pages = df.groupBy(group).agg(F.count_distinct(page).alias("pages"))
    at = flat.groupBy(group, "pos").agg(F.count("*").alias("n"), F.min("op").alias("low"), F.max("op").alias("high"))
    marked = at.join(pages, group).withColumn("differs", (F.col("low") != F.col("high")) | (F.col("n") < F.col("pages")))
    ends = marked.groupBy(group).agg(F.coalesce(F.min(F.when(F.col("differs"), F.col("pos"))), F.max("pos") + 1).alias("prefix"))
    return pages.join(ends, group, "left").select(group, "pages", F.coalesce("prefix", F.lit(0)).alias("prefix"))


def mode_count(df: DataFrame, group: str, count: str) -> DataFrame:
    """group, mode, pages: the most frequent positive count of a group, the smallest of equals, if two pages have it."""
    seen = df.where(F.col(count) > 0).groupBy(group, count).agg(F.count("*").alias("pages"))
    ranked = seen.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("pages"), count)))
    return ranked.where("rank = 1 AND pages >= 2").select(group, F.col(count).alias("mode"), "pages")
