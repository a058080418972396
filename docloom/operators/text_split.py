"""Splitters of text and CSV. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docloom.functions.text import trim_controls


def paragraphs(text) -> F.Column:
    """The paragraphs of a text as an array: between blank lines, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(text, "\n\\s*\n"), trim_controls), lambda p: F.length(p) > 0)


def split_paragraphs(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, index, label, total, text of the paragraphs between blank lines; blank ones don't count.

    Null and blank texts give no rows.
    """
    found = df.select(*keep, paragraphs(F.col(text)).alias("__parts"))
    return found.select(*keep, F.size("__parts").alias("total"), F.posexplode("__parts").alias("index", "text")).select(*keep, "index", F.concat(F.lit("Paragraph "), (F.col("index") + 1).cast("string")).alias("label"), "total", "text")


def split_csv_rows(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, index, label, total, text of each non-blank line after the first, under the first line.

    Lines end at line feeds, quoted or not; labels count non-blank rows from 2.
    """
    lines = F.split(F.col(text), "\r?\n", -1)
    rows = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda r: F.length(trim_controls(r)) > 0)
    found = df.select(*keep, F.get(lines, F.lit(0)).alias("__head"), rows.alias("__rows"))
    out = found.select(*keep, "__head", F.size("__rows").alias("total"), F.posexplode("__rows").alias("index", "__row"))
    return out.select(*keep, "index", F.concat(F.lit("Row "), (F.col("index") + 2).cast("string")).alias("label"), "total", F.concat("__head", F.lit("\n"), "__row").alias("text"))


def csv_to_html(csv) -> F.Column:
    """A table of the lines and their comma-separated cells."""
    from docloom.functions.text import escape_xml

    lines = F.filter(F.split(csv, "\r?\n", -1), lambda r: F.length(trim_controls(r)) > 0)
    cell = lambda c: F.concat(F.lit("<td>"), escape_xml(c), F.lit("</td>"))
    row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.split(r, ",", -1), cell), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(lines, row), ""), F.lit("</table>"))


def retained_text(df: DataFrame, text: str = "text") -> DataFrame:
    """DOCX-like splitting of plain text that keeps it whole: one fragment named Document."""
    return df.select("*", F.lit(0).alias("index"), F.lit("Document").alias("label"), F.lit(1).alias("total"))
