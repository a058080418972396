"""Names of fragments in directories and archives."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def padding_width(total) -> Column:
    """Digits of the total, 1 at least."""
    return F.length(F.greatest(total, F.lit(1)).cast("string"))


def pad_index(index, width) -> Column:
    digits = index.cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, F.lit("0")))


def sanitize(name) -> Column:
    r"""Each of \ / : * ? " < > | becomes an underscore; 200 characters stay."""
    return F.substring(F.regexp_replace(name, r'[\\/:*?"<>|]', "_"), 1, 200)


def fragment_filename(index, total, name, extension) -> Column:
    return F.concat(pad_index(index, padding_width(total)), F.lit("__"), sanitize(name), F.lit("."), F.regexp_replace(extension, r"^\.", ""))


def label_or_default(name, index) -> Column:
    """The name, or part-N for the zero-based index N - 1."""
    return F.coalesce(name, F.concat(F.lit("part-"), (index + 1).cast("string")))
