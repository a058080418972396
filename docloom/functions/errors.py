"""Errors as values: a struct column that is null where all went well."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# Kinds of error and the HTTP status each is reported with.
STATUS = {"Parse": 400, "Render": 500, "Validation": 422, "UnsupportedConversion": 415, "Timeout": 504, "Cancelled": 499, "Resource": 503, "Split": 422, "Composite": 500, "General": 500}
#: Kinds after which another backend is tried.
RETRYABLE = ("UnsupportedConversion", "Resource")


def http_status(kind) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, chain(*STATUS.items()))), kind), F.lit(500))


def error(kind, message, details=None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("type"), message.alias("message"), (F.lit(None).cast("string") if details is None else details).alias("details"), http_status(kind).alias("http_status"))


def unsupported(source, target) -> Column:
    return error("UnsupportedConversion", F.concat(F.lit("Unsupported conversion: "), source, F.lit(" -> "), target))


def composite_message(messages) -> Column:
    """One message of an array of them."""
    return F.concat(F.size(messages).cast("string"), F.lit(" errors occurred: "), F.array_join(messages, "; "))
