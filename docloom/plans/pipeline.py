"""Transforms as functions from DataFrame to DataFrame, and their composition."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window, functions as F

from docloom.functions.errors import error

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Transform:
    """A named step. Composition takes the lower priority and joins the names."""

    name: str
    run: Step
    priority: int = 0

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.run(df)

    def __rshift__(self, other: Transform) -> Transform:
        return Transform(f"{self.name} >>> {other.name}", lambda df: other.run(self.run(df)), min(self.priority, other.priority))

    def with_priority(self, priority: int) -> Transform:
        return replace(self, priority=priority)

    def named(self, name: str) -> Transform:
        return replace(self, name=name)


identity = Transform("identity", lambda df: df)
empty = Transform("empty", lambda df: df.where(F.lit(False)))


def conversion(name: str, column: Callable[[F.Column], F.Column], value: str = "text") -> Transform:
    """One row to one row, by an expression over a column."""
    return Transform(name, lambda df: df.withColumn(value, column(F.col(value))))


def failing(kind: str, message: str) -> Transform:
    """Every row gets the error."""
    return Transform(f"fail {kind}", lambda df: df.withColumn("error", error(kind, F.lit(message))))


def first_or_fail(df: DataFrame, key: str, order: str, name: str = "transform") -> DataFrame:
    """The first row of each key; keys whose value is null have a Validation error instead."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__rank = 1").drop("__rank")
    return ranked.withColumn("error", F.when(F.col(order).isNull(), error("Validation", F.lit(f"{name} produced no outputs"))))


@dataclass(frozen=True)
class PipelineBuilder:
    """from_type(a).via(step).to(b): a plan that runs over any number of documents at once."""

    source: str
    steps: tuple[Transform, ...] = ()
    target: str | None = None

    def via(self, step: Transform) -> PipelineBuilder:
        return replace(self, steps=(*self.steps, step))

    def to(self, target: str) -> PipelineBuilder:
        return replace(self, target=target)

    @property
    def transform(self) -> Transform:
        out = identity
        for k, s in enumerate(self.steps):
            out = s if not k else out >> s
        return out

    def run(self, df: DataFrame) -> DataFrame:
        """Rows of the source type only, through all steps."""
        own = df.where(F.col("mime") == self.source) if "mime" in df.columns else df
        out = self.transform(own)
        return out.withColumn("mime", F.lit(self.target)) if self.target else out


def from_type(source: str) -> PipelineBuilder:
    return PipelineBuilder(source)


def on_error(df: DataFrame, policy: str = "tag") -> DataFrame:
    """What becomes of rows with an error: tag keeps them, drop leaves them out, throw fails the query."""
    if policy == "drop":
        return df.where("error IS NULL")
    if policy == "throw":
        return df.where(F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("error.message")).cast("boolean")))
    if policy != "tag":
        raise ValueError(f"unknown policy {policy}")
    return df


def fallback(primary: F.Column, primary_error: F.Column, *others: tuple[F.Column, F.Column]) -> tuple[F.Column, F.Column]:
    """(value, error) of the first attempt that ends: with a value, or with an error that isn't retryable; else the last error."""
    from docloom.functions.errors import RETRYABLE

    attempts = [(primary, primary_error), *others]
    value, fault = attempts[-1]
    for v, e in reversed(attempts[:-1]):
        again = e.isNotNull() & e["type"].isin(*RETRYABLE)
        value, fault = F.when(again, value).otherwise(v), F.when(again, fault).otherwise(e)
    return value, fault
