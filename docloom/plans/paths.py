"""Cheapest conversions of any length: relaxation over a relation of routes with costs, as rounds of joins.

A round extends the paths that the last one improved by one route, and keeps for each pair of types the best path found so far; it ends when nothing
improves, after as many rounds as the longest cheapest path has routes at most. Paths that come back to a type are not extended. Listing all simple paths, as
a recursive query would, grows exponentially with the routes; here a pair has one path at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.plans.registry import BACKENDS, licensed, routes
from docloom.sources.scratch import cut


def cheapest_paths(edges: DataFrame) -> DataFrame:
    """source, target, cost, hops, path of each pair of which one can be reached from the other; edges: source, target, cost (none negative, nulls left out).

    Of equal costs the path of fewer hops, then the first in the order of its types. A node is not its own target.
    """
    direct = cut(edges.where("source IS NOT NULL AND target IS NOT NULL AND cost IS NOT NULL AND source <> target").groupBy("source", "target").agg(F.min("cost").cast("double").alias("cost")))
    if not direct.where("cost < 0").isEmpty():
        raise ValueError("costs must not be negative")
    step = direct.select(F.col("source").alias("via"), F.col("target").alias("end"), F.col("cost").alias("more"))
    whole = F.struct("cost", "hops", "path")
    best = direct.select("source", "target", "cost", F.lit(1).alias("hops"), F.array("source", "target").alias("path"))
    front = best
    while True:
        longer = front.join(step, front["target"] == step["via"]).where(~F.array_contains("path", F.col("end")))
        longer = longer.select("source", F.col("end").alias("target"), (F.col("cost") + F.col("more")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.array_append("path", F.col("end")).alias("path"))
        found = longer.groupBy("source", "target").agg(F.min(whole).alias("new"))
        both = cut(best.select("source", "target", whole.alias("old")).join(found, ["source", "target"], "full"))
        better = F.col("old").isNull() | (F.col("new") < F.col("old"))
        front = both.where(F.col("new").isNotNull() & better).select("source", "target", "new.*")
        if front.isEmpty():
            return best
        best = both.select("source", "target", F.when(F.coalesce(better, F.lit(False)), F.col("new")).otherwise(F.col("old")).alias("b")).select("source", "target", "b.*")


def route_costs(spark: SparkSession, backends: tuple[str, ...] = BACKENDS, products: list[str] | None = None) -> DataFrame:
    """The registry's routes, each at the place of its backend in the order they are tried, from 1."""
    found = routes(spark, backends)
    if products is not None:
        found = licensed(found, products)
    return found.groupBy("source", "target").agg((F.min("rank") + 1).alias("cost"))


def plan_conversions(df: DataFrame, backends: tuple[str, ...] = BACKENDS, products: list[str] | None = None) -> DataFrame:
    """df(mime, target, ...) with path, hops and cost of the cheapest chain of conversions: no hop for equal types, nulls where there is no chain."""
    paths = cheapest_paths(route_costs(df.sparkSession, backends, products))
    # pairs of the registry's types, a fixed list
    joined = df.join(F.broadcast(paths.withColumnsRenamed({"source": "mime"})), ["mime", "target"], "left")
    same = F.col("mime") == F.col("target")
    return joined.withColumns({"path": F.when(same, F.array("mime")).otherwise(F.col("path")), "hops": F.when(same, 0).otherwise(F.col("hops")), "cost": F.when(same, 0.0).otherwise(F.col("cost"))})
