"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StringType, StructType

#: Bytes up to which a key table may be broadcast, counted by its rows and the width of its columns.
BROADCAST_BYTES = 48 << 20
#: Rows of one key that a join's task takes where the other side has a large value for it.
HOT_ROWS = 50_000
#: Rows that Python holds at a time.
SLICE_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A scan in as many partitions as there are cores, where it has so few splits that most cores would be idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.rdd().getNumPartitions() <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session.

    Without it, a session in one process (local master) takes a folder beside its warehouse; on a cluster that is an error, as a folder
    of the driver's machine would lose data.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_docloom_checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives lost executors and cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int) -> bool:
    """Whether a checkpointed table has at most so many rows."""
    return df.limit(rows + 1).count() <= rows


def _width(kind: DataType) -> int:
    """Bytes of a value in a row; 64 for a string, a key's usual bound."""
    if isinstance(kind, StructType):
        return 16 + sum(_width(f.dataType) for f in kind)
    return 72 if isinstance(kind, StringType) else 8


def key_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A checkpointed table of keys for one side of a join: broadcast if its counted size allows it, else shuffled."""
    bound = BROADCAST_BYTES // (16 + sum(_width(f.dataType) for f in df.schema))
    return F.broadcast(df) if small(df, bound if rows is None else rows) else df


def join_blobs(df: DataFrame, blobs: DataFrame, key: str, blob: str, keys: DataFrame | None = None) -> DataFrame:
    """df with its key's row of a checkpointed table (key, blob of any length), left; keys are unique there.

    keys has df's keys, row by row, if they are to be had for less than df itself.

    The table is broadcast if its counted bytes allow it. Beyond, both sides are shuffled, and the rows of a key with more than
    HOT_ROWS are dealt over as many parts as it takes, each of which gets the blob.
    """
    n = blobs.agg(F.sum(F.length(blob) + F.length(F.col(key).cast("string")) + 32)).first()[0] or 0
    if n <= BROADCAST_BYTES:
        return df.join(F.broadcast(blobs), key, "left")
    parts, part = fresh(df, "__parts"), fresh(df, "__part")
    # at most one such key for HOT_ROWS rows
    hot = cut((df if keys is None else keys).groupBy(key).agg(F.ceil(F.count("*") / HOT_ROWS).cast("int").alias(parts)).where(F.col(parts) > 1))
    dealt = df.join(key_side(hot), key, "left").withColumn(part, F.pmod(F.xxhash64(*df.columns), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    copies = blobs.join(key_side(hot), key, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
    return dealt.join(copies, [key, part], "left").drop(part)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most SLICE_ROWS, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_rows(df: DataFrame, fn: Callable[..., Iterator[dict]], schema: str, setup: Callable | None = None) -> DataFrame:
    """fn(columns as lists, state) yields dicts of column lists; Arrow in and out, one record batch at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in slices(batches):
            cols = [c.to_pylist() for c in batch.columns]
            for out in fn(cols, state) if setup else fn(cols):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges (a, b) of longs to (node, component), component being the smallest node that can be reached.

    Alternating large-star and small-star steps, each a min per node joined back to its edges, until
    the edges no longer change: the number of steps grows with the logarithm of the longest path, no
    step makes more edges than it reads, and a hot node costs its task as many rows as it has edges.
    Nodes without edges are not returned; loops, repeated edges and nulls are dropped.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            near = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            near = pairs
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = near.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        return out.where("a <> b").distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())

    # every edge points from the larger node to the smaller
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = mark(now)
    if not was[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(rounds):
        now = cut(star(star(now, True), False))
        if (is_ := mark(now)) == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        was = is_
    raise RuntimeError("connected_components did not settle")
