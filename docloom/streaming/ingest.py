"""Directories as streams of documents, and a stateful operator over chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.functions.mime import detect_lazily

_BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_documents(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """path, content, mime of files as they arrive in a folder."""
    found = spark.readStream.format("binaryFile").schema(_BINARY_FILE).option("maxFilesPerTrigger", max_files).load(path)
    return found.select("path", "content", detect_lazily(F.col("content"), F.regexp_extract("path", r"([^/]*)$", 1)).alias("mime"))


def drain(stream: DataFrame, target: str, checkpoint: str, timers: bool = False) -> None:
    """Writes all that is there to a Parquet folder and ends; a repeated call goes on where the last one ended.

    timers: the stream has processing-time timers, for which Spark would run batches without data for ever; they fire with the next data instead.
    """
    spark, key = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    was = spark.conf.get(key)
    if timers:
        spark.conf.set(key, "false")
    try:
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, was)


def process_chunks(stream: DataFrame, start: Callable[[], bytes], step: Callable[[bytes, bytes], bytes], finish: Callable[[bytes], bytes]) -> DataFrame:
    """stream(key, seq, chunk, last) to (key, result): a state for each key, stepped by its chunks in the order of seq, finished by a last one.

    What follows a last chunk begins anew, so a key has a result for each. Chunks of a key that come in one batch are put in order; those of a later
    batch come after them. A null chunk is empty.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = sorted((r for f in frames for r in zip(f["seq"], f["chunk"], f["last"])), key=lambda r: r[0])
        held = state.get[0] if state.exists else None
        done = []
        for _, chunk, last in rows:
            held = step(start() if held is None else held, chunk or b"")
            if last:
                done.append(finish(held))
                held = None
        if held is not None:
            state.update((held,))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame({"key": [key[0]] * len(done), "result": done})

    return stream.groupBy("key").applyInPandasWithState(run, "key string, result binary", "held binary", "append", GroupStateTimeout.NoTimeout)
