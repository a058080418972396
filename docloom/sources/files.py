"""Files in and out."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.functions.mime import detect_lazily


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, content, mime, metadata of the files under a path or glob; mime by name, else by content."""
    found = spark.read.format("binaryFile").load(path)
    mime = detect_lazily(F.col("content"), F.regexp_extract("path", r"([^/]*)$", 1))
    return found.select(F.xxhash64("path").alias("doc_id"), "path", "content", mime.alias("mime"), F.create_map(F.lit("filename"), F.regexp_extract("path", r"([^/]*)$", 1)).alias("metadata"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: whole files as UTF-8 text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def documents_from_text(df: DataFrame, text: str = "text", mime: str = "text/plain") -> DataFrame:
    """df with content and mime in place of a text column."""
    return df.select(*[c for c in df.columns if c != text], F.encode(F.col(text), "UTF-8").alias("content"), F.lit(mime).alias("mime"))


def write_files(df: DataFrame, folder: str, name: str = "filename", content: str = "content") -> int:
    """A file for each row, in a folder that all executors share; returns how many.

    Files are written under a name of the attempt and renamed, so that a repeated task leaves whole files. Names must
    be relative and stay inside the folder.
    """
    local = folder.removeprefix("file://").rstrip("/")
    if "://" in local:
        raise ValueError("a mounted folder is needed; other stores take tables (write.parquet)")

    def put(path: str, data: bytes) -> None:
        at = os.path.normpath(os.path.join(local, path))
        if not at.startswith(local + "/"):
            raise ValueError(f"{path} leaves the folder")
        os.makedirs(os.path.dirname(at), exist_ok=True)
        tmp = f"{at}.{uuid.uuid4().hex}.tmp"
        try:
            with open(tmp, "wb") as f:
                f.write(data)
            os.replace(tmp, at)
        finally:
            if os.path.exists(tmp):
                os.remove(tmp)

    def write(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a file's bytes are a Python object one at a time
                put(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    # counted in the pass that writes
    return df.select(name, content).where(f"`{content}` IS NOT NULL").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows from JSON lines, or from whole files that each hold an object or an array of objects."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", True).json(path) if path.endswith(".json") else reader.json(path)


def write_json(df: DataFrame, folder: str) -> None:
    """Rows as JSON lines, null fields included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    store, at = _path(spark, path)
    return store.exists(at)


def delete(spark: SparkSession, path: str, recursive: bool = False) -> bool:
    """Removes a file or, if asked for, a folder with what it holds; false if there was none."""
    store, at = _path(spark, path)
    return store.delete(at, recursive)


def responses(df: DataFrame, content: str = "content", mime: str = "mime") -> DataFrame:
    """df with content_type and content_length as a server would send them."""
    known = F.col(mime).rlike(r"^[a-z]+/[a-z0-9.+-]+$")
    return df.withColumns({"content_type": F.when(known, F.col(mime)).otherwise("application/octet-stream"), "content_length": F.length(content).cast("long")})
