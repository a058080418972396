"""Large files as a stream of chunks: `spark.readStream.format("docloom_chunks").load(path)`.

An offset is how many bytes of each file have been given; it is all that a restart needs, so a chunk is given once whether a query goes on, ends or is
killed between. A batch takes what has come since, new files and what was appended to old ones, in chunks of at most `chunkBytes` that its
tasks read by range, `splitBytes` to a task; no file is held by a row, a task or the driver. Meant for large files: an offset has an entry for each file.

Rows: path, seq (from 0, in the file's order), at (bytes before it), content, size (of the file when the batch began), last (the chunk ends
there). Seq counts on over batches, whatever was appended when, if files grow by whole chunks only; with `growing` false, the default, a
file is taken as complete when it appears, and more of it, or less, is an error.

Defined cases: an empty file has no chunks; a file that went away before its batch fails the batch, and the restart too unless it is back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docloom.sources.archives import BATCH_BYTES, CHUNK_BYTES, SPLIT_BYTES, Ranges
from docloom.sources.ranges import RangeFile, list_files

SCHEMA = "path string, seq long, at long, content binary, size long, last boolean"


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docloom_chunks"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ChunkReader(self.options, schema)


class ChunkReader(DataSourceStreamReader):
    def __init__(self, options, schema: StructType):
        self.path, self.arrow = options["path"], to_arrow_schema(schema)
        self.chunk, self.split = int(options.get("chunkBytes", CHUNK_BYTES)), int(options.get("splitBytes", SPLIT_BYTES))
        self.growing = options.get("growing", "false").lower() == "true"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Bytes of each file; of a growing one, those of its whole chunks."""
        try:
            found = list_files(self.path)
        except FileNotFoundError:
            return {}
        return {p: n - n % self.chunk if self.growing else n for p, n in found}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        parts: list[InputPartition] = []
        now: list[tuple[str, int, int]] = []
        held = 0
        for path, size in sorted(end.items()):
            at = start.get(path, 0)
            if at and size != at and not self.growing:
                raise ValueError(f"{path} had {at} bytes and has {size} now")
            while at < size:
                to = min(size, at + max(self.chunk, self.split - held) // self.chunk * self.chunk)
                now.append((path, at, to))
                held, at = held + to - at, to
                if held >= self.split:
                    parts.append(Ranges(now))
                    now, held = [], 0
        return [*parts, Ranges(now)] if now or not parts else parts

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for path, start, end in partition.parts:
            with RangeFile(path) as file:
                for at in range(start, end, self.chunk):
                    want = min(self.chunk, end - at)
                    content = file.read_range(at, want)
                    if len(content) != want:
                        raise OSError(f"{path} is shorter than it was")
                    rows.append((path, at // self.chunk, at, content, file.size, at + want == file.size))
                    held += want
                    if held >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.arrow)], schema=self.arrow)


def stream_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, split_bytes: int = SPLIT_BYTES, growing: bool = False) -> DataFrame:
    """Rows of SCHEMA: the chunks of files under a path, as they come."""
    spark.dataSource.register(ChunkSource)
    return spark.readStream.format("docloom_chunks").options(chunkBytes=chunk_bytes, splitBytes=split_bytes, growing=str(growing).lower()).load(path)
