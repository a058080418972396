"""ZIP archives as a data source: `spark.read.format("docloom_archive").load(path)`.

An archive is divided into ranges of its bytes, and a task takes the entries whose header begins in its range, so that one archive is read
by as many tasks as it has ranges; nobody but the tasks reads it, and each reads its central directory and its own entries only. An
entry is rows of at most `chunkBytes`, inflated as a stream, so neither an entry of many gigabytes nor one that inflates a thousandfold is
ever in one row; the chunks of a stored (not deflated) entry are themselves dealt over the tasks of the ranges in which they lie.

Options: `path` (a file, folder or glob), `splitBytes`, `chunkBytes`, `mode` (`core`: base names, numbered without gaps, without what macOS
adds; `full`: whole names, numbers count folders too), `content` (`false`: entries without their bytes). Conditions on `name` (equal, in a
list, begins or ends with) and on `path` are applied to the directory, so that other entries aren't inflated; they need
spark.sql.python.filterPushdown.enabled, which `register` sets.

Defined cases: a file that is no ZIP archive, or is cut short, is one row with a Parse error; an encrypted entry, an unknown coder or bad
data is an error in the entry's place (after its first chunks, if it has several); a stored entry of several chunks is read in several
tasks and its checksum is not compared; empty entries are one row of no bytes; folders have no row; an empty archive has none.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docloom.operators.archive import mac_entry, type_of_entry
from docloom.operators.base import ConversionError, as_error
from docloom.schema import ERROR
from docloom.sources.ranges import RangeFile, list_files

SPLIT_BYTES, CHUNK_BYTES = 64 << 20, 4 << 20
#: Bytes of rows that a task holds before it hands them on.
BATCH_BYTES = 16 << 20
SCHEMA = f"path string, index int, label string, name string, mime string, size long, compressed_size long, crc32 long, chunk int, chunks int, offset long, content binary, error {ERROR}"


@dataclass
class Ranges(InputPartition):
    """(path, start, end) of the ranges that a task takes: many small archives, or a part of a large one."""

    parts: list[tuple[str, int, int]]


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docloom_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options, schema)


def deal(files: Sequence[tuple[str, int]], split: int) -> list[list[tuple[str, int, int]]]:
    """Ranges of about `split` bytes; small files share one."""
    found: list[list[tuple[str, int, int]]] = []
    room = 0
    for path, size in files:
        if size > split:
            found += [[(path, at, min(size, at + split))] for at in range(0, size, split)]
            room = 0
        else:
            if size > room or not found:
                found.append([])
                room = split
            found[-1].append((path, 0, max(size, 1)))
            room -= max(size, 1 << 12)
    return found


class ArchiveReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.arrow = options["path"], to_arrow_schema(schema)
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.chunk = int(options.get("chunkBytes", CHUNK_BYTES))
        self.full = options.get("mode", "core") == "full"
        self.content = options.get("content", "true").lower() != "false"
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute in (("name",), ("path",)):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, column: str, value: str) -> bool:
        for f in self.tests:
            if f.attribute == (column,):
                if isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value:
                    return False
                if isinstance(f, StringStartsWith) and not value.startswith(f.value) or isinstance(f, StringEndsWith) and not value.endswith(f.value):
                    return False
        return True

    def partitions(self) -> Sequence[InputPartition]:
        files = [f for f in list_files(self.path) if self._wanted("path", f[0])]
        return [Ranges(p) for p in deal(files, self.split)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        arrow, held, size = self.arrow, [], 0
        for path, start, end in partition.parts:
            for row in self._entries(path, start, end):
                held.append(row)
                size += 256 + len(row[11] or b"")
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    def _entries(self, path: str, start: int, end: int) -> Iterator[tuple]:
        nothing = (None,) * 10
        first = start == 0 and not any(f.attribute == ("name",) for f in self.tests)  # rows without a name meet no condition on it
        try:
            with RangeFile(path) as file:
                try:
                    found = zipfile.ZipFile(file).infolist()
                except (zipfile.BadZipFile, NotImplementedError, OSError, ValueError, struct.error) as e:
                    if first:
                        yield path, *nothing, None, as_error(ConversionError("Parse", str(e)), "Parse")
                    return
                number = 0
                for place, info in enumerate(found):
                    if info.is_dir() or not self.full and mac_entry(info.filename):
                        continue
                    label = info.filename if self.full else info.filename.rpartition("/")[2]
                    index, number = place if self.full else number, number + 1
                    if self._wanted("name", info.filename):
                        head = (path, index, label, info.filename, type_of_entry(info.filename), info.file_size, info.compress_size, info.CRC)
                        yield from self._chunks(file, info, head, start, end)
        except OSError as e:
            if first:
                yield path, *nothing, None, as_error(ConversionError("Resource", str(e)), "Resource")

    def _chunks(self, file: RangeFile, info: zipfile.ZipInfo, head: tuple, start: int, end: int) -> Iterator[tuple]:
        """The rows of an entry that belong to a range."""
        chunks = max(1, -(-info.file_size // self.chunk))
        here = start <= info.header_offset < end
        if not self.content:
            if here:
                yield *head, 0, chunks, 0, None, None
            return
        spread = info.compress_type == zipfile.ZIP_STORED and not info.flag_bits & 1
        # a deflated entry is one stream, that of its header's range; a stored one can begin anywhere
        if not here and not (spread and info.header_offset < end and start < info.header_offset + info.compress_size + (1 << 17)):
            return
        try:
            if info.flag_bits & 1:
                raise ConversionError("Resource", f"{info.filename} is encrypted")
            if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise ConversionError("Resource", f"{info.filename} is packed by coder {info.compress_type}")
            data = self._data_at(file, info)
            if not spread:
                yield from self._inflated(file, info, head, data, chunks)
                return
            for k in range(chunks):
                at = data + k * self.chunk
                if start <= (at if k else info.header_offset) < end:
                    piece = file.read_range(at, min(self.chunk, info.file_size - k * self.chunk))
                    if k == 0 and chunks == 1 and zlib.crc32(piece) != info.CRC:
                        raise ConversionError("Parse", f"{info.filename} has another checksum")
                    yield *head, k, chunks, k * self.chunk, piece, None
        except (ConversionError, zlib.error, struct.error, EOFError) as e:
            if here:
                fault = e if isinstance(e, ConversionError) else ConversionError("Parse", f"{info.filename}: {e}")
                yield *head, None, chunks, None, None, as_error(fault, "Parse")

    @staticmethod
    def _data_at(file: RangeFile, info: zipfile.ZipInfo) -> int:
        """Where an entry's data begins: behind its local header, whose names may differ from the directory's."""
        file.seek(info.header_offset)
        local = file.read(30)
        if local[:4] != b"PK\x03\x04":
            raise ConversionError("Parse", f"no header for {info.filename}")
        names, extra = struct.unpack("<HH", local[26:30])
        return info.header_offset + 30 + names + extra

    def _inflated(self, file: RangeFile, info: zipfile.ZipInfo, head: tuple, at: int, chunks: int) -> Iterator[tuple]:
        """Chunks of one stream, no more of it in memory than a chunk and a block. The checksum is known at the end, before the last chunk goes."""
        inflate, left, crc, k, out = zlib.decompressobj(-15), info.compress_size, 0, 0, b""
        fed = b""
        while True:
            if not fed and left:
                fed = file.read_range(at, min(1 << 20, left))
                if not fed:
                    raise EOFError("cut short")
                at, left = at + len(fed), left - len(fed)
            piece = inflate.decompress(fed, self.chunk - len(out))
            fed = inflate.unconsumed_tail
            crc, out = zlib.crc32(piece, crc), out + piece
            done = inflate.eof or not piece and not fed and not left
            if done:
                if crc != info.CRC or k * self.chunk + len(out) != info.file_size:
                    raise ConversionError("Parse", f"{info.filename} has another checksum or size")
                if out or k == 0:
                    yield *head, k, chunks, k * self.chunk, out, None
                return
            if len(out) == self.chunk and k + 1 < chunks:
                yield *head, k, chunks, k * self.chunk, out, None
                k, out = k + 1, b""
            elif len(out) == self.chunk and not piece:
                raise ConversionError("Parse", f"{info.filename} is larger than its directory says")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_archives(spark: SparkSession, path: str, mode: str = "core", split_bytes: int = SPLIT_BYTES, chunk_bytes: int = CHUNK_BYTES, content: bool = True) -> DataFrame:
    """Rows of SCHEMA: the entries of ZIP archives under a path, in chunks."""
    register(spark)
    options = {"mode": mode, "splitBytes": split_bytes, "chunkBytes": chunk_bytes, "content": str(content).lower()}
    return spark.read.format("docloom_archive").options(**options).load(path)


def whole_entries(chunks: DataFrame) -> DataFrame:
    """path, index, label, name, mime, content, total, error of entries whose chunks are put together: for entries that a row can hold.

    Entries of one chunk, nearly all, are not shuffled.
    """
    kept = ["path", "index", "label", "name", "mime"]
    single = chunks.where("chunks = 1 OR error IS NOT NULL OR chunks IS NULL").select(*kept, "content", "error")
    joined = F.expr("listagg(content) WITHIN GROUP (ORDER BY chunk)")
    many = chunks.where("chunks > 1 AND error IS NULL").groupBy(*kept, "chunks").agg(joined.alias("content"), F.count("*").alias("found"))
    # a stream that turned out bad after its first chunks is known by its error row
    return single.unionByName(many.where("found = chunks").select(*kept, "content", F.lit(None).cast(ERROR).alias("error")))
