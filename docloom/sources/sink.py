"""Files as a data sink that commits: `df.write.format("docloom_files").mode("append").save(folder)`, or writeStream with the same format.

Tasks write under `<folder>/_staged/<write>/<attempt>/`; when all have ended, the driver moves the files of the attempts that count to their
places and drops the rest, so a task that fails or is repeated leaves nothing and doubles nothing, and a reader that leaves out names
with an underscore (as Spark's do) sees no half-written file. In a stream, each batch is a write; a marker in `_batches` names those that
are in place, and a batch that comes again after a restart is passed over if it is there, else written again over what may be in place.

Rows have `filename` (relative, within the folder) and `content`; other columns are not used. Any store that pyarrow's file systems reach.

Defined cases: a null name or content is no file; a name that leaves the folder, or begins with an underscore or dot, fails the write, as do
two rows of one name (within a task at once, across tasks at the commit, before any file is moved); a file of that name from an earlier write
is replaced; `overwrite` removes all the folder's files at the commit, not before; an empty table writes nothing.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from docloom.sources.ranges import store_of

#: Moves that the driver has under way at once.
MOVES = 16
STAGED, BATCHES = "_staged", "_batches"


@dataclass
class Staged(WriterCommitMessage):
    """An attempt's folder and how many files it holds; names are read from the store at the commit."""

    folder: str
    files: int


def checked(name: str) -> str:
    """A name inside the folder, as it will be there."""
    at = posixpath.normpath(name)
    if name.startswith("/") or at in ("", ".", "..") or at.startswith("../") or any(p.startswith(("_", ".")) for p in at.split("/")):
        raise ValueError(f"{name!r} is no name of a file in the folder")
    return at


class _Files:
    """What batch and stream writers share."""

    def __init__(self, options, schema: StructType, overwrite: bool):
        missing = {"filename", "content"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"columns {sorted(missing)} are missing")
        self.folder, self.overwrite, self.run = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def _stage(self, batches: Iterator[pa.RecordBatch], alive: Callable[[], None] = lambda: None) -> Staged:
        store, root = store_of(self.folder)
        attempt = f"{root}/{STAGED}/{self.run}/{uuid.uuid4().hex}"
        try:
            return Staged(attempt, self._put(batches, attempt, alive))
        except BaseException:
            if store.get_file_info(attempt).type == fs.FileType.Directory:
                store.delete_dir(attempt)
            raise

    def _put(self, batches: Iterator[pa.RecordBatch], attempt: str, alive: Callable[[], None]) -> int:
        """Files of an attempt; `alive` is asked before and after each batch."""
        store, _ = store_of(self.folder)
        names: set[str] = set()
        made: set[str] = set()
        for batch in batches:
            alive()
            for name, data in zip(batch.column("filename"), batch.column("content")):  # a file's bytes are a Python object one at a time
                if not name.is_valid or not data.is_valid:
                    continue
                at = checked(name.as_py())
                if at in names:
                    raise ValueError(f"two rows are named {at!r}")
                names.add(at)
                folder = posixpath.dirname(f"{attempt}/{at}")
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{attempt}/{at}") as out:
                    out.write(data.as_buffer())
        alive()
        return len(names)

    def _moves(self, messages: list[Staged | None]) -> dict[str, str]:
        """Place -> staged file, of the attempts that count."""
        store, root = store_of(self.folder)
        moves: dict[str, str] = {}
        for m in messages:
            if m is None or not m.files:
                continue
            found = [f.path for f in store.get_file_info(fs.FileSelector(m.folder, recursive=True)) if f.type == fs.FileType.File]
            for path in found:
                target = root + path.removeprefix(m.folder)
                if target in moves:
                    raise ValueError(f"two rows are named {target.removeprefix(root + '/')!r}")
                moves[target] = path
        return moves

    def _place(self, moves: dict[str, str]) -> None:
        store, _ = store_of(self.folder)
        for folder in {posixpath.dirname(t) for t in moves}:
            store.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda m: store.move(m[1], m[0]), moves.items()))

    def _clear(self) -> None:
        """The files of an earlier table go; what is staged and the markers stay."""
        store, root = store_of(self.folder)
        for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if not posixpath.basename(f.path).startswith("_"):
                (store.delete_dir if f.type == fs.FileType.Directory else store.delete_file)(f.path)

    def _drop(self) -> None:
        store, root = store_of(self.folder)
        at = f"{root}/{STAGED}"
        if store.get_file_info(f"{at}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/{self.run}")
        if store.get_file_info(at).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(at)):
            store.delete_dir(at)


class FileWriter(_Files, DataSourceArrowWriter):
    """The driver marks a write as open; tasks that go on after it was aborted see that the mark is gone and take back what they have."""

    def __init__(self, options, schema: StructType, overwrite: bool):
        super().__init__(options, schema, overwrite)
        store, root = store_of(self.folder)
        self.mark = f"{root}/{STAGED}/{self.run}/open"
        store.create_dir(posixpath.dirname(self.mark), recursive=True)
        with store.open_output_stream(self.mark) as out:
            out.write(b"")

    def _alive(self) -> None:
        if store_of(self.folder)[0].get_file_info(self.mark).type == fs.FileType.NotFound:
            self._drop()
            raise RuntimeError("the write was aborted")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self._stage(iterator, self._alive)

    def commit(self, messages: list[Staged | None]) -> None:
        try:
            moves = self._moves(messages)
            if self.overwrite:
                self._clear()
            self._place(moves)
        finally:
            self._drop()

    def abort(self, messages: list[Staged | None]) -> None:
        self._drop()


class FileStreamWriter(_Files, DataSourceStreamArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self._stage(iterator)

    def _marker(self, batch: int) -> str:
        return f"{store_of(self.folder)[1]}/{BATCHES}/{batch}"

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        store, _ = store_of(self.folder)
        if store.get_file_info(self._marker(batchId)).type == fs.FileType.NotFound:
            moves = self._moves(messages)
            self._place(moves)
            store.create_dir(posixpath.dirname(self._marker(batchId)), recursive=True)
            with store.open_output_stream(self._marker(batchId)) as out:
                out.write(json.dumps({"files": len(moves)}).encode())
        self._discard(messages)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self._discard(messages)

    def _discard(self, messages: list[Staged | None]) -> None:
        """Attempts that sent no message stay staged, unseen, until `clean_staged`: a later batch may be under way beside them."""
        store, _ = store_of(self.folder)
        for m in messages:
            if m is not None and store.get_file_info(m.folder).type == fs.FileType.Directory:
                store.delete_dir(m.folder)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docloom_files"

    def schema(self) -> str:
        return "filename string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options, schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> FileStreamWriter:
        return FileStreamWriter(self.options, schema, overwrite)


def clean_staged(folder: str) -> None:
    """Drops what failed attempts have left in a folder that nobody writes to now."""
    store, root = store_of(folder.rstrip("/"))
    if store.get_file_info(f"{root}/{STAGED}").type == fs.FileType.Directory:
        store.delete_dir(f"{root}/{STAGED}")


def _rows(df: DataFrame, name: str, content: str) -> DataFrame:
    return df.select(F.col(name).cast("string").alias("filename"), F.col(content).cast("binary").alias("content"))


def commit_files(df: DataFrame, folder: str, name: str = "filename", content: str = "content", mode: str = "append") -> None:
    """A file for each row; all of them are in place afterwards, or none."""
    df.sparkSession.dataSource.register(FileSink)
    _rows(df, name, content).write.format("docloom_files").mode(mode).save(folder)


def stream_files(stream: DataFrame, folder: str, checkpoint: str, name: str = "filename", content: str = "content"):
    """The writer of a stream whose batches are committed one by one; `.start()` it, with a trigger if wanted."""
    stream.sparkSession.dataSource.register(FileSink)
    return _rows(stream, name, content).writeStream.format("docloom_files").option("path", folder).option("checkpointLocation", checkpoint)
