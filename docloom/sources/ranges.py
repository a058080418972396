"""Files read by ranges, in any store that pyarrow's file systems reach (local and mounted folders, object stores, HDFS)."""

from __future__ import annotations

import fnmatch
import io
from collections import OrderedDict
from functools import cache

from pyarrow import fs

#: Bytes read at a time, and blocks of them kept.
BLOCK_BYTES, BLOCKS = 64 << 10, 32


@cache
def _store(scheme: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(scheme)[0]


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, one for each worker and authority, and the path there."""
    scheme, mark, rest = uri.partition("://")
    if not mark:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    host, _, path = rest.partition("/")
    if scheme in ("s3", "s3a", "gs", "abfs"):  # the bucket is part of the path there
        return _store(f"{scheme.removesuffix('a')}://{host}"), f"{host}/{path}"
    return _store(f"{scheme}://{host}/"), f"/{path}"


def list_files(pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files under a folder, at any depth, or that match a glob; sorted, hidden ones and those under hidden folders left out."""
    store, path = store_of(pattern)
    root = path
    while any(c in root for c in "*?["):
        root = root.rpartition("/")[0] or "/"
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        found = [info]
    elif info.type == fs.FileType.NotFound:
        raise FileNotFoundError(pattern)
    else:
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
    prefix = root.rstrip("/") + "/"
    out = []
    for f in found:
        inside = f.path.removeprefix(prefix)
        hidden = f.path != root and any(p.startswith((".", "_")) for p in inside.split("/"))
        if f.type == fs.FileType.File and not hidden and (root == path or _matches(f.path, path)):
            out.append((f.path, f.size))
    return sorted(out)


def _matches(path: str, pattern: str) -> bool:
    """A star stays within a level of folders."""
    a, b = path.split("/"), pattern.split("/")
    return len(a) == len(b) and all(map(fnmatch.fnmatchcase, a, b))


class RangeFile(io.RawIOBase):
    """A file that can be searched without being read: blocks come as they are asked for, the last BLOCKS stay; `bytes_read` counts them."""

    def __init__(self, uri: str, block: int = BLOCK_BYTES, blocks: int = BLOCKS):
        store, path = store_of(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()
        self.block, self.most = block, blocks
        self.kept: OrderedDict[int, bytes] = OrderedDict()
        self.at = self.bytes_read = 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        base = {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence]
        if base + offset < 0:
            raise OSError("before the file's start")  # as files do
        self.at = base + offset
        return self.at

    def read_range(self, start: int, length: int) -> bytes:
        """Bytes past the blocks, once: for bodies that are read from end to end."""
        found = self.file.read_at(max(0, min(length, self.size - start)), start)
        self.bytes_read += len(found)
        return found

    def _block(self, k: int) -> bytes:
        if k in self.kept:
            self.kept.move_to_end(k)
        else:
            self.kept[k] = self.read_range(k * self.block, self.block)
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        return self.kept[k]

    def read(self, size: int = -1) -> bytes:
        end = self.size if size is None or size < 0 else min(self.size, self.at + size)
        if end - self.at > self.block * 4:
            found = self.read_range(self.at, end - self.at)
        else:
            parts = []
            for k in range(self.at // self.block, -(-end // self.block)):
                base = k * self.block
                parts.append(self._block(k)[max(0, self.at - base) : end - base])
            found = b"".join(parts)
        self.at = max(self.at, end)
        return found

    def readinto(self, buffer) -> int:
        found = self.read(len(buffer))
        buffer[: len(found)] = found
        return len(found)

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()
