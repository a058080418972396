"""7z archives: entries to rows.

Entries are packed in blocks, each through a chain of coders. Read are blocks of copied, LZMA, LZMA2, Deflate and BZip2 data, with or without the
delta and x86 filters; the entries of a block of other coders (encrypted, PPMd, BCJ2), or of one that inflates to more than
archive.MAX_ENTRY_BYTES, are Resource errors in their places. Checksums are held against the entries.
"""

from __future__ import annotations

import bz2
import lzma
import posixpath
import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from docloom.operators import archive
from docloom.operators.archive import mac_entry, type_of_entry
from docloom.operators.base import ConversionError, Fragment, split_documents

# Fixed values of the format: the signature, the marks of the header's parts, the numbers of coders.
SIGNATURE = bytes.fromhex("377ABCAF271C")
END, HEADER, PROPERTIES, MORE_STREAMS, STREAMS, FILES, PACKED, UNPACKED, PARTS, SIZES, CHECKSUMS, FOLDER, FOLDER_SIZES, PART_COUNTS, EMPTY, EMPTY_FILE, NAMES, ENCODED = 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 17, 23
COPY, LZMA2, DELTA, X86, LZMA, DEFLATE, BZIP2, X86_OLD = "00", "21", "03", "04", "030101", "040108", "040202", "03030103"


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ConversionError("Split", "a 7z header that ends too soon")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """The first byte's leading ones tell how many bytes follow; its other bits are the highest of the number."""
        first = self.byte()
        more = next((k for k in range(8) if not first & 0x80 >> k), 8)
        low = int.from_bytes(self.take(more), "little")
        return low | (first & 0x7F >> more) << 8 * more if more < 8 else low

    def count(self) -> int:
        """A number of things that the header goes on to list, most of them in a byte or more."""
        if (n := self.number()) > 8 * len(self.data):
            raise ConversionError("Split", "a 7z header with more items than bytes")
        return n

    def bits(self, n: int) -> list[bool]:
        raw = self.take((n + 7) // 8)
        return [bool(raw[k // 8] & 0x80 >> k % 8) for k in range(n)]

    def checksums(self, n: int) -> list[int | None]:
        known = [True] * n if self.byte() else self.bits(n)
        return [struct.unpack("<I", self.take(4))[0] if k else None for k in known]

    def expect(self, mark: int) -> None:
        if (got := self.byte()) != mark:
            raise ConversionError("Split", f"a 7z header with mark {got} in place of {mark}")


@dataclass
class _Block:
    coders: list[tuple[str, bytes, int, int]]  # number, properties, inputs, outputs
    pairs: list[tuple[int, int]]  # an input and the output that feeds it
    packed: list[int]  # inputs fed from the file
    sizes: list[int] = field(default_factory=list)
    checksum: int | None = None
    parts: list[tuple[int, int | None]] = field(default_factory=list)  # size and checksum of each entry

    def size(self) -> int:
        """The size of the output that feeds no other coder."""
        fed = {o for _, o in self.pairs}
        return next((s for k, s in enumerate(self.sizes) if k not in fed), 0)


def _block(r: _Reader) -> _Block:
    coders = []
    for _ in range(r.count()):
        flags = r.byte()
        number = r.take(flags & 15).hex()
        n_in, n_out = (r.count(), r.count()) if flags & 16 else (1, 1)
        coders.append((number, r.take(r.number()) if flags & 32 else b"", n_in, n_out))
    n_in, n_out = sum(c[2] for c in coders), sum(c[3] for c in coders)
    pairs = [(r.number(), r.number()) for _ in range(n_out - 1)]
    n_packed = n_in - len(pairs)
    packed = [next((k for k in range(n_in) if k not in {i for i, _ in pairs}), 0)] if n_packed == 1 else [r.number() for _ in range(n_packed)]
    return _Block(coders, pairs, packed)


def _streams(r: _Reader) -> tuple[int, list[int], list[_Block]]:
    """Where packed streams start, their sizes, and the blocks."""
    start, sizes, blocks = 0, [], []
    mark = r.byte()
    if mark == PACKED:
        start, n = r.number(), r.count()
        while (mark := r.byte()) != END:
            if mark == SIZES:
                sizes = [r.number() for _ in range(n)]
            elif mark == CHECKSUMS:
                r.checksums(n)
            else:
                raise ConversionError("Split", f"a 7z header with mark {mark} among the packed streams")
        mark = r.byte()
    if mark == UNPACKED:
        r.expect(FOLDER)
        n = r.count()
        r.expect(0)
        blocks = [_block(r) for _ in range(n)]
        r.expect(FOLDER_SIZES)
        for b in blocks:
            b.sizes = [r.number() for _ in range(sum(c[3] for c in b.coders))]
        if (mark := r.byte()) == CHECKSUMS:
            for b, b.checksum in zip(blocks, r.checksums(n)):
                pass
            mark = r.byte()
        mark = r.byte()
    counts = [1] * len(blocks)
    if mark == PARTS:
        if (mark := r.byte()) == PART_COUNTS:
            counts = [r.count() for _ in blocks]
            mark = r.byte()
        each = []
        for b, n in zip(blocks, counts):
            own = [r.number() for _ in range(n - 1)] if mark == SIZES else []
            each.append([*own, b.size() - sum(own)] if n else [])
        if mark == SIZES:
            mark = r.byte()
        whole = [n == 1 and b.checksum is not None for b, n in zip(blocks, counts)]
        found = iter(r.checksums(sum(n for n, w in zip(counts, whole) if not w)) if mark == CHECKSUMS else [])
        if mark == CHECKSUMS:
            mark = r.byte()
        for b, own, w in zip(blocks, each, whole):
            b.parts = [(s, b.checksum if w else next(found, None)) for s in own]
        mark = r.byte()
    else:
        for b in blocks:
            b.parts = [(b.size(), b.checksum)]
    if mark != END:
        raise ConversionError("Split", f"a 7z header with mark {mark} after the streams")
    return start, sizes, blocks


def _decoded(number: str, properties: bytes, data: bytes, size: int) -> bytes:
    if number == COPY:
        return data[:size]
    if number == LZMA:  # as a file of its own, whose header has the size
        return lzma.LZMADecompressor(lzma.FORMAT_ALONE).decompress(properties + struct.pack("<Q", size) + data, size)
    if number == LZMA2:
        bits = properties[0]
        width = 0xFFFFFFFF if bits >= 40 else (2 | bits & 1) << bits // 2 + 11
        return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": width}]).decompress(data, size)
    if number == DEFLATE:
        return zlib.decompressobj(-15).decompress(data, size) if size else b""
    if number == BZIP2:
        return bz2.BZ2Decompressor().decompress(data, size)
    own = {DELTA: {"id": lzma.FILTER_DELTA, "dist": (properties or b"\0")[0] + 1}, X86: {"id": lzma.FILTER_X86}, X86_OLD: {"id": lzma.FILTER_X86}}.get(number)
    if own is None:
        raise ConversionError("Resource", f"no reader for the 7z coder {number}")
    # filters are applied by way of LZMA2 only
    last = {"id": lzma.FILTER_LZMA2, "preset": 0}
    return lzma.decompress(lzma.compress(data, lzma.FORMAT_RAW, filters=[last]), lzma.FORMAT_RAW, filters=[own, last])


def _unpacked(b: _Block, data: bytes) -> bytes:
    if b.size() > archive.MAX_ENTRY_BYTES or max(b.sizes) > archive.MAX_ENTRY_BYTES:
        raise ConversionError("Resource", f"a block of the archive inflates to {b.size()} bytes")
    if len(b.packed) != 1 or any((i, o) != (1, 1) for _, _, i, o in b.coders):
        raise ConversionError("Resource", "no reader for 7z coders of several streams")
    at = b.packed[0]
    for _ in b.coders:
        number, properties, _, _ = b.coders[at]
        data = _decoded(number, properties, data, b.sizes[at])
        if len(data) != b.sizes[at]:
            raise ConversionError("Split", "a block of the archive that ends too soon")
        following = next((i for i, o in b.pairs if o == at), None)
        if following is None:
            return data
        at = following
    raise ConversionError("Split", "7z coders in a circle")


def _files(r: _Reader) -> list[tuple[str, bool, bool]]:
    """name, whether it has data, whether it is a folder."""
    n = r.count()
    names, empty, files = [""] * n, [False] * n, []
    while (mark := r.byte()) != END:
        part = _Reader(r.take(r.number()))
        if mark == EMPTY:
            empty = part.bits(n)
        elif mark == EMPTY_FILE:
            files = part.bits(sum(empty))
        elif mark == NAMES:
            part.expect(0)
            names = part.data[1:].decode("utf-16-le", "replace").split("\0")[:n]
    marks = iter(files)
    return [(name, not e, e and not next(marks, False)) for name, e in zip(names, empty)]


def entries(content: bytes) -> list[tuple[str, bytes | Exception, bool]]:
    """name, content (or why it can't be had) and whether it is a folder, of every entry in archive order."""
    if not content.startswith(SIGNATURE) or len(content) < 32:
        raise ConversionError("Split", "no 7z archive")
    at, size, checksum = struct.unpack_from("<QQI", content, 12)
    head = content[32 + at : 32 + at + size]
    if len(head) != size or zlib.crc32(head) != checksum:
        raise ConversionError("Split", "a 7z archive without a whole header")
    if not head:
        return []
    r = _Reader(head)

    def packed(start: int, sizes: list[int], blocks: list[_Block]) -> list[bytes]:
        """The first packed stream of each block."""
        out, k, place = [], 0, 32 + start
        for b in blocks:
            own = sizes[k : k + len(b.packed)]
            out.append(content[place : place + own[0]] if own else b"")
            k, place = k + len(b.packed), place + sum(own)
        return out

    while (mark := r.byte()) == ENCODED:
        where = _streams(r)
        if not where[2]:
            raise ConversionError("Split", "a 7z archive without a header")
        r = _Reader(_unpacked(where[2][0], packed(*where)[0]))
    if mark != HEADER:
        raise ConversionError("Split", "a 7z archive without a header")
    files, where = [], (0, [], [])
    while (mark := r.byte()) != END:
        if mark == PROPERTIES:
            while r.byte() != END:
                r.take(r.number())
        elif mark == MORE_STREAMS:
            _streams(r)
        elif mark == STREAMS:
            where = _streams(r)
        elif mark == FILES:
            files = _files(r)
        else:
            raise ConversionError("Split", f"a 7z header with mark {mark}")

    def contents():
        for b, data in zip(where[2], packed(*where)):
            try:
                whole, fault = _unpacked(b, data), None
            except ConversionError as e:
                whole, fault = b"", e
            except (lzma.LZMAError, zlib.error, OSError, ValueError, IndexError) as e:
                whole, fault = b"", ConversionError("Split", str(e))
            place = 0
            for size, checksum in b.parts:
                one = whole[place : place + size]
                place += size
                broken = checksum is not None and zlib.crc32(one) != checksum
                yield fault or (ConversionError("Split", "an entry whose checksum differs") if broken else one)

    parts = contents()
    return [(name, next(parts, ConversionError("Split", "an entry without data")) if has else b"", folder) for name, has, folder in files]


def split_7z(content: bytes, mode: str = "full") -> list[Fragment]:
    """Entries in archive order, numbered and named as split_zip does."""
    out: list[Fragment] = []
    for place, (name, data, folder) in enumerate(entries(content)):
        if not folder and not (mode == "core" and mac_entry(name)):
            out.append((data, type_of_entry(name), place if mode == "full" else len(out), name if mode == "full" else posixpath.basename(name)))
    return out


def split_7z_archives(df: DataFrame, mode: str = "full") -> DataFrame:
    """df(..., content) to fragments of its 7z archives."""
    return split_documents(df, lambda c: split_7z(c, mode))
