"""WARC archives: writer, monolithic gzip normaliser, reader.

The writer makes files that are one gzip stream each, as crawlers that compress whole files do.
The normaliser inflates such a stream once, chunk by chunk, finds the records by their
Content-Length, writes each as a gzip member of its own and a sidecar index (record number, offset,
length, record id). The reader goes to each record by its offset in the index.

Files go to the shared folder, never to a machine's own disk: each is written under a name of its attempt
and renamed when complete, so that a repeated task replaces whole files with the same content.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the largest id is the
response and the others revisit it; a revisit keeps the payload's digest and, in its HTTP
header, its length, but no payload.

Defined cases: a null payload is empty; an empty table gives no archives and no rows; a repeated id
gives a record for each of its rows (responses, if that id is the largest of their
payload); a null id is kept, and is never the one referred to; other columns are not archived.
"""

from __future__ import annotations

import base64
import contextlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from docloom.llm.common import cut, key_side, map_rows, shared_dir, slices

MIN_REVISIT = 1000
CHUNK = 1 << 18
NO_ID = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


# --- files -----------------------------------------------------------------------------------


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def open_input(path: str):
    if local := _local(path):
        return open(local, "rb")
    store, inner = _store(path)
    return store.open_input_file(inner)


def open_output(path: str):
    if local := _local(path):
        os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, "wb")
    store, inner = _store(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    return store.open_output_stream(inner)


def publish(tmp: str, path: str) -> None:
    if local := _local(path):
        os.replace(_local(tmp), local)
    else:
        store, inner = _store(path)
        store.move(_store(tmp)[1], inner)


def remove(path: str) -> None:
    """A file that is gone already stays gone: tasks may be repeated."""
    with contextlib.suppress(FileNotFoundError):
        if local := _local(path):
            os.remove(local)
        else:
            store, inner = _store(path)
            store.delete_file(inner)


# --- records ---------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, n_bytes: int, sha1_hex: str, refers_to: int | None) -> bytes:
    """One uncompressed record; a revisit if refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1_hex)).decode()}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def number(urn: str) -> int | None:
    digits = urn.strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = parse_head(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {
        "page_id": number(fields["warc-record-id"]), "record_type": fields["warc-type"], "payload": payload,
        "payload_bytes": int(parse_head(http)["content-length"]),
        "payload_digest": base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex(),
        "refers_to": number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
    }


def inflated(source) -> Iterator[bytes]:
    """Chunks of the inflated stream, across members if there are several; memory stays within a few chunks."""
    more = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while data:
            out = more.decompress(data, CHUNK)
            if out:
                yield out
            if more.eof:
                data, more = more.unused_data, zlib.decompressobj(31)
            else:
                data = more.unconsumed_tail
    if out := more.flush():
        yield out


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream, one at a time."""
    buffer = bytearray()
    ended = False

    def fill(n: int) -> bool:
        nonlocal ended
        while len(buffer) < n and not ended:
            piece = next(chunks, None)
            if piece is None:
                ended = True
            else:
                buffer.extend(piece)
        return len(buffer) >= n

    while fill(1):
        end, seen = -1, 0
        while end < 0:
            end = buffer.find(b"\r\n\r\n", max(0, seen - 3))
            seen = len(buffer)
            if end < 0 and not fill(seen + 1):
                raise ValueError("the archive ends inside a header")
        total = end + 4 + int(parse_head(bytes(buffer[:end]))["content-length"]) + 4
        if not fill(total):
            raise ValueError("the archive ends inside a record")
        yield bytes(buffer[:total])
        del buffer[:total]


def normalise(source, target, index) -> int:
    """Rewrites one archive, record by record, as members of their own, and writes its index: 24 bytes a record."""
    at = n = 0
    for raw in records(inflated(source)):
        press = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = press.compress(raw) + press.flush()
        target.write(member)
        page_id = number(parse_head(raw[: raw.index(b"\r\n\r\n")])["warc-record-id"])
        index.write(struct.pack("<qqq", NO_ID if page_id is None else page_id, at, len(member)))
        at += len(member)
        n += 1
    return n


def read_index(index) -> Iterator[tuple[int | None, int, int]]:
    while entry := index.read(24):
        page_id, offset, length = struct.unpack("<qqq", entry)
        yield None if page_id == NO_ID else page_id, offset, length


# --- tables ----------------------------------------------------------------------------------


def _attempt(path: str) -> str:
    context = TaskContext.get()
    return f"{path}.{context.taskAttemptId() if context else 0}-{uuid.uuid4().hex[:8]}.tmp"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every row as a record, an archive per partition; returns (path, records) of the archives, already written."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    full = pages.select("page_id", "url", body.alias("payload"), F.length(body).cast("long").alias("n_bytes"), F.sha1(body).alias("digest"))
    # only ids, lengths and digests are grouped and joined; payloads stay with their rows as long as the revisits can be broadcast
    slim = full.select("page_id", "n_bytes", "digest").where(F.col("n_bytes") >= MIN_REVISIT)
    newest = cut(slim.groupBy("digest", "n_bytes").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").select("digest", "n_bytes", "newest"))
    older = slim.join(key_side(newest), ["digest", "n_bytes"]).where("page_id IS NULL OR page_id <> newest")
    revisits = key_side(cut(older.select(F.col("page_id").alias("older_id"), F.col("digest").alias("older_digest"), "newest").distinct()))
    same = full["page_id"].eqNullSafe(F.col("older_id")) & (full["digest"] == F.col("older_digest"))
    typed = full.join(revisits, same, "left").select("page_id", "url", "payload", "n_bytes", "digest", F.col("newest").alias("refers_to"))

    def write(batches):
        import pyarrow as pa

        path = f"{folder}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        out, press, n = None, zlib.compressobj(6, zlib.DEFLATED, 31), 0
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = open_output(tmp := _attempt(path))
                out.write(press.compress(record(*row)))
                n += 1
        if out is not None:
            out.write(press.flush())
            out.close()
            publish(tmp, path)
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    return cut(typed.mapInArrow(write, "path string, records long"))


def normalise_archives(archives: DataFrame, drop_source: bool = False) -> DataFrame:
    """(path, index_path, records) of the normalised archives; one archive is handled by one task."""

    def run(cols):
        for path in cols[0]:
            to, index = path.removesuffix(".warc.gz") + ".members.warc.gz", path.removesuffix(".warc.gz") + ".index"
            tmp, tmp_index = _attempt(to), _attempt(index)
            with open_input(path) as a, open_output(tmp) as b, open_output(tmp_index) as c:
                n = normalise(a, b, c)
            publish(tmp_index, index)
            publish(tmp, to)
            yield {"path": [to], "index_path": [index], "records": [n]}

    done = cut(map_rows(_spread(archives.select("path")), run, "path string, index_path string, records long"))
    if drop_source:
        _spread(archives.select("path")).foreach(lambda r: remove(r.path))
    return done


def _spread(paths: DataFrame) -> DataFrame:
    """An archive to a task, about; paths are few and short."""
    return paths.repartition(max(1, min(10_000, paths.count())), "path")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, each read at its offset in the index."""

    def run(cols):
        for path, index_path in zip(*cols):
            out: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
            with open_input(path) as a, open_input(index_path) as i:
                for page_id, offset, length in read_index(i):
                    a.seek(offset)
                    found = parse_record(zlib.decompress(a.read(length), 31))
                    if found["page_id"] != page_id:
                        raise ValueError(f"{index_path} doesn't fit {path}")
                    if found["record_type"] == "response":
                        verify(found)
                    for k, v in out.items():
                        v.append(found[k])
            yield out

    return map_rows(_spread(archives.select("path", "index_path")), run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def verify(found: dict) -> None:
    import hashlib

    if len(found["payload"]) != found["payload_bytes"] or hashlib.sha1(found["payload"]).hexdigest() != found["payload_digest"]:
        raise ValueError(f"the payload of {found['page_id']} doesn't fit its header")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes, normalises and reads back; the archives stay in the shared folder, as they are the operator's output."""
    folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_archives(normalise_archives(write_archives(pages, folder), drop_source=True))
