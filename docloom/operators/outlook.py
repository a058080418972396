"""Outlook messages: compound files read and written, body and attachments as fragments, to HTML, text and mail, and mail to messages.

A compound file is a small file system of storages and streams; a message keeps each property of variable length in a stream named
by the property's number and type, and those of fixed length in one stream of 16-byte entries. A body that is kept only as compressed RTF isn't
read: it is a Resource error in the body's place, the attachments stay.
"""

from __future__ import annotations

import codecs
import email
import email.policy
import email.utils
import hashlib
import html
import struct
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from email.message import EmailMessage

from docloom.functions.mime import OCTET
from docloom.operators.archive import type_of_entry
from docloom.operators.base import ConversionError, Fragment
from docloom.operators.mail import _bytes, _is_attachment, _text

# Fixed values of the compound file format.
MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
DIFAT_SECTOR, FAT_SECTOR, END, FREE = 0xFFFFFFFC, 0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFF
SECTOR, MINI, CUTOFF, HEADER_FATS = 512, 64, 4096, 109
STORAGE, STREAM, ROOT = 1, 2, 5

# Numbers of the properties used here, and of their types.
SUBJECT, TEXT, HTML, RTF = 0x0037, 0x1000, 0x1013, 0x1009
SENDER_NAME, SENDER_ADDRESS, SENDER_SMTP, TO, CC, SENT = 0x0C1A, 0x0C1F, 0x5D01, 0x0E04, 0x0E03, 0x0039
NAME, ADDRESS, SMTP, RECIPIENT_TYPE = 0x3001, 0x3003, 0x39FE, 0x0C15
DATA, SHORT_NAME, LONG_NAME, MIME_TAG, METHOD, NUMBER = 0x3701, 0x3704, 0x3707, 0x370E, 0x3705, 0x0E21
CODE_PAGE, INTERNET_CODE_PAGE = 0x3FFD, 0x3FDE
CLASS, STORE_MASK, FLAGS = 0x001A, 0x340D, 0x0E07
INTEGER, TIME, STRING8, STRING, BINARY = 0x0003, 0x0040, 0x001E, 0x001F, 0x0102
PROPERTIES = "__properties_version1.0"
EPOCH = datetime(1601, 1, 1, tzinfo=timezone.utc)

Tree = dict[str, "bytes | Tree"]


def read_compound(content: bytes) -> Tree:
    """Storages as mappings, streams as bytes."""
    if not content.startswith(MAGIC) or len(content) < SECTOR:
        raise ConversionError("Parse", "no compound file")
    size, mini = 1 << struct.unpack_from("<H", content, 30)[0], 1 << struct.unpack_from("<H", content, 32)[0]
    if size not in (512, 4096) or mini != MINI:
        raise ConversionError("Parse", "sector sizes that compound files don't have")
    first_folder, _, cutoff, first_mini, _, difat = struct.unpack_from("<6I", content, 48)
    fats = list(struct.unpack_from(f"<{HEADER_FATS}I", content, 76))

    def sector(k: int) -> bytes:
        if (k + 1) * size >= len(content):
            raise ConversionError("Parse", "a compound file that ends too soon")
        return content[(k + 1) * size : (k + 2) * size].ljust(size, b"\0")

    def numbers(data: bytes) -> tuple[int, ...]:
        return struct.unpack(f"<{len(data) // 4}I", data)

    seen: set[int] = set()
    while difat < DIFAT_SECTOR and difat not in seen and (difat + 1) * size < len(content):
        seen.add(difat)
        *more, difat = numbers(sector(difat))
        fats += more
    fat = [n for k in fats if k < DIFAT_SECTOR for n in numbers(sector(k))]

    def chain(k: int, table: list[int]) -> list[int]:
        out: list[int] = []
        while k < len(table):
            out.append(k)
            if len(out) > len(table):
                raise ConversionError("Parse", "a chain of sectors that doesn't end")
            k = table[k]
        return out

    def stream(start: int) -> bytes:
        return b"".join(map(sector, chain(start, fat)))

    folder = stream(first_folder)
    entries = [folder[k : k + 128] for k in range(0, len(folder) - 127, 128)]
    if not entries:
        raise ConversionError("Parse", "a compound file without a root")

    def extent(e: bytes) -> tuple[int, int]:
        start, low, high = struct.unpack_from("<III", e, 116)
        return start, low if size == SECTOR else low | high << 32

    small = stream(extent(entries[0])[0])
    mini_fat = [n for k in chain(first_mini, fat) for n in numbers(sector(k))]

    def data(e: bytes) -> bytes:
        start, length = extent(e)
        if length >= cutoff:
            found = stream(start)
        else:
            found = b"".join(small[k * MINI : (k + 1) * MINI] for k in chain(start, mini_fat)) if length else b""
        if len(found) < length:
            raise ConversionError("Parse", "a stream that ends too soon")
        return found[:length]

    root: Tree = {}
    done: set[int] = {0}
    todo = [(struct.unpack_from("<I", entries[0], 76)[0], root)]
    while todo:
        at, into = todo.pop()
        if at >= len(entries) or at in done:
            continue
        done.add(at)
        e = entries[at]
        left, right, child = struct.unpack_from("<III", e, 68)
        name = e[: max(0, min(64, struct.unpack_from("<H", e, 64)[0]) - 2)].decode("utf-16-le", "replace")
        if e[66] == STREAM:
            into[name] = data(e)
        elif e[66] == STORAGE:
            into[name] = inner = {}
            todo.append((child, inner))
        todo += [(left, into), (right, into)]
    return root


def write_compound(root: Tree) -> bytes:
    """A compound file of 512-byte sectors; the same bytes for the same tree."""
    entries: list[list] = [["Root Entry", ROOT, FREE, FREE, FREE, END, 0]]  # name, kind, left, right, child, start, size
    small, large = bytearray(), bytearray()
    mini_fat: list[int] = []
    fat: list[int] = []

    def run(table: list[int], count: int) -> int:
        """Appends a chain of sectors that lie side by side; returns its start."""
        start = len(table)
        table += [*range(start + 1, start + count), END] if count else []
        return start if count else END

    def padded(data: bytes, unit: int) -> bytes:
        return data + b"\0" * (-len(data) % unit)

    def add(name: str, node: bytes | Tree) -> int:
        at = len(entries)
        entries.append([name, STORAGE if isinstance(node, dict) else STREAM, FREE, FREE, FREE, 0 if isinstance(node, dict) else END, 0])
        if isinstance(node, dict):
            entries[at][4] = children(node)
        else:
            entries[at][6] = len(node)
            if len(node) < CUTOFF:
                entries[at][5] = run(mini_fat, -(-len(node) // MINI))
                small.extend(padded(node, MINI))
            else:
                entries[at][5] = run(fat, -(-len(node) // SECTOR))
                large.extend(padded(node, SECTOR))
        return at

    def children(tree: Tree) -> int:
        ids = [add(n, tree[n]) for n in sorted(tree, key=lambda n: (len(n), n.upper()))]

        def balanced(lo: int, hi: int) -> int:
            if lo >= hi:
                return FREE
            mid = (lo + hi) // 2
            entries[ids[mid]][2], entries[ids[mid]][3] = balanced(lo, mid), balanced(mid + 1, hi)
            return ids[mid]

        return balanced(0, len(ids))

    entries[0][4] = children(root)
    entries[0][6] = len(small)
    entries[0][5] = run(fat, -(-len(small) // SECTOR))
    large.extend(padded(bytes(small), SECTOR))
    table = padded(struct.pack(f"<{len(mini_fat)}I", *mini_fat), 4)
    n_mini = -(-len(table) // SECTOR)
    first_mini = run(fat, n_mini)
    large.extend(table + struct.pack("<I", FREE) * ((n_mini * SECTOR - len(table)) // 4))

    def entry(name: str, kind: int, left: int, right: int, child: int, start: int, length: int) -> bytes:
        raw = name.encode("utf-16-le")
        return struct.pack("<64sHBBIII16sI16sIQ", raw, len(raw) + 2, kind, 1, left, right, child, b"", 0, b"", start, length)

    blank = struct.pack("<64sHBBIII16sI16sIQ", b"", 0, 0, 0, FREE, FREE, FREE, b"", 0, b"", 0, 0)
    folder = b"".join(entry(*e) for e in entries) + blank * (-len(entries) % (SECTOR // 128))
    first_folder = run(fat, len(folder) // SECTOR)
    large.extend(folder)

    n_fat = n_difat = 0
    while True:
        need = -(-(len(fat) + n_fat + n_difat) // (SECTOR // 4))
        more = -(-max(0, need - HEADER_FATS) // (SECTOR // 4 - 1))
        if (need, more) == (n_fat, n_difat):
            break
        n_fat, n_difat = need, more
    fat_at = list(range(len(fat), len(fat) + n_fat))
    difat_at = list(range(len(fat) + n_fat, len(fat) + n_fat + n_difat))
    fat += [FAT_SECTOR] * n_fat + [DIFAT_SECTOR] * n_difat
    large.extend(struct.pack(f"<{len(fat)}I", *fat) + struct.pack("<I", FREE) * (n_fat * SECTOR // 4 - len(fat)))
    per = SECTOR // 4 - 1
    for k, _ in enumerate(difat_at):
        part = fat_at[HEADER_FATS + k * per : HEADER_FATS + (k + 1) * per]
        following = difat_at[k + 1] if k + 1 < n_difat else END
        large.extend(struct.pack(f"<{per + 1}I", *part, *[FREE] * (per - len(part)), following))
    listed = fat_at[:HEADER_FATS]
    # of 512-byte sectors: version 3, 2^9 and 2^6 byte sectors, no count of folder sectors
    head = MAGIC + b"\0" * 16 + struct.pack("<5H6x9I", 0x3E, 3, 0xFFFE, 9, 6, 0, n_fat, first_folder, 0, CUTOFF, first_mini, n_mini, difat_at[0] if difat_at else END, n_difat)
    return head + struct.pack(f"<{HEADER_FATS}I", *listed, *[FREE] * (HEADER_FATS - len(listed))) + bytes(large)


class _Properties:
    """The properties of a message, recipient or attachment."""

    def __init__(self, tree: Tree, head: int, codec: str | None = None):
        self.tree = tree
        raw = tree.get(PROPERTIES, b"")
        raw = raw if isinstance(raw, bytes) else b""
        self.fixed = {struct.unpack_from("<I", raw, k)[0]: raw[k + 8 : k + 16] for k in range(head, len(raw) - 15, 16)}
        self.codec = codec or self._codec(CODE_PAGE) or self._codec(INTERNET_CODE_PAGE) or "cp1252"

    def integer(self, number: int) -> int | None:
        raw = self.fixed.get(number << 16 | INTEGER)
        return struct.unpack_from("<i", raw)[0] if raw else None

    def time(self, number: int) -> datetime | None:
        raw = self.fixed.get(number << 16 | TIME)
        try:
            return EPOCH + timedelta(microseconds=struct.unpack("<Q", raw)[0] // 10) if raw else None
        except OverflowError:
            return None

    def _codec(self, number: int) -> str | None:
        page = self.integer(number)
        try:
            return codecs.lookup({65001: "utf-8", 28591: "latin-1", 20127: "ascii"}.get(page, f"cp{page}")).name if page else None
        except LookupError:
            return None

    def data(self, number: int, kind: int) -> bytes | None:
        found = self.tree.get(f"__substg1.0_{number:04X}{kind:04X}")
        return found if isinstance(found, bytes) else None

    def text(self, number: int) -> str | None:
        if (raw := self.data(number, STRING)) is not None:
            return raw.decode("utf-16-le", "replace").rstrip("\0")
        if (raw := self.data(number, STRING8)) is not None:
            return raw.decode(self.codec, "replace").rstrip("\0")
        return None


@dataclass
class Message:
    subject: str | None = None
    text: str | None = None
    html: str | None = None
    rtf_only: bool = False
    sender: tuple[str, str] = ("", "")
    sent: datetime | None = None
    recipients: list[tuple[int, str, str]] = field(default_factory=list)  # 1 to, 2 cc, 3 bcc; name; address
    attachments: list[tuple[str | None, str | None, str | None, bytes]] = field(default_factory=list)  # file name, display name, type, content


def read_message(content: bytes) -> Message:
    """A message; embedded messages and objects are attachments without content."""
    tree = read_compound(content)
    if PROPERTIES not in tree:
        raise ConversionError("Parse", "a compound file that is no message")
    p = _Properties(tree, 32)
    page = p.text(HTML)
    if page is None and (raw := p.data(HTML, BINARY)) is not None:
        page = raw.decode(p._codec(INTERNET_CODE_PAGE) or p.codec, "replace").rstrip("\0")
    out = Message(p.text(SUBJECT), p.text(TEXT), page, sent=p.time(SENT))
    out.rtf_only = out.text is None and page is None and p.data(RTF, BINARY) is not None
    out.sender = (p.text(SENDER_NAME) or "", p.text(SENDER_SMTP) or p.text(SENDER_ADDRESS) or "")
    for name in sorted(tree):
        inner = tree[name]
        if not isinstance(inner, dict):
            continue
        q = _Properties(inner, 8, p.codec)
        if name.startswith("__recip_version1.0_"):
            out.recipients.append(((q.integer(RECIPIENT_TYPE) or 1) & 3, q.text(NAME) or "", q.text(SMTP) or q.text(ADDRESS) or ""))
        elif name.startswith("__attach_version1.0_"):
            out.attachments.append((q.text(LONG_NAME) or q.text(SHORT_NAME), q.text(NAME), q.text(MIME_TAG), q.data(DATA, BINARY) or b""))
    return out


def _unread(m: Message) -> ConversionError | None:
    return ConversionError("Resource", "no reader for a body in RTF only") if m.rtf_only else None


def split_message(content: bytes, with_body: bool = True) -> list[Fragment]:
    """The body, named by the subject, and the attachments; or the attachments only, by their display names.

    The body is the plain text, else the HTML; its type is HTML if the message has an HTML body, whichever is put out.
    """
    m = read_message(content)
    out: list[Fragment] = []
    body = m.text if m.text is not None else m.html
    subject = m.subject if m.subject is not None else "body"
    if with_body and (fault := _unread(m)):
        out.append((fault, "text/rtf", 0, subject))
    elif with_body and body:
        out.append((body.encode(), "text/html" if m.html is not None else "text/plain", 0, subject))
    for file, display, _, data in m.attachments:
        name = (file if with_body else display or file) or f"attachment_{len(out)}"
        out.append((data, type_of_entry(name) if with_body or "." in name else OCTET, len(out), name))
    return out


def to_html(content: bytes) -> str:
    m = read_message(content)
    if fault := _unread(m):
        raise fault
    return m.html if m.html is not None else f"<html><body><pre>{html.escape(m.text or '')}</pre></body></html>"


def to_text(content: bytes) -> str:
    m = read_message(content)
    if fault := _unread(m):
        raise fault
    return m.text if m.text is not None else m.html or ""


def _line(value: str) -> str:
    return " ".join(value.split())


def to_mail(content: bytes) -> bytes:
    """The message as RFC 822 mail; the same bytes for the same message."""
    m = read_message(content)
    if fault := _unread(m):
        raise fault
    out = EmailMessage(policy=email.policy.SMTP)
    out["Subject"] = _line(m.subject or "")
    if any(m.sender):
        out["From"] = email.utils.formataddr(tuple(map(_line, m.sender)))
    for kind, header in ((1, "To"), (2, "Cc"), (3, "Bcc")):
        if found := [email.utils.formataddr((_line(n), _line(a))) for k, n, a in m.recipients if k == kind]:
            out[header] = ", ".join(found)
    if m.sent:
        out["Date"] = email.utils.format_datetime(m.sent)
    if m.text is not None or m.html is None:
        out.set_content(m.text or "", cte="base64")
        if m.html is not None:
            out.add_alternative(m.html, subtype="html", cte="base64")
    else:
        out.set_content(m.html, subtype="html", cte="base64")
    for k, (file, display, tag, data) in enumerate(m.attachments):
        name = _line(file or display or f"attachment_{k}")
        main, _, sub = (tag if tag and tag.count("/") == 1 and not tag.startswith(("multipart/", "message/")) else type_of_entry(name)).partition("/")
        out.add_attachment(data, maintype=main, subtype=sub, filename=name)
    mark = hashlib.sha1(content).hexdigest()
    for k, part in enumerate(out.walk()):
        if part.is_multipart():
            part.set_boundary(f"=_{k}_{mark}")
    return out.as_bytes()


def _storage(values: dict[tuple[int, int], object], head: bytes) -> Tree:
    """A storage of properties, by (number, type)."""
    tree: Tree = {}
    rows = []
    for (number, kind), value in sorted(values.items()):
        if value is None:
            continue
        tag = number << 16 | kind
        if kind in (STRING, BINARY):
            raw = value.encode("utf-16-le") if kind == STRING else value
            tree[f"__substg1.0_{number:04X}{kind:04X}"] = raw
            rows.append(struct.pack("<IIII", tag, 6, len(raw) + (2 if kind == STRING else 0), 0))
        else:
            rows.append(struct.pack("<IIq", tag, 6, value))
    tree[PROPERTIES] = head + b"".join(rows)
    return tree


def from_mail(content: bytes) -> bytes:
    """RFC 822 mail as an Outlook message: subject, sender, recipients, date, bodies and attachments."""
    mail = email.message_from_bytes(content, policy=email.policy.default)
    leaves = [p for p in mail.walk() if not p.is_multipart()]
    attached = [p for p in leaves if _is_attachment(p)]
    body = {k: next((_text(p) for p in leaves if p.get_content_type() == k and not _is_attachment(p)), None) for k in ("text/plain", "text/html")}
    people = [(kind, name, address) for kind, header in ((1, "To"), (2, "Cc"), (3, "Bcc")) for name, address in email.utils.getaddresses([str(v) for v in mail.get_all(header, [])])]
    name, address = email.utils.parseaddr(str(mail["From"] or ""))
    try:
        sent = email.utils.parsedate_to_datetime(str(mail["Date"])) if mail["Date"] else None
    except ValueError:
        sent = None
    if sent is not None and sent.tzinfo is None:
        sent = sent.replace(tzinfo=timezone.utc)
    shown = lambda k: "; ".join(n or a for t, n, a in people if t == k) or None
    html_body = body["text/html"]
    root = _storage(
        {
            (CLASS, STRING): "IPM.Note", (SUBJECT, STRING): str(mail["Subject"]) if mail["Subject"] is not None else None, (TEXT, STRING): body["text/plain"],
            (HTML, BINARY): html_body.encode() if html_body is not None else None, (INTERNET_CODE_PAGE, INTEGER): 65001, (STORE_MASK, INTEGER): 0x40000, (FLAGS, INTEGER): 0x11 if attached else 0x01,
            (SENDER_NAME, STRING): name or address or None, (SENDER_ADDRESS, STRING): address or None, (SENDER_SMTP, STRING): address or None,
            (TO, STRING): shown(1), (CC, STRING): shown(2), (SENT, TIME): (sent - EPOCH) // timedelta(microseconds=1) * 10 if sent else None,
        },
        struct.pack("<8xIIII8x", len(people), len(attached), len(people), len(attached)),
    )
    root["__nameid_version1.0"] = {f"__substg1.0_{k:04X}0102": b"" for k in (2, 3, 4)}
    for k, (kind, who, at) in enumerate(people):
        root[f"__recip_version1.0_#{k:08X}"] = _storage({(NAME, STRING): who or at, (ADDRESS, STRING): at, (SMTP, STRING): at, (RECIPIENT_TYPE, INTEGER): kind}, b"\0" * 8)
    for k, part in enumerate(attached):
        file = part.get_filename() or f"attachment_{k}"
        root[f"__attach_version1.0_#{k:08X}"] = _storage({(DATA, BINARY): _bytes(part), (LONG_NAME, STRING): file, (SHORT_NAME, STRING): file, (NAME, STRING): file, (MIME_TAG, STRING): part.get_content_type(), (METHOD, INTEGER): 1, (NUMBER, INTEGER): k}, b"\0" * 8)
    return write_compound(root)
