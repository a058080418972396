"""RFC 822 mail: body and attachments as fragments; mail to HTML; mail from parts."""

from __future__ import annotations

import email
import email.policy
import html
from email.message import EmailMessage

from pyspark.sql import DataFrame

from docloom.functions.mime import KNOWN, OCTET
from docloom.operators.base import Fragment, split_documents


def _bytes(part) -> bytes:
    data = part.get_payload(decode=True)
    return data if data is not None else b""


def _text(part) -> str:
    return _bytes(part).decode(part.get_content_charset() or "utf-8", "replace")


def _is_attachment(part) -> bool:
    disposition = (part.get("Content-Disposition") or "").split(";")[0].strip()
    return disposition.lower() == "attachment" or disposition == "inline" and part.get_content_maintype() == "image"


def split_mail(content: bytes, with_body: bool = True) -> list[Fragment]:
    """The first text part as the body, named by the subject, and the attachments; or the attachments only."""
    message = email.message_from_bytes(content, policy=email.policy.default)
    out: list[Fragment] = []
    seen_body = not with_body
    for part in message.walk():
        if part.is_multipart():
            continue
        kind = part.get_content_type().lower()
        if _is_attachment(part):
            mime = kind if kind in KNOWN or not with_body else OCTET
            out.append((_bytes(part), mime, len(out), part.get_filename() or f"attachment_{len(out)}"))
        elif not seen_body and kind in ("text/plain", "text/html"):
            seen_body = True
            out.append((_text(part).encode(), kind, len(out), str(message["Subject"] or "body")))
    return out


def mail_to_html(content: bytes) -> str:
    """The first HTML part, else the first text part as preformatted text."""
    message = email.message_from_bytes(content, policy=email.policy.default)
    leaves = [p for p in message.walk() if not p.is_multipart() and not _is_attachment(p)]
    for p in leaves:
        if p.get_content_type() == "text/html":
            return _text(p)
    body = next((_text(p) for p in leaves if p.get_content_type() == "text/plain"), "")
    return f"<html><body><pre>{html.escape(body)}</pre></body></html>"


def mail_to_text(content: bytes) -> str:
    found = split_mail(content)
    return found[0][0].decode("utf-8", "replace") if found and found[0][1].startswith("text/") else ""


def build_mail(subject: str, body: str, attachments: list[tuple[str, bytes]]) -> bytes:
    message = EmailMessage(policy=email.policy.SMTP)
    message["Subject"] = subject
    message.set_content(body, cte="base64")
    for name, data in attachments:
        message.add_attachment(data, maintype="text", subtype="plain", filename=name)
    return message.as_bytes()


def split_mails(df: DataFrame, with_body: bool = True) -> DataFrame:
    return split_documents(df, lambda c: split_mail(c, with_body))
