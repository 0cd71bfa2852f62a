"""Mail messages as MIME parts and as one chapter."""

from __future__ import annotations

import email
import email.policy
from email.header import decode_header, make_header
from email.message import Message

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.functions import markdown as md
from foliant.functions.arrow import map_rows
from foliant.functions.html_markdown import Block, Refusal, render_html

PARTS, DEPTH = 1024, 64
#: Headers of a chapter, in order.
HEADERS = ("From", "To", "Cc", "Bcc", "Reply-To", "Date", "Subject", "Message-ID")
MIME_PARTS = T.StructType(
    [
        T.StructField("source_id", T.LongType()),
        T.StructField("mime_path", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("media_type", T.StringType()),
        T.StructField("charset", T.StringType()),
        T.StructField("transfer", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("disposition", T.StringType()),
        T.StructField("content_id", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def header_text(value: str) -> str:
    try:
        return " ".join(str(make_header(decode_header(value))).split())
    except (UnicodeDecodeError, LookupError, ValueError) as exc:
        raise Refusal(f"mail header unreadable: {exc}") from exc


def parts_of(raw: bytes) -> list[tuple[str, int, Message]]:
    """(path, depth, part) in document order."""
    out: list[tuple[str, int, Message]] = []
    stack = [("1", 1, email.message_from_bytes(raw, policy=email.policy.compat32))]
    while stack:
        path, depth, part = stack.pop()
        out.append((path, depth, part))
        if len(out) > PARTS or depth > DEPTH:
            raise Refusal(f"MIME limit exceeded: {PARTS} parts, depth {DEPTH}")
        if part.is_multipart():
            stack += [(f"{path}.{i}", depth + 1, p) for i, p in reversed(list(enumerate(part.get_payload(), 1)))]
    return out


def _text(part: Message) -> str:
    raw = part.get_payload(decode=True) or b""
    try:
        return raw.decode(part.get_content_charset() or "utf-8")
    except (UnicodeDecodeError, LookupError) as exc:
        raise Refusal(f"mail text unreadable: {exc}") from exc


def eml_units(raw: bytes) -> list[tuple[str, list[Block]]]:
    """One chapter: headers, the plain body in a fence or else the HTML body as blocks, then attachment names."""
    parts = parts_of(raw)
    message = parts[0][2]
    blocks = [
        Block("text", [f"{name}: {md.escape(header_text(v))}"]) for name in HEADERS for v in message.get_all(name, [])
    ]
    bodies = [p for _, _, p in parts if not p.is_multipart() and p.get_content_disposition() != "attachment" and not p.get_filename()]
    plain = next((p for p in bodies if p.get_content_type() == "text/plain"), None)
    html = next((p for p in bodies if p.get_content_type() == "text/html"), None)
    if plain is not None:
        text = _text(plain).replace("\r\n", "\n").rstrip("\n")
        if text:
            blocks.append(Block("fence", text.split("\n")))
    elif html is not None:
        blocks += render_html(_text(html)).blocks
    names = [p.get_filename() or "unnamed" for _, _, p in parts if not p.is_multipart() and (p.get_content_disposition() == "attachment" or p.get_filename())]
    blocks += [Block("text", [f"Attachment: {md.escape(header_text(n))}"]) for n in names]
    return [(header_text(message.get("Subject", "") or "") or "Message", blocks)]


def mime_parts(sources: DataFrame) -> DataFrame:
    def rows(source_id: int, content: bytes | None):
        try:
            found = parts_of(content or b"")
        except Refusal:
            return
        for path, depth, p in found:
            payload = None if p.is_multipart() else p.get_payload(decode=True)
            yield (
                source_id, path, depth, p.get_content_type(), p.get_content_charset(), p.get("Content-Transfer-Encoding"), p.get_filename(), p.get_content_disposition(), p.get("Content-ID"), payload,
            )

    return map_rows(sources.select("source_id", "content"), MIME_PARTS, rows)
