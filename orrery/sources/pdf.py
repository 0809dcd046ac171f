"""The text of simple PDF files, page by page, without a library: objects are found
by their markers, content streams are inflated, and strings shown between BT and ET
are joined. Encrypted files, object streams and fonts with codes of their own are
beyond it; a library's extractor may be given in its place."""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?\d*\.?\d+|/[^\s/()<>\[\]]*|[A-Za-z'\"*]+", re.S)
_ESCAPED = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:

        def plain(m: re.Match) -> bytes:
            x = m[1]
            if x[:1] in b"01234567":
                return bytes([int(x, 8) & 255])
            return b"" if x in (b"\n", b"\r", b"\r\n") else _NAMED.get(x, x)

        data = _ESCAPED.sub(plain, token[1:-1])
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


def _shown(content: bytes) -> str:
    """What a content stream's text operators show; moves to another line break one."""
    out: list[str] = []
    for block in re.findall(rb"\bBT\b(.*?)\bET\b", content, re.S):
        held: list[bytes] = []
        for m in _SHOWN.finditer(block):
            token = m[0]
            if token[:1] in b"(<":
                held.append(token)
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                if token in (b"'", b'"') and out:
                    out.append("\n")
                out += [_string(t) for t in held]
                held = []
            elif token in (b"Td", b"TD", b"T*", b"Tm"):
                if out and out[-1] != "\n":
                    out.append("\n")
                held = []
        if out and out[-1] != "\n":
            out.append("\n")
    return "".join(out).removesuffix("\n")


def pages(data: bytes) -> list[str]:
    """The text of each page, in the order of the page objects."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    found = []
    for body in objects.values():
        if not re.search(rb"/Type\s*/Page\b(?!s)", body):
            continue
        refs = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|(\d+\s+\d+\s+R))", body)
        parts = []
        for ref in re.findall(rb"(\d+)\s+\d+\s+R", refs[1] or refs[2]) if refs else []:
            stream = _STREAM.match(objects.get(int(ref), b""))
            if stream:
                parts.append(zlib.decompress(stream[2]) if b"FlateDecode" in stream[1] else stream[2])
        found.append(_shown(b"\n".join(parts)))
    return found
