"""Text of PDF files without a library: pages in the order of the page tree, their content streams and text operators.

Read are plain and Flate-compressed streams, object streams, literal and hexadecimal strings, and the ToUnicode maps of
fonts. Other compressions, encrypted files and images are not; such a page has no text. A stream is unpacked up to
MOST bytes, so a small file cannot fill a worker's memory.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from docslice.operators.kernel import chunk_rows

MOST = 64 << 20
OBJECT = re.compile(rb"(?:^|[\s>])(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj\b", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _unpacked(body: bytes) -> bytes:
    m = STREAM.search(body)
    if not m:
        return b""
    head, data = body[: m.start()], m[1]
    if b"/FlateDecode" not in head:
        return data if b"/Filter" not in head else b""
    try:
        return zlib.decompressobj().decompress(data, MOST)
    except zlib.error:
        return b""


def objects(data: bytes) -> dict[int, bytes]:
    """Bodies of all objects by number, those in object streams included; later ones replace earlier ones."""
    out = {int(m[1]): m[3] for m in OBJECT.finditer(data)}
    for body in list(out.values()):
        if b"/ObjStm" in body:
            first = re.search(rb"/First\s+(\d+)", body)
            inner = _unpacked(body)
            if first and inner:
                at = int(first[1])
                numbers = [int(x) for x in inner[:at].split()]
                pairs = list(zip(numbers[::2], numbers[1::2], strict=False))
                for k, (n, a) in enumerate(pairs):
                    z = pairs[k + 1][1] if k + 1 < len(pairs) else len(inner) - at
                    out.setdefault(n, inner[at + a : at + z])
    return out


def _references(body: bytes, name: bytes) -> list[int]:
    m = re.search(name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def pages(found: dict[int, bytes]) -> list[int]:
    """Numbers of the pages in their order; of all page objects if there is no tree."""
    roots = [n for n, b in found.items() if re.search(rb"/Type\s*/Pages\b", b) and b"/Parent" not in b]
    out: list[int] = []
    stack, seen = list(reversed(sorted(roots)[:1])), set()
    while stack:
        n = stack.pop()
        if n in seen or n not in found:
            continue
        seen.add(n)
        if kids := _references(found[n], rb"/Kids"):
            stack += reversed(kids)
        elif re.search(rb"/Type\s*/Page\b", found[n]):
            out.append(n)
    return out or [n for n, b in sorted(found.items()) if re.search(rb"/Type\s*/Page\b", b)]


def unicode_map(stream: bytes) -> dict[bytes, str]:
    """Characters of codes by a ToUnicode map."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[bytes, str] = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            out[bytes.fromhex(a.decode())] = text(b)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.S):
        for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            for k in range(min(int(z, 16) - int(a, 16) + 1, 65536)):
                start = text(b)
                out[(int(a, 16) + k).to_bytes(len(a) // 2, "big")] = start[:-1] + chr(ord(start[-1]) + k)
    return out


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    body = re.sub(rb"\\\r?\n", b"", token[1:-1])
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else ESCAPES.get(m[1], m[1]), body, flags=re.S)


def _decoded(raw: bytes, own: dict[bytes, str]) -> str:
    if not own:
        return raw.decode("utf-16-be", "replace")[1:] if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
    width = max(map(len, own))
    return "".join(own.get(raw[i : i + width], "") for i in range(0, len(raw), width))


def content_text(stream: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    """Text of a content stream; operators that move to another line give a line end."""
    out: list[str] = []
    held: list[bytes] = []
    own: dict[bytes, str] = {}
    for token in TOKEN.findall(stream):
        if token[:1] in b"(<[]/+-.0123456789":
            held.append(token)
            continue
        strings = [x for x in held if x[:1] in b"(<"]
        if token == b"Tf" and held:
            own = fonts.get(next((x for x in held if x[:1] == b"/"), b""), {})
        elif token in (b"Td", b"TD") and len(held) > 1 and float(held[-1]) != 0 or token in (b"T*", b"Tm", b"ET"):
            out.append("\n")
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                out.append("\n")
            for x in held:
                if x[:1] in b"(<":
                    out.append(_decoded(_string(x), own))
                elif token == b"TJ" and x[:1] not in b"[]/" and float(x) < -200 and strings:
                    out.append(" ")
        held = []
    return re.sub(r"\n+", "\n", "".join(out)).strip()


def page_texts(data: bytes | None) -> Iterator[str]:
    found = objects(data or b"")
    maps = {n: unicode_map(_unpacked(found[r[0]])) for n, b in found.items() if (r := _references(b, rb"/ToUnicode")) and r[0] in found}
    for n in pages(found):
        body = found[n]
        for r in _references(body, rb"/Resources"):
            body += found.get(r, b"")
        names = re.search(rb"/Font\s*<<(.*?)>>", body, re.S)
        if not names and (r := re.search(rb"/Font\s+(\d+)\s+\d+\s+R", body)):
            names = re.match(rb"(.*)", found.get(int(r[1]), b""), re.S)
        fonts = {f: maps.get(int(k), {}) for f, k in re.findall(rb"(/[^\s/<>]+)\s+(\d+)\s+\d+\s+R", names[1])} if names else {}
        yield content_text(b"\n".join(_unpacked(found[c]) for c in _references(found[n], rb"/Contents") if c in found), fonts)


def _by_page(data: bytes | None, per_chunk: int, most: int | None) -> Iterator[tuple]:
    texts = list(page_texts(data))
    for a in range(0, len(texts), per_chunk):
        text = "\n\n".join(t for t in texts[a : a + per_chunk] if t)
        pieces = [text[i : i + most] for i in range(0, len(text), most)] if most and len(text) > most else [text]
        for piece in pieces:
            if piece:
                yield piece, a + 1, min(a + per_chunk, len(texts))


def pdf_pages(files: DataFrame, per_chunk: int = 1, most: int | None = None, content: str = "content", key: str = "path") -> DataFrame:
    """key, chunk_index, content, size, first_page, last_page: pages in chunks of `per_chunk`, cut at `most` characters."""
    from functools import partial

    return chunk_rows(files, partial(_by_page, per_chunk=per_chunk, most=most), [content], "first_page int, last_page int", key)
