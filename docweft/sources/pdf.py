"""Text lines of PDF pages: objects, object streams, the page tree, and text operators of content streams.

Reads what is needed for lines of text: plain and Flate streams, simple fonts in WinAnsi encoding, and fonts with a
ToUnicode map. Pages without any text give no line; those go to recognition (``packages.page_items``).
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d{1,9})\s+\d{1,5}\s+obj\b(.*?)\bendobj", re.S)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A content stream that inflates to more is not read.
MAX_STREAM = 64 << 20


def _stream(body: bytes) -> bytes:
    at = body.find(b"stream")
    if at < 0:
        return b""
    data = body[at + 6 :].lstrip(b"\r").removeprefix(b"\n")
    data = data[: data.rfind(b"endstream")]
    if b"/FlateDecode" not in body[:at]:
        return data.rstrip(b"\r\n")
    try:
        return zlib.decompressobj().decompress(data, MAX_STREAM)
    except zlib.error:
        return b""


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body[:400]:
            inner = _stream(body)
            first = re.search(rb"/First\s+(\d+)", body)
            if first and inner:
                numbers = [int(x) for x in inner[: int(first[1])].split()]
                starts = numbers[1::2] + [len(inner) - int(first[1])]
                for n, a, b in zip(numbers[::2], starts, starts[1:], strict=False):
                    found.setdefault(n, inner[int(first[1]) + a : int(first[1]) + b])
    return found


def _refs(value: bytes) -> list[int]:
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R\b", value)]


def _entry(body: bytes, name: bytes) -> bytes:
    """The raw value of a dictionary's entry: an array, a dictionary, or up to the next name."""
    m = re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|<<.*?>>|[^/>\[]+)", body.split(b"stream", 1)[0], re.S)
    return m[1] if m else b""


def _pages(objects: dict[int, bytes]) -> list[int]:
    root = next((n for n, b in objects.items() if re.search(rb"/Type\s*/Catalog\b", b)), None)
    order: list[int] = []
    todo, seen = (_refs(_entry(objects[root], b"Pages")) if root is not None else []), set()
    while todo:
        n = todo.pop(0)
        if n in seen or n not in objects:
            continue
        seen.add(n)
        if re.search(rb"/Type\s*/Pages\b", objects[n]) or b"/Kids" in objects[n]:
            todo = _refs(_entry(objects[n], b"Kids")) + todo
        else:
            order.append(n)
    return order or sorted(n for n, b in objects.items() if re.search(rb"/Type\s*/Page\b", b))


def _unicode_map(stream: bytes) -> dict[int, str]:
    text = lambda x: bytes.fromhex(x.decode()).decode("utf-16-be", "replace")
    out: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            low, high, first = int(a, 16), int(b, 16), int(c, 16)
            out |= {low + k: chr(first + k) for k in range(min(high - low + 1, 65536)) if first + k < 0x110000}
    return out


def _fonts(page: bytes, objects: dict[int, bytes]) -> dict[bytes, dict[int, str]]:
    resources = page
    if not re.search(rb"/Font\b", page) and (refs := _refs(_entry(page, b"Resources"))):
        resources = objects.get(refs[0], b"")
    fonts = re.search(rb"/Font\s*(<<.*?>>|\d+\s+\d+\s+R)", resources, re.S)
    body = objects.get(_refs(fonts[1])[0], b"") if fonts and not fonts[1].startswith(b"<<") else fonts[1] if fonts else b""
    out = {}
    for name, ref in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", body):
        to = _refs(_entry(objects.get(int(ref), b""), b"ToUnicode"))
        out[name] = _unicode_map(_stream(objects.get(to[0], b""))) if to else {}
    return out


def _string(token: bytes, font: dict[int, str]) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\(\r?\n|[0-7]{1,3}|.)", lambda m: b"" if m[1][-1:] == b"\n" else bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    if font and max(font) > 255 or (font and token[:1] == b"<" and len(raw) % 2 == 0):
        return "".join(font.get(int.from_bytes(raw[i : i + 2], "big"), "") for i in range(0, len(raw), 2))
    return "".join(font.get(b) or bytes([b]).decode("cp1252", "replace") for b in raw)


def _lines(stream: bytes, fonts: dict[bytes, dict[int, str]]) -> list[str]:
    lines, current, font, stack = [], "", {}, []
    for m in _TOKEN.finditer(stream):
        token = m[0]
        if token[:1] in b"(<[]/" or re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            stack.append(token)
            continue
        if token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                lines.append(current)
                current = ""
            for x in stack:
                if x[:1] in b"(<":
                    current += _string(x, font)
                elif re.fullmatch(rb"-\d*\.?\d+", x) and token == b"TJ" and float(x) < -200:
                    current += " "
        elif token == b"Tf":
            font = fonts.get(next((x[1:] for x in stack if x[:1] == b"/"), b""), {})
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET", b"BT") and (token != b"Td" or (len(stack) >= 2 and float(stack[-1]) != 0)):
            lines.append(current)
            current = ""
        stack = []
    return [x for x in (*lines, current) if x.strip()]


def page_lines(data: bytes) -> list[list[str]]:
    """For each page in order, its lines of text."""
    objects = _objects(data)
    out = []
    for n in _pages(objects):
        contents = _refs(_entry(objects[n], b"Contents"))
        # a reference may lead to an array of streams
        streams = [s for c in contents for s in (_refs(objects.get(c, b"")) if b"stream" not in objects.get(c, b"") else [c])]
        out.append(_lines(b"\n".join(_stream(objects.get(s, b"")) for s in streams), _fonts(objects[n], objects)))
    return out
