"""Text of PDF pages. Objects are found by scanning the file, so a damaged cross-reference table does not matter.

Read are Flate streams, object streams, inherited resources, the text operators, and character maps
(ToUnicode); simple fonts without one are Windows-1252. Text inside form objects and other filters
are not read: a page that needs another filter, like an encrypted file, is an error.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

_TOKEN = re.compile(rb"(?:\s|\x00|%[^\r\n]*)*(<<|>>|\[|\]|\(|<[0-9A-Fa-f\s]*>|/[^\s\x00()<>\[\]{}/%]*|[^\s\x00()<>\[\]{}/%]+|[{}])")
_INDIRECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
_STREAM = re.compile(rb"\s*stream\r?\n")
_IMAGE = re.compile(rb"(?s)\bBI\s*/.*?\sEI\b")
_LITERAL = re.compile(rb"(?s)[^()\\]+|\\[0-7]{1,3}|\\\r\n|\\.|[()]")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
#: A shift between the strings of one TJ that counts as a blank, in thousandths of the font size.
_GAP = -200


class _Ref(int):
    """The number of an object that is meant."""


class _Operator(str):
    pass


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth = [], 1
    for m in _LITERAL.finditer(data, at):
        t = m.group()
        depth += (t == b"(") - (t == b")")
        if not depth:
            return b"".join(out), m.end()
        if t[:1] != b"\\":
            out.append(t)
        elif t[1:2].isdigit() and t[1:2] < b"8":
            out.append(bytes([int(t[1:], 8) & 255]))
        else:
            out.append(_ESCAPES.get(t[1:], t[1:]))
    raise ValueError("a string without end")


def _values(data: bytes, at: int = 0) -> Iterator[tuple]:
    """(value, where it ends): names are str, strings are bytes; operators and references are types of their own."""
    nested: list[tuple[bytes, list]] = []
    while m := _TOKEN.match(data, at):
        t, at = m.group(1), m.end()
        if t in (b"<<", b"["):
            nested.append((t, []))
            continue
        if t in (b">>", b"]"):
            if not nested:
                continue
            kind, items = nested.pop()
            value = items if kind == b"[" else dict(zip(items[::2], items[1::2], strict=False))
        elif t == b"(":
            value, at = _literal(data, at)
        elif t[:1] == b"<":
            digits = b"".join(t[1:-1].split())
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif t[:1] == b"/":
            value = t.decode("latin-1")
        else:
            try:
                value = float(t) if b"." in t else int(t)
            except ValueError:
                value = _Operator(t.decode("latin-1"))
        if nested and isinstance(value, _Operator) and value == "R" and len(nested[-1][1]) > 1:
            nested[-1][1][-2:] = [_Ref(nested[-1][1][-2])]
        elif nested:
            nested[-1][1].append(value)
        else:
            yield value, at


class _File:
    """The objects of a file by number; a later definition replaces an earlier one."""

    def __init__(self, data: bytes) -> None:
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        at = 0
        while m := _INDIRECT.search(data, at):
            value, at = next(_values(data, m.end()), (None, m.end()))
            self.objects[int(m.group(1))] = value
            if isinstance(value, dict) and (s := _STREAM.match(data, at)):
                size = value.get("/Length")
                end = s.end() + size if type(size) is int and data[s.end() + size :].lstrip()[:9] == b"endstream" else data.find(b"endstream", s.end())
                end = len(data) if end < 0 else end
                self.streams[int(m.group(1))], at = data[s.end() : end], end
        if not self.objects or re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("no objects" if not self.objects else "encrypted")
        for n in [n for n, v in self.objects.items() if isinstance(v, dict) and v.get("/Type") == "/ObjStm"]:
            body, head = self.stream(n), self.objects[n]
            numbers = [int(x) for x in body[: self.get(head["/First"])].split()]
            for k, offset in zip(numbers[::2], numbers[1::2], strict=False):
                self.objects.setdefault(k, next(_values(body, self.get(head["/First"]) + offset), (None,))[0])

    def get(self, value):
        for _ in range(20):  # references to references
            if not isinstance(value, _Ref):
                break
            value = self.objects.get(int(value))
        return value

    def stream(self, n: int) -> bytes:
        filters = self.get(self.objects[n].get("/Filter")) or []
        data = self.streams.get(n, b"")
        for f in filters if isinstance(filters, list) else [filters]:
            if self.get(f) != "/FlateDecode":
                raise ValueError(f"filter {f}")
            data = zlib.decompressobj().decompress(data)
        return data

    def pages(self) -> Iterator[dict]:
        """Pages in reading order, with the resources they inherit."""
        roots = [v for v in self.objects.values() if isinstance(v, dict) and v.get("/Type") == "/Catalog"]
        if not roots:
            raise ValueError("no catalog")
        rest, seen = [(roots[-1].get("/Pages"), None)], set()
        while rest:
            ref, inherited = rest.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, _Ref) and int(ref) in seen):
                continue
            seen.add(int(ref) if isinstance(ref, _Ref) else None)
            resources = node.get("/Resources", inherited)
            if "/Kids" in node:
                rest += [(k, resources) for k in reversed(self.get(node["/Kids"]) or [])]
            else:
                yield node | {"/Resources": resources}


class _Font:
    """Codes of a font to text, by its character map."""

    def __init__(self, file: _File, font: dict) -> None:
        self.width = 2 if font.get("/Subtype") == "/Type0" else 1
        ref = font.get("/ToUnicode")
        self.ranges: list[tuple[int, int, list[bytes] | bytes]] | None = None
        self.known: dict[bytes, bytes] = {}
        if isinstance(ref, _Ref) and int(ref) in file.streams:
            self.ranges, held = [], []
            for value, _ in _values(file.stream(int(ref))):
                if isinstance(value, _Operator):
                    step = {"endbfchar": 2, "endbfrange": 3}.get(value)
                    for i in range(0, len(held) - 1 if step else 0, step or 1):
                        self.ranges.append((int.from_bytes(held[i]), int.from_bytes(held[i + step - 2]), held[i + step - 1]))
                    if value == "endcodespacerange" and held:
                        self.width = len(held[0])
                    held = []
                elif isinstance(value, bytes | list):
                    held.append(value)
            self.ranges.sort(key=lambda r: r[0])
            self.starts = [r[0] for r in self.ranges]

    def text(self, codes: bytes) -> str:
        if self.ranges is None:
            return codes.decode("cp1252", "replace") if self.width == 1 else "�" * (len(codes) // 2)
        cut = [codes[i : i + self.width] for i in range(0, len(codes), self.width)]
        for c in set(cut) - self.known.keys():
            self.known[c] = self._one(int.from_bytes(c))
        return b"".join(map(self.known.__getitem__, cut)).decode("utf-16-be", "replace")

    def _one(self, code: int) -> bytes:
        k = bisect_right(self.starts, code) - 1
        if k < 0 or code > self.ranges[k][1]:
            return b"\xff\xfd"
        first, _, target = self.ranges[k]
        if isinstance(target, list):
            return target[code - first]
        return target[:-2] + ((int.from_bytes(target[-2:]) + code - first) & 0xFFFF).to_bytes(2)


def _page_text(file: _File, page: dict) -> str:
    """Strings in the order they are drawn: a new line where the height changes, a blank where only the place does."""
    contents = page.get("/Contents")
    parts = file.get(contents) if isinstance(file.get(contents), list) else [contents]
    body = b"\n".join(file.stream(int(p)) for p in parts if isinstance(p, _Ref) and int(p) in file.streams)
    resources = file.get(page.get("/Resources")) or {}
    named = file.get(resources.get("/Font")) or {}
    fonts = {k: _Font(file, file.get(v) or {}) for k, v in named.items()}
    font, out, y, shown, moved, args = _Font(file, {}), [], 0.0, None, False, []

    def show(codes: bytes) -> None:
        nonlocal shown, moved
        if codes:
            if shown is not None and (shown != y or moved):
                out.append("\n" if shown != y else " ")
            out.append(font.text(codes))
            shown, moved = y, False

    for value, _ in _values(_IMAGE.sub(b" ", body)):
        if not isinstance(value, _Operator):
            args.append(value)
            continue
        if value == "Tf" and len(args) > 1:
            font = fonts.get(args[-2], font)
        elif value == "BT":
            y, moved = 0.0, True
        elif value in ("Td", "TD") and len(args) > 1:
            y, moved = y + args[-1], True
        elif value == "Tm" and len(args) > 5:
            y, moved = args[-1], True
        elif value in ("T*", "'", '"'):
            y -= 1e-3  # lower, by whatever the leading is
        if value in ("Tj", "'", '"') and args and isinstance(args[-1], bytes):
            show(args[-1])
        elif value == "TJ" and args and isinstance(args[-1], list):
            for x in args[-1]:
                if isinstance(x, bytes):
                    show(x)
                elif isinstance(x, int | float) and x < _GAP:
                    moved = True
        args = []
    return "".join(out)


def pages_text(data: bytes) -> list[str]:
    """The text of each page of a PDF file."""
    file = _File(data)
    return [_page_text(file, p) for p in file.pages()]
