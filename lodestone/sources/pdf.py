"""Texts of PDF pages: the page tree, deflated streams, strings by the fonts' maps to Unicode."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np

_TOKEN = re.compile(rb"(?:\s|%[^\r\n]*)*(<<|>>|\[|\]|\(|<[0-9A-Fa-f\s]*>|/[^\s<>\[\]()/%{}]*|[^\s<>\[\]()/%{}]+)")
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_WHOLE, _DECIMAL = re.compile(rb"[+-]?\d+"), re.compile(rb"[+-]?\d*\.\d*")
_STREAM, _ENDSTREAM = re.compile(rb"\s*stream(?:\r\n|\n|\r)"), re.compile(rb"\s*endstream")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name such as /Kids, without the slash."""


class Op(bytes):
    """A bare word: an operator or keyword."""


class Ref(int):
    """The number of another object."""


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses, from behind the first one."""
    out, depth = [], 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, at)
            if octal:
                out.append(bytes([int(octal[0], 8) & 255]))
                at = octal.end()
                continue
            c = data[at : at + 1]
            at += 2 if data[at : at + 2] == b"\r\n" else 1
            out.append(b"" if c in b"\r\n" else _ESCAPES.get(c, c))
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out.append(c)
    return b"".join(out), at


def _hexadecimal(token: bytes) -> bytes:
    """A string in angle brackets; blanks may stand anywhere, and a last digit that is missing is zero."""
    try:
        return bytes.fromhex(token[1:-1].decode())
    except ValueError:
        digits = re.sub(rb"[<>\s]", b"", token)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def _values(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Values and operators outside any array or dictionary, each with the place behind it."""
    open_: list[list] = []
    while m := _TOKEN.match(data, at):
        t, at = m[1], m.end()
        value: object
        if t == b"(":
            value, at = _literal(data, at)
        elif t in (b"[", b"<<"):
            open_.append([])
            continue
        elif t in (b"]", b">>"):
            if not open_:
                continue
            value = open_.pop()
            if t == b">>":
                value = dict(zip(value[::2], value[1::2], strict=False))
        elif t[:1] == b"<":
            value = _hexadecimal(t)
        elif t[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x[1].decode()), t[1:]).decode("latin-1"))
        elif _WHOLE.fullmatch(t):
            value = int(t)
        elif _DECIMAL.fullmatch(t) and len(t) > 1:
            value = float(t + b"0") if t not in (b"+.", b"-.") else 0.0
        else:
            value = Op(t)
            if t == b"R" and open_ and len(open_[-1]) >= 2:
                open_[-1].pop()
                value = Ref(open_[-1].pop())
            elif t == b"ID" and not open_:  # An image among the operators.
                end = re.compile(rb"\sEI\s").search(data, at)
                at = end.end() if end else len(data)
        if open_:
            open_[-1].append(value)
        else:
            yield value, at


class Pdf:
    """The objects of a file, found by their headers, the last of a number counting; those in object streams too."""

    def __init__(self, content: bytes):
        self.content = content
        self.places = {int(m[1]): m.end() for m in _OBJECT.finditer(content)}
        self.packed: dict[int, tuple[bytes, int]] = {}
        self.heads: dict[int, tuple[object, int]] = {}
        self.decoders: dict[int, tuple[int, dict[int, bytes] | None]] = {}
        for number in list(self.places):
            head = self.head(number)[0]
            if isinstance(head, dict) and head.get("Type") == "ObjStm" and (body := self.stream(number)[1]) is not None:
                first = self.of(head["First"])
                at = [v for v, _ in _values(body[:first])]
                self.packed |= {n: (body, first + o) for n, o in zip(at[::2], at[1::2], strict=False)}

    def head(self, number: int) -> tuple[object, int]:
        """The value of an object that isn't in an object stream, or a stream's dictionary, with the place behind it; each is read once."""
        if number not in self.heads:
            self.heads[number] = next(_values(self.content, self.places[number]), (None, 0)) if number in self.places else (None, 0)
        return self.heads[number]

    def of(self, value: object) -> object:
        """A value, or what it refers to."""
        for _ in range(8):
            if not isinstance(value, Ref):
                return value
            value = self.head(value)[0] if value in self.places else next(_values(*self.packed.get(value, (b"null", 0))), (None, 0))[0]
        return None

    def stream(self, number: int) -> tuple[object, bytes | None]:
        """An object and its stream, inflated; None where there is no stream or its filter isn't known."""
        head, at = self.head(number)
        start = _STREAM.match(self.content, at)
        if not isinstance(head, dict) or not start:
            return head, None
        size = self.of(head.get("Length"))
        end = start.end() + size if isinstance(size, int) else -1
        if end < 0 or not _ENDSTREAM.match(self.content, end):
            end = self.content.find(b"endstream", start.end())
        raw = self.content[start.end() : end if end >= 0 else None]
        filters = self.of(head.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f != "FlateDecode":
                return head, None
            try:
                raw = zlib.decompressobj().decompress(raw)
            except zlib.error:
                return head, None
        return head, raw

    def pages(self) -> Iterator[tuple[dict, dict]]:
        """Pages in order of the tree, each with its own or inherited resources; a node that comes again is left out."""
        roots = [n for n in [*self.places, *self.packed] if isinstance(d := self.of(Ref(n)), dict) and d.get("Type") == "Catalog"]
        waiting, seen = [(self.of(Ref(n)).get("Pages"), {}) for n in roots[-1:]], set()
        while waiting:
            ref, resources = waiting.pop()
            node = self.of(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and ref in seen):
                continue
            if isinstance(ref, Ref):
                seen.add(ref)
            resources = self.of(node.get("Resources")) or resources
            if "Kids" in node:
                waiting += [(k, resources) for k in reversed(self.of(node["Kids"]) or [])]
            else:
                yield node, resources

    def decoder(self, font: object) -> tuple[int, dict[int, bytes] | None]:
        """Bytes of a code, and UTF-16 of codes where the font has a map; other fonts are taken as Windows Latin."""
        if isinstance(font, Ref):
            if font not in self.decoders:
                self.decoders[font] = self.decoder(self.of(font))
            return self.decoders[font]
        ref = font.get("ToUnicode") if isinstance(font, dict) else None
        body = self.stream(ref)[1] if isinstance(ref, Ref) else None
        if body is None:
            return 1, None
        told, width, operands = {}, 2 if font.get("Subtype") == "Type0" else 1, []
        for value, _ in _values(body):
            if not isinstance(value, Op):
                operands.append(value)
                continue
            if value == b"endbfchar":
                told |= {int.from_bytes(a): b for a, b in zip(operands[::2], operands[1::2], strict=False)}
            elif value == b"endbfrange":
                for a, b, to in zip(operands[::3], operands[1::3], operands[2::3], strict=False):
                    for k, code in enumerate(range(int.from_bytes(a), int.from_bytes(b) + 1)):
                        told[code] = to[k] if isinstance(to, list) else to[:-2] + (int.from_bytes(to[-2:]) + k & 0xFFFF).to_bytes(2)
            operands = []
        return width, told

    def text(self, page: dict, resources: dict) -> str | None:
        """The strings that a page shows; a move to another line is a line feed, a wide step a blank.  None where a stream can't be read."""
        whole = page.get("Contents")
        several = self.of(whole)
        refs = several if isinstance(several, list) else [] if whole is None else [whole]
        parts = [self.stream(r)[1] if isinstance(r, Ref) else None for r in refs]
        if None in parts:
            return None
        fonts = {k: self.decoder(v) for k, v in (self.of(resources.get("Font")) or {}).items()}
        out, operands, font, line = [], [], (1, None), None

        def show(shown: bytes) -> None:
            width, told = font
            if told is None:
                out.append(shown.decode("cp1252", "replace"))
                return
            codes, places = np.unique(np.frombuffer(shown[: len(shown) // width * width], f">u{width}"), return_inverse=True)
            units = [told.get(c, b"\xff\xfd") for c in codes.tolist()]
            pairs = all(len(u) == 2 for u in units)
            told_units = np.frombuffer(b"".join(units), np.uint16)[places].tobytes() if pairs else b"".join([units[k] for k in places.tolist()])
            # Decoded as a whole: a map may give the halves of a character for two codes.
            out.append(told_units.decode("utf-16-be", "replace"))

        for value, _ in _values(b"\n".join(parts)):
            if not isinstance(value, Op):
                operands.append(value)
                continue
            if value == b"Tf" and len(operands) == 2:
                font = fonts.get(operands[0], (1, None))
            elif value in (b"T*", b"'", b'"') or (value in (b"Td", b"TD") and operands[1:2] != [0]) or (value == b"Tm" and operands[5:] != [line]):
                out.append("\n")
            line = operands[5] if value == b"Tm" and len(operands) == 6 else line
            if value in (b"Tj", b"'", b'"') and operands and isinstance(operands[-1], bytes):
                show(operands[-1])
            elif value == b"TJ" and operands and isinstance(operands[-1], list):
                for x in operands[-1]:
                    if isinstance(x, bytes):
                        show(x)
                    elif isinstance(x, int | float) and x < -200:
                        out.append(" ")
            operands = []
        return re.sub("\n+", "\n", "".join(out)).strip("\n")


def page_texts(content: bytes) -> Iterator[tuple[int, str | None]]:
    """``page, text`` of a file, pages from 1.

    Encrypted files, forms within pages and filters but FlateDecode aren't read: their pages have null or lack what the
    forms show.  A file without a page tree has no rows.
    """
    pdf = Pdf(content or b"")
    for k, (page, resources) in enumerate(pdf.pages()):
        yield k + 1, None if b"/Encrypt" in pdf.content else pdf.text(page, resources)
