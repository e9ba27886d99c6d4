"""PDF: a lenient reader of objects, metadata findings, page texts, and copies without metadata.

Objects are found by their headers, not by the file's tables, so broken tables don't matter. The last one of a
number counts. Encrypted strings aren't decrypted.
"""

from __future__ import annotations

import re
import zlib

from .fields import CMAP_ENTRIES, INFO_FIELDS, PDF_BYTES, XMP_FIELDS
from .manifests import manifest_rows
from .packages import Refused
from .records import Row, content_rows, field_rows, row, source_type_rows

HEADER = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
TOKEN = re.compile(
    rb"[\s\0]*(?:%[^\r\n]*[\s\0]*)*(?:(?P<open><<|\[)|(?P<close>>>|\])|(?P<ref>\d+\s+\d+\s+R\b)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))"
    rb"|/(?P<name>[^\s\0/<>\[\](){}%]*)|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<text>\()|(?P<word>[^\s\0/<>\[\](){}%]+)|(?P<other>.))",
    re.DOTALL,
)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
DEPTH = 64


class Name(str):
    """A name, /x."""


class Ref(tuple):
    """A reference, (number, generation)."""


class Word(str):
    """An operator or a keyword."""


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string's bytes after its opening parenthesis, and the place behind it."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, at + 1)
            line = re.compile(rb"\r\n?|\n").match(data, at + 1)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
            elif line:
                at = line.end()
            else:
                follows = data[at + 1 : at + 2]
                out += ESCAPES.get(follows, follows)
                at += 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if depth == 0:
            break
        out += c
    return bytes(out), at


def hexed(digits: bytes) -> bytes:
    flat = re.sub(rb"\s", b"", digits)
    return bytes.fromhex((flat + b"0" * (len(flat) % 2)).decode())


def tokens(data: bytes, at: int = 0):
    """(kind, value, start, end) of each token."""
    while m := TOKEN.match(data, at):
        kind, start, at = m.lastgroup, m.start(m.lastgroup), m.end()
        raw = m[kind]
        if kind == "text":
            value, at = literal(data, at)
        elif kind == "hex":
            kind, value = "text", hexed(raw)
        elif kind == "name":
            value = Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), raw.decode("latin-1")))
        elif kind == "ref":
            value = Ref(map(int, raw.split()[:2]))
        elif kind == "number":
            value = float(raw) if b"." in raw else int(raw)
        else:
            value = Word(raw.decode("latin-1"))
        yield kind, value, start, at


def value_at(data: bytes, at: int):
    """The value that begins there and the place behind it; a broken one ends where the data does."""
    stack: list[tuple[str, list]] = []
    for kind, value, _, end in tokens(data, at):
        if kind == "open":
            if len(stack) >= DEPTH:
                raise Refused("nested too deep")
            stack.append((str(value), []))
            continue
        if kind == "close":
            if not stack:
                return None, end
            opened, items = stack.pop()
            value = dict(zip((str(k) for k in items[::2]), items[1::2])) if opened == "<<" else items
        if not stack:
            return value, end
        stack[-1][1].append(value)
    return None, len(data)


def told(value) -> str:
    """A text string: UTF-16 by its mark or its zeros, else Latin-1; other values as they are written."""
    if isinstance(value, bytes):
        if value.startswith(b"\xfe\xff"):
            return value[2:].decode("utf-16-be", "replace")
        if len(value) % 2 == 0 and b"\0" in value:
            return value.decode("utf-16-be", "replace")
        return value.decode("latin-1")
    return f"/{value}" if isinstance(value, Name) else "" if value is None or isinstance(value, (dict, list, Ref)) else str(value)


class Pdf:
    def __init__(self, data: bytes):
        self.data = data
        self.objects: dict[int, object] = {}
        self.streams: dict[int, tuple[dict, bytes]] = {}
        self.spans: dict[int, tuple[int, int]] = {}
        self.trailer: dict = {}
        self._inflated: dict[int, bytes | None] = {}
        at = 0
        while m := HEADER.search(data, at):
            at = self._object(m)
        if not self.objects:
            raise Refused("a PDF without objects")
        for m in re.finditer(rb"\btrailer\b", data):
            found, _ = value_at(data, m.end())
            if isinstance(found, dict):
                self.trailer |= found
        for number, (head, _) in list(self.streams.items()):
            if head.get("Type") == "XRef":
                self.trailer = {k: v for k, v in head.items() if k in ("Root", "Info", "ID", "Encrypt")} | self.trailer
            if head.get("Type") == "ObjStm":
                self._packed(number, head)
        if "Root" not in self.trailer:
            root = next((n for n, o in self.objects.items() if isinstance(o, dict) and o.get("Type") == "Catalog"), None)
            self.trailer |= {} if root is None else {"Root": Ref((root, 0))}

    def _object(self, m: re.Match) -> int:
        number = int(m[1])
        value, end = value_at(self.data, m.end())
        self.objects[number] = value
        self.streams.pop(number, None)
        begins = re.compile(rb"\s*stream\r?\n?").match(self.data, end) if isinstance(value, dict) else None
        if begins:
            size = value.get("Length")
            stop = begins.end() + size if isinstance(size, int) and size >= 0 else -1
            if stop < 0 or not re.compile(rb"\s*endstream").match(self.data, stop):
                stop = self.data.find(b"endstream", begins.end())
                stop = len(self.data) if stop < 0 else stop
            self.streams[number] = value, self.data[begins.end() : stop]
            end = stop
        self.spans[number] = m.end(), end
        return max(end, m.end())

    def _packed(self, number: int, head: dict) -> None:
        body = self.inflated(number) or b""
        first, n = head.get("First"), head.get("N")
        if isinstance(first, int) and isinstance(n, int):
            numbers = [int(x) for x in re.findall(rb"\d+", body[:first])[: 2 * n]]
            for each, offset in zip(numbers[::2], numbers[1::2]):
                if each not in self.objects:
                    self.objects[each] = value_at(body, first + offset)[0]

    def get(self, value):
        """What a reference leads to; other values themselves."""
        for _ in range(DEPTH):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value[0])
        return None

    def dict_of(self, value) -> dict:
        found = self.get(value)
        return found if isinstance(found, dict) else {}

    @property
    def catalog(self) -> dict:
        return self.dict_of(self.trailer.get("Root"))

    def inflated(self, number: int) -> bytes | None:
        """A stream's bytes; None where a filter isn't read here. What is cut short is read as far as it goes."""
        if number not in self._inflated:
            head, raw = self.streams[number]
            filters = self.get(head.get("Filter"))
            filters = [self.get(f) for f in filters] if isinstance(filters, list) else [] if filters is None else [filters]
            for f in filters:
                if f in ("FlateDecode", "Fl") and raw is not None:
                    try:
                        raw = zlib.decompressobj().decompress(raw, PDF_BYTES)
                    except zlib.error:
                        raw = None
                elif f in ("ASCIIHexDecode", "AHx") and raw is not None:
                    raw = hexed(re.sub(rb"[^0-9A-Fa-f]", b"", raw.split(b">")[0]))
                else:
                    raw = None
            parms = self.dict_of(head.get("DecodeParms"))
            if raw is not None and isinstance(parms.get("Predictor"), int) and parms["Predictor"] >= 10:
                raw = unpredicted(raw, parms.get("Columns", 1))
            self._inflated[number] = raw
        return self._inflated[number]

    def xmp(self) -> str:
        ref = self.catalog.get("Metadata")
        body = self.inflated(ref[0]) if isinstance(ref, Ref) and ref[0] in self.streams else None
        return (body or b"").decode("utf-8", "replace")

    def pages(self) -> list[dict]:
        """Pages in order; a loop in the tree is passed by."""
        out, seen, todo = [], set(), [(self.catalog.get("Pages"), {})]
        while todo:
            ref, given = todo.pop()
            node = self.dict_of(ref)
            if id(node) in seen or not node:
                continue
            seen.add(id(node))
            given = given | ({"Resources": node["Resources"]} if "Resources" in node else {})
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                todo += [(k, given) for k in reversed(kids)]
            else:
                out.append(given | node)
        return out

    def content(self, page: dict) -> bytes:
        held = page.get("Contents")
        refs = held if isinstance(held, Ref) and held[0] in self.streams else self.get(held)
        refs = [refs] if isinstance(refs, Ref) else refs if isinstance(refs, list) else []
        return b"\n".join(self.inflated(r[0]) or b"" for r in refs if isinstance(r, Ref) and r[0] in self.streams)

    def font_maps(self, page: dict) -> dict[str, tuple[int, dict[int, str]]]:
        fonts = self.dict_of(self.dict_of(page.get("Resources")).get("Font"))
        refs = {name: self.dict_of(f).get("ToUnicode") for name, f in fonts.items()}
        return {n: unicode_map(self.inflated(r[0]) or b"") for n, r in refs.items() if isinstance(r, Ref) and r[0] in self.streams}

    # findings

    def rows(self) -> list[Row]:
        """Everything but the characters of the pages."""
        info, xmp, identifier = self.get(self.trailer.get("Info")), self.xmp(), self.get(self.trailer.get("ID"))
        entries = {k: told(self.get(v)).strip() for k, v in info.items()} if isinstance(info, dict) else {}
        out = field_rows(INFO_FIELDS, entries.get, "/Info /")
        if xmp:
            out += field_rows(XMP_FIELDS, lambda p: xmp_value(xmp, p), "/Metadata ")
            out += source_type_rows(xmp, "/Metadata")
            if re.search("(?i)c2pa|contentcredentials|content_credentials|claim_generator", xmp):
                out += manifest_rows(b"", "/Metadata", xmp)
        if isinstance(identifier, list) and identifier and isinstance(identifier[0], bytes):
            printable = all(32 <= c < 127 for c in identifier[0])
            value = identifier[0].decode() if printable else identifier[0].hex().upper()
            out.append(row("environment", "probable", "trailer /ID", "Document identifier (/ID)", value))
        known = {f[0] for f in INFO_FIELDS}
        out += [row("provenance", "confirmed", f"/Info /{k}", f"Custom info key: {k}", v) for k, v in entries.items() if k not in known and v]
        out += self.stream_rows()
        out += self.shape(info, entries)
        if "EmbeddedFiles" in self.dict_of(self.catalog.get("Names")):
            value = "present — may carry provenance manifests or source data"
            out.append(row("provenance", "probable", "/Names /EmbeddedFiles", "Embedded file attachments", value))
        return out

    def scanned(self):
        """(object number, bytes) of the streams, until the budget of decoded bytes is spent."""
        left = PDF_BYTES
        for number in self.streams:
            if left <= 0:
                return
            body = self.inflated(number)
            if body is not None:
                left -= len(body)
                yield number, body

    def stream_rows(self) -> list[Row]:
        out: dict[tuple[str, str], Row] = {}
        for number, body in self.scanned():
            for r in content_rows(f"{body.decode('latin-1')}\n{operands(body)}", f"stream {number} 0 R"):
                out.setdefault((r["label"], r["value"]), r)
        return [*out.values()]

    def bodies(self) -> list[tuple[str, str]]:
        """(place, text) of string operands by stream, then of pages whose fonts say what their codes mean."""
        out = [(f"stream {n} 0 R", operands(body)) for n, body in self.scanned() if re.search(rb"T[jJ]|'|\"", body)]
        for k, page in enumerate(self.pages(), 1):
            maps = self.font_maps(page)
            if maps:
                out.append((f"page {k}", shown(self.content(page), maps)))
        return [(place, text) for place, text in out if text.strip()]

    def shape(self, info, entries: dict[str, str]) -> list[Row]:
        out = []
        if info == {}:
            value = (
                "the /Info dictionary is present and empty, which no producer writes — every one of them records at least a /Producer. "
                "Cleaning a document leaves this shape behind"
            )
            out.append(row("provenance", "confirmed", "trailer /Info", "Metadata has been stripped from this file", value))
        strong = [] if "ID" in self.trailer else ["the trailer carries no /ID, which the format asks for"]
        if entries.get("CreationDate") and entries["CreationDate"] == entries.get("ModDate"):
            strong.append("created and modified at the same instant")
        weak = [t for key, t in (("Metadata", "no XMP metadata packet"), ("StructTreeRoot", "not tagged for accessibility")) if key not in self.catalog]
        if strong and len(strong) + len(weak) > 1:
            both = len(strong) > 1
            value = "; ".join(strong + weak) + ("" if both else " — the last of these are also absent from a file printed to PDF")
            level = "probable" if both else "informational"
            out.append(row("provenance", level, "file structure", "Assembled by a program, not exported from an editor", value))
        return out

    # cleaning

    def redacted(self) -> bytes:
        """The file with /Info and /Metadata overwritten by blanks, so that every offset in its tables holds.

        Refused where either lies in a compressed object stream or in the dictionary of a trailer stream.
        """
        out = bytearray(self.data)
        for key, holders in (("Info", [m.end() for m in re.finditer(rb"\btrailer\b", self.data)]), ("Metadata", [self._where(self.trailer.get("Root"))])):
            ref = self.trailer.get("Info") if key == "Info" else self.catalog.get("Metadata")
            if not isinstance(ref, Ref):
                continue
            if ref[0] not in self.spans or None in holders or not holders:
                raise Refused(f"/{key} lies in a compressed object")
            last = self.spans[ref[0]]
            for m in re.finditer(rb"(?<!\d)%d\s+%d\s+obj\b" % ref, self.data):
                # older copies of the object go too; a stream may hold the closing word by chance
                stop = self.data.find(b"endobj", last[1] if last[0] == m.end() else m.end())
                blank(out, m.end(), len(self.data) if stop < 0 else stop)
            gone = re.compile(rb"/%s\s+\d+\s+\d+\s+R\b" % key.encode())
            for start in holders:
                _, end = value_at(self.data, start)
                for m in gone.finditer(self.data, start, end):
                    out[m.start() : m.end()] = b" " * (m.end() - m.start())
        return bytes(out)

    def _where(self, ref) -> int | None:
        return self.spans[ref[0]][0] if isinstance(ref, Ref) and ref[0] in self.spans else None


def blank(out: bytearray, start: int, end: int) -> None:
    """null and blanks in place of a value."""
    out[start:end] = b" null".ljust(end - start)[: end - start] if end - start >= 5 else b" " * (end - start)


def unpredicted(data: bytes, columns: int) -> bytes:
    """Rows of one byte a pixel without their PNG prediction (none, left and up, which cross-reference streams use)."""
    out, before = bytearray(), bytes(columns)
    for at in range(0, len(data), columns + 1):
        kind, line = data[at], bytearray(data[at + 1 : at + 1 + columns])
        for k in range(len(line)):
            line[k] = (line[k] + (before[k] if kind == 2 else line[k - 1] if kind == 1 and k else 0)) & 255
        out += line
        before = bytes(line).ljust(columns, b"\0")
    return bytes(out)


def xmp_value(xmp: str, name: str) -> str:
    m = re.search(rf"<{re.escape(name)}(?=[\s>])[^>]*>(.*?)</{re.escape(name)}>", xmp, re.DOTALL)
    inside = re.sub("<[^>]*>", "", m[1]).strip() if m else ""
    m = None if inside else re.search(rf"\s{re.escape(name)}=\"([^\"]*)\"", xmp)
    return inside or (m[1] if m else "")


def operands(body: bytes) -> str:
    """The strings of a content stream, one after the other."""
    return " ".join(told(v) for kind, v, *_ in tokens(body) if kind == "text")


def unicode_map(cmap: bytes) -> tuple[int, dict[int, str]]:
    """(bytes a code, text by code) of a ToUnicode map, whose entries are bounded."""
    width = re.search(rb"begincodespacerange\s*<\s*([0-9A-Fa-f]+)", cmap)
    out: dict[int, str] = {}

    def text(raw: bytes) -> str:
        return raw.decode("utf-16-be", "replace") if len(raw) > 1 else raw.decode("latin-1")

    for kind, block in re.findall(rb"beginbf(char|range)(.*?)endbf", cmap, re.DOTALL):
        items: list = []
        at = 0
        while at < len(block):
            value, at = value_at(block, at)
            items.append(value)
        step = 2 if kind == b"char" else 3
        for k in range(0, len(items) - step + 1, step):
            entry = items[k : k + step]
            if not all(isinstance(x, bytes) for x in entry[:-1]) or len(out) >= CMAP_ENTRIES:
                continue
            low, high, to = int.from_bytes(entry[0]), int.from_bytes(entry[-2]), entry[-1]
            for n, code in enumerate(range(low, min(high, low + CMAP_ENTRIES) + 1)):
                if isinstance(to, list):
                    if n >= len(to) or not isinstance(to[n], bytes):
                        break
                    out[code] = text(to[n])
                elif isinstance(to, bytes):
                    said = text(to)
                    out[code] = said[:-1] + chr(min(ord(said[-1]) + n, 0x10FFFF)) if said else ""
    return (len(width[1]) // 2 if width else 2) or 1, out


def shown(content: bytes, maps: dict[str, tuple[int, dict[int, str]]]) -> str:
    """Text that a page shows in fonts with maps; with a single font, it holds from the start."""
    current = next(iter(maps.values())) if len(maps) == 1 else None
    out, name = [], None
    for kind, value, *_ in tokens(content):
        if kind == "name":
            name = value
        elif kind == "word" and value == "Tf":
            current = maps.get(name)
        elif kind == "text" and current:
            width, table = current
            codes = (int.from_bytes(value[k : k + width]) for k in range(0, len(value), width))
            out.append("".join(table.get(c, "") for c in codes))
    return " ".join(out)
