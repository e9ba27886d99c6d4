"""JPEG and PNG: what their segments and chunks carry, and copies without."""

from __future__ import annotations

import re

from .manifests import manifest_rows
from .records import Row, row, source_type_rows

PNG = b"\x89PNG\r\n\x1a\n"
# Segments that carry authorship or capture data, and the chunks that do.
TELLING_SEGMENTS = [0xE1, 0xE3, 0xEC, 0xED, 0xFE]
MANIFEST_SEGMENT = 0xEB
TELLING_CHUNKS = ["tEXt", "iTXt", "zTXt", "eXIf", "tIME", "caBX"]
SCAN, END, ALONE = 0xDA, 0xD9, {0x01, *range(0xD0, 0xD9)}


def image_format(data: bytes) -> str | None:
    return "png" if data.startswith(PNG) else "jpeg" if data[:2] == b"\xff\xd8" and len(data) > 2 else None


def segments(data: bytes) -> list[tuple[int, int, int]]:
    """(marker, start, end) of each JPEG segment before the picture's data; what is cut short ends the list."""
    out, at = [], 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker in (SCAN, END):
            break
        if marker == 0xFF or marker in ALONE:
            at += 1 if marker == 0xFF else 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4])
        if size < 2 or at + 2 + size > len(data):
            break
        out.append((marker, at, at + 2 + size))
        at += 2 + size
    return out


def chunks(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, end) of each whole PNG chunk."""
    out, at = [], len(PNG)
    while at + 12 <= len(data):
        end = at + 12 + int.from_bytes(data[at : at + 4])
        if end > len(data):
            break
        out.append((data[at + 4 : at + 8].decode("latin-1"), at, end))
        at = end
    return out


def holds_manifest(marker: int, body: bytes) -> bool:
    return marker == MANIFEST_SEGMENT and body.startswith(b"JP") and re.search(rb"(?i)jumb|jumd|c2pa", body[:64]) is not None


def segment_label(marker: int, body: bytes) -> str | None:
    if marker == 0xE1 and body.startswith(b"Exif"):
        placed = b"\x88\x25" in body or b"\x25\x88" in body
        return "Exif with GPS coordinates" if placed else "Exif camera data"
    if marker == 0xE1:
        return "XMP metadata" if b"http://ns.adobe.com/xap" in body[:32] else "APP1 metadata"
    named = {0xED: "IPTC/Photoshop metadata", 0xFE: "Embedded comment"}
    return named.get(marker, "Application metadata") if marker in TELLING_SEGMENTS else None


def image_rows(data: bytes, location: str) -> list[Row]:
    """Findings of an image; none if it is neither JPEG nor PNG."""
    out: list[Row] = []
    if image_format(data) == "jpeg":
        for marker, start, end in segments(data):
            body = data[start + 4 : end]
            label = segment_label(marker, body)
            if holds_manifest(marker, body):
                out += manifest_rows(body, location)
            elif label:
                out += source_type_rows(body.decode("latin-1"), location)
                level = "confirmed" if label.startswith("Exif with") else "probable"
                out.append(row("identity", level, location, label, f"{end - start} bytes"))
    elif image_format(data) == "png":
        for name, start, end in chunks(data):
            body = data[start + 8 : end - 4]
            if name == "caBX":
                out += manifest_rows(body, location)
            elif name in TELLING_CHUNKS:
                out += source_type_rows(body.decode("latin-1"), location)
                kind, level = "timestamp" if name == "tIME" else "identity", "confirmed" if name == "eXIf" else "probable"
                out.append(row(kind, level, location, "Exif camera data" if name == "eXIf" else f"PNG {name} chunk", f"{end - start} bytes"))
    return out


def stripped(data: bytes) -> bytes:
    """The image without what tells of its making; pixels, JFIF and colour profiles stay."""
    if image_format(data) == "jpeg":
        gone = [(s, e) for m, s, e in segments(data) if m in TELLING_SEGMENTS or holds_manifest(m, data[s + 4 : e])]
    else:
        gone = [(s, e) for name, s, e in chunks(data) if name in TELLING_CHUNKS] if image_format(data) == "png" else []
    out, at = [], 0
    for start, end in gone:
        out.append(data[at:start])
        at = end
    return b"".join([*out, data[at:]])
