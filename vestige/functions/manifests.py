"""Signed provenance manifests: boxes, their CBOR, and what the claim says. Signatures aren't verified."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .fields import UNSIGNED
from .records import Row, row, source_type_row

DEPTH, SEARCHED = 12, 64


@dataclass
class Box:
    type: str
    payload: bytes
    label: str = ""
    children: list[Box] = field(default_factory=list)

    def walk(self):
        yield self
        for child in self.children:
            yield from child.walk()


def boxes(data: bytes, depth: int = 0) -> list[Box]:
    """The boxes in a row of bytes, nested ones inside; a box that runs past the end closes the row."""
    out, at = [], 0
    while depth <= DEPTH and at + 8 <= len(data):
        size = int.from_bytes(data[at : at + 4]) or len(data) - at
        if size < 8 or at + size > len(data):
            break
        box = Box(data[at + 4 : at + 8].decode("latin-1"), data[at + 8 : at + size])
        if box.type == "jumb":
            box.children = boxes(box.payload, depth + 1)
            head = next((c.payload for c in box.children if c.type == "jumd"), b"")
            if len(head) > 17 and head[16] & 2:
                box.label = head[17:].split(b"\0", 1)[0].decode("latin-1").strip()
        out.append(box)
        at += size
    return out


def root(data: bytes) -> Box | None:
    """The outermost box, which a segment's own header may precede."""
    at = data.find(b"jumb", 4, SEARCHED + 7)
    while at >= 0:
        found = boxes(data[at - 4 :])
        if found:
            return found[0]
        at = data.find(b"jumb", at + 1, SEARCHED + 7)
    return None


def cbor(data: bytes):
    """The value that CBOR bytes hold; floats read as 0, tags are passed by, keys become strings. None if broken."""
    try:
        return _item(data, 0, 0)[0]
    except (IndexError, ValueError, RecursionError):
        return None


_BREAK = object()


def _item(data: bytes, at: int, depth: int):
    if depth > 64:
        raise ValueError("too deep")
    major, short = data[at] >> 5, data[at] & 31
    at += 1
    if 24 <= short <= 27:
        width = 1 << short - 24
        if at + width > len(data):
            raise ValueError("cut short")
        size = int.from_bytes(data[at : at + width])
        at += width
    elif 28 <= short <= 30:
        raise ValueError("reserved")
    else:
        size = short
    open_ended = short == 31
    if major == 7:
        return (_BREAK if open_ended else {20: False, 21: True, 22: None, 23: None}.get(short, 0)), at
    if major < 2:
        return (size if major == 0 else -1 - size), at
    if major == 6:
        return _item(data, at, depth + 1)
    if major in (2, 3) and not open_ended:
        if at + size > len(data):
            raise ValueError("cut short")
        raw = data[at : at + size]
        return (raw.decode("utf-8", "replace") if major == 3 else raw), at + size
    values = []
    wanted = -1 if open_ended else size * (2 if major == 5 else 1)
    while len(values) != wanted:
        value, at = _item(data, at, depth + 1)
        if value is _BREAK:
            break
        values.append(value)
    if major == 5:
        return {str(k): v for k, v in zip(values[::2], values[1::2])}, at
    if major == 4:
        return values, at
    parts = [v for v in values if isinstance(v, str if major == 3 else bytes)]
    return ("" if major == 3 else b"").join(parts), at


def text_of(map_, key: str) -> str:
    value = map_.get(key) if isinstance(map_, dict) else None
    return value if isinstance(value, str) else ""


def summary(data: bytes) -> dict | None:
    """generator, algorithm, source_type, software and assertions of a manifest; None where there are no boxes."""
    top = root(data)
    if top is None:
        return None
    named = [b for b in top.walk() if b.label]

    def held(wanted) -> object:
        box = next((b for b in named if wanted(b.label)), None)
        return cbor(next((c.payload for c in box.children if c.type == "cbor"), b"")) if box else None

    claim, acted = held(lambda x: x.startswith("c2pa.claim")), held(lambda x: x == "c2pa.actions")
    tools = claim.get("claim_generator_info") if isinstance(claim, dict) else None
    tools = [f"{text_of(t, 'name')} {text_of(t, 'version')}".strip() for t in tools if isinstance(t, dict) and "name" in t] if isinstance(tools, list) else []
    actions = acted.get("actions") if isinstance(acted, dict) else None
    first = actions[0] if isinstance(actions, list) and actions else None
    told = {b.label for b in named if b.label.startswith("c2pa.") and not b.label.startswith("c2pa.claim") and b.label != "c2pa.signature"}
    return {
        "generator": ", ".join(tools) or text_of(claim, "claim_generator"), "algorithm": text_of(claim, "alg"),
        "source_type": text_of(first, "digitalSourceType"), "software": text_of(first, "softwareAgent"), "assertions": sorted(told),
    }


def xmp_generator(text: str) -> str:
    """The generator of credentials that an XMP packet holds, an attribute or an element."""
    for key in ("claim_generator_info", "claim_generator", "softwareAgent"):
        for shape in (rf"{key}\s*=\s*[\"']([^\"']{{2,120}})[\"']", rf"<[^<>]*{key}[^<>]*>([^<]{{2,120}})<"):
            m = re.search(shape, text, re.IGNORECASE)
            if m and m[1].strip():
                return m[1].strip()
    return ""


def manifest_rows(data: bytes, location: str, packet: str | None = None) -> list[Row]:
    """Presence, which makes the file verifiable, and what a manifest (or an XMP packet) claims."""
    out = [row("provenance", "confirmed", location, "C2PA content credentials", "signed provenance manifest")]
    found = summary(data) if packet is None else None
    generator = found["generator"] if found else xmp_generator(packet if packet is not None else data.decode("utf-8", "replace"))
    told = []
    if generator:
        told.append(("claim_generator", "Tool credited by the C2PA manifest", f"{generator} — {UNSIGNED}"))
    if found and found["software"] and found["software"] != generator:
        told.append(("c2pa.actions", "Software credited by the action", f"{found['software']} — {UNSIGNED}"))
    if found and found["assertions"]:
        told.append(("assertions", "What the C2PA manifest asserts", ", ".join(found["assertions"])))
    rows = [row("provenance", "probable", f"{location} ({part})", label, value) for part, label, value in told]
    declared = source_type_row(found["source_type"], f"{location} (c2pa.actions)") if found and found["source_type"] else []
    k = 1 if generator else 0
    return [*out, *rows[:k], *declared, *rows[k:]]
