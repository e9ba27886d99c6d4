"""Findings in Python, for what is read from bytes: the same rows as the column operators give."""

from __future__ import annotations

import re
from functools import cache

from .content import masked
from .patterns import CONTENT, CREDENTIAL, SOURCE_TYPE, SOURCE_TYPE_IN_TEXT, SOURCE_TYPES

Row = dict[str, str]
WIDE = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def row(kind: str, confidence: str, location: str, label: str, value: str) -> Row:
    return {"kind": kind, "confidence": confidence, "location": location, "label": label, "value": value}


@cache
def python(pattern: str) -> re.Pattern:
    """The pattern with ASCII words and wide white space."""
    inside = re.sub(r"(\[[^\[\]]*?)\\s([^\[\]]*\])", lambda m: m[1] + WIDE + m[2], pattern)
    return re.compile(inside.replace(r"\s", f"[{WIDE}]"), re.ASCII)


def content_rows(text: str, location: str, limit: int | None = None) -> list[Row]:
    """Findings of the content patterns, each label and value once, in the whole text or its first ``limit`` characters."""
    body, out = text[:limit], {}
    for label, kind, pattern, secret in CONTENT:
        for m in python(pattern).finditer(body):
            value, name = (masked(m[0]), CREDENTIAL + label) if secret else (m[0], label)
            out.setdefault((name, value), row(kind, "confirmed", location, name, value))
    return [*out.values()]


def source_type_row(value: str, location: str) -> list[Row]:
    """The finding of one declaration; none if its term is unknown."""
    name = re.search(r"[^/#]*\Z", value.strip())[0]
    return [row("provenance", level, location, SOURCE_TYPE, f"{term} — {told}") for term, told, _, level in SOURCE_TYPES if term == name]


def source_type_rows(text: str, location: str) -> list[Row]:
    terms = dict.fromkeys(m[1] for m in python(SOURCE_TYPE_IN_TEXT).finditer(text))
    return [r for t in terms for r in source_type_row(t, location)]


def field_rows(fields, read, where: str, passed=()) -> list[Row]:
    """Of each field that read() finds and whose value isn't passed by, a row."""
    values = ((f, read(f[0])) for f in fields)
    return [row(kind, level, where + key, label, v) for (key, label, kind, level), v in values if v and v not in passed]
