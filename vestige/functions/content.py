"""Pattern banks: credentials and identifiers in bodies, traces and tools in metadata, source types."""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .findings import FINDING, FINDING_TYPE, either, finding, first_each, let, none, trim
from .patterns import (
    API_IDENTIFIERS,
    ASSEMBLED,
    ATTRIBUTING,
    CONTENT,
    CREDENTIAL,
    METADATA_CREDENTIALS,
    MODELS,
    SOURCE_TYPE,
    SOURCE_TYPE_IN_TEXT,
    SOURCE_TYPES,
    SUBJECTS,
    TOOL_LABELS,
    TOOLS,
    TRACES,
    java,
    needles,
)


def mask(secret: Column) -> Column:
    """Enough of a secret to recognise it: up to the last - or _ of its first 8 characters, else up to 4 letters."""
    head = F.substring(secret, 1, 8)
    marked = F.regexp_extract(head, "^(.*[-_])", 1)
    plain = F.substring(F.regexp_extract(secret, "^[A-Za-z]+", 0), 1, 4)
    prefix = F.when(marked != "", marked).otherwise(F.when(plain != "", plain).otherwise(F.substring(secret, 1, 4)))
    return F.concat(prefix, F.lit("… ("), F.length(secret).cast("string"), F.lit(" characters) — rotate this key"))


def told_each(values: Column, kind: str, location: str | Column, label: str) -> Column:
    return F.transform(values, lambda v: finding(kind, "confirmed", location, label, v)).cast(FINDING)


def labelled(findings: Column, label: str) -> Column:
    return F.filter(findings, lambda f: f["label"] == label)


def scan_content(text: Column, location: str | Column, limit: int | None = None) -> Column:
    """Findings of the content patterns, each distinct value of a label once, in the whole text or its first ``limit`` characters."""
    body = text if limit is None else F.substring(text, 1, limit)
    parts = []
    for label, kind, pattern, masked in CONTENT:
        found = F.regexp_extract_all(body, F.lit(java(pattern)), F.lit(0))
        # a plain search spares most texts the pattern
        found = F.when(either([F.contains(body, F.lit(x)) for x in needles(pattern)]), found).otherwise(F.array().cast("array<string>"))
        values = F.array_distinct(F.transform(found, mask) if masked else found)
        name = (CREDENTIAL if masked else "") + label
        parts.append(told_each(values, kind, location, name))
    return first_each(F.concat(*parts))


def find_source_types(text: Column, location: str | Column) -> Column:
    """Declarations in the IPTC vocabulary, each term once."""
    terms = F.array_distinct(F.regexp_extract_all(text, F.lit(java(SOURCE_TYPE_IN_TEXT)), F.lit(1)))
    rows = F.flatten(F.transform(terms, lambda t: describe_source_type(t, location)))
    return F.when(F.contains(text, F.lit("igitalSourceType")), rows).otherwise(none())


def describe_source_type(value: Column, location: str | Column) -> Column:
    """The finding of one declaration, a term or a URI that ends in one; none if it is unknown."""
    name = F.regexp_extract(trim(value), "([^/#]*)$", 1)
    summary = F.create_map(*(F.lit(x) for t, s, _, _ in SOURCE_TYPES for x in (t, s)))[name]
    level = F.create_map(*(F.lit(x) for t, _, _, c in SOURCE_TYPES for x in (t, c)))[name]
    row = finding("provenance", level, location, SOURCE_TYPE, F.concat(name, F.lit(" — "), summary))
    return F.when(summary.isNotNull(), F.array(row).cast(FINDING)).otherwise(none())


def declares_generative(findings: Column) -> Column:
    terms = [t for t, _, generative, _ in SOURCE_TYPES if generative]
    return F.exists(findings, lambda f: (f["label"] == SOURCE_TYPE) & F.split(f["value"], " — ")[0].isin(terms))


def told(template: str, match: re.Match) -> str:
    """The template with the match's groups put in; {n^} in capitals."""
    return re.sub(r"\{(\d)(\^?)\}", lambda m: match[int(m[1])].upper() if m[2] else match[int(m[1])], template)


def masked(secret: str) -> str:
    """What mask() gives, for a string."""
    marked = re.match(r".*[-_]", secret[:8])
    letters = re.match(r"[A-Za-z]+", secret)
    prefix = marked[0] if marked else (letters[0] if letters else secret)[:4]
    return f"{prefix}… ({len(secret)} characters) — rotate this key"


@cache
def banks() -> tuple[list, list]:
    """Compiled (pattern, kind, label, value of a match): traces of hosts and runs, then tools."""

    def compiled(pattern: str) -> re.Pattern:
        spaces = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
        return re.compile(re.sub(r"\\s(?=[^\[\]]*\])", lambda _: spaces, pattern).replace(r"\s", f"[{spaces}]"), re.ASCII)

    def fixed(text: str):
        return lambda _: text

    traces = [(compiled(p), "environment", label, lambda m, t=t: told(t, m)) for label, p, t in TRACES]
    tools = [(compiled(p), "identity", CREDENTIAL + name, lambda m: masked(m[0])) for p, name in METADATA_CREDENTIALS]
    tools += [(compiled(p), "environment", name, lambda m: m[0]) for p, name in API_IDENTIFIERS]
    tools += [(compiled(p), "provenance", "Model identifier", lambda m, v=vendor: f"{m[0]} ({v})") for p, vendor in MODELS]
    tools += [(compiled("(?i)" + p), "provenance", label, fixed(tool)) for label, group in TOOLS for p, tool in group]
    return traces, tools


def derive(findings) -> list[dict]:
    """What the values of findings give away about hosts, runs and tools; alike ones once, the first."""
    traces, tools = banks()
    out: dict[tuple[str, str], dict] = {}
    for f in findings:
        value = f["value"]
        if value:
            for pattern, kind, label, build in traces if f["label"] in SUBJECTS else [*traces, *tools]:
                if m := pattern.search(value):
                    row = {"kind": kind, "confidence": "confirmed", "location": f"derived from {f['location']}", "label": label, "value": build(m)}
                    out.setdefault((label, row["value"]), row)
    return [*out.values()]


@F.arrow_udf(FINDING_TYPE)
def fingerprint(findings: pa.Array) -> pa.Array:
    """derive() of each row's findings: some sixty patterns a finding, which are faster here than as columns."""
    kind = pa.list_(pa.struct([(f.name, pa.string()) for f in FINDING_TYPE.elementType.fields]))
    return pa.array([derive(rows or []) for rows in findings.to_pylist()], kind)


def provenance(findings: Column) -> Column:
    """struct(tools, attributed, declared, machine_assembled) of a document's findings."""

    def add(tools: Column, f: Column) -> Column:
        name = trim(F.split(f["value"], " — ")[0])
        low = F.lower(name)
        known = F.exists(tools, lambda t: F.contains(F.lower(t), low) | F.contains(low, F.lower(t)))
        return F.when((name == "") | known, tools).otherwise(F.array_append(tools, name))

    ordered = F.concat(*(labelled(findings, x) for x in TOOL_LABELS))
    tools = F.aggregate(ordered, F.array().cast("array<string>"), add)
    declared = declares_generative(findings)
    return F.struct(
        tools.alias("tools"),
        (F.exists(findings, lambda f: f["label"].isin(ATTRIBUTING)) | declared).alias("attributed"),
        declared.alias("declared"),
        F.exists(findings, lambda f: f["label"].startswith(ASSEMBLED)).alias("machine_assembled"),
    )


def verdict(p: Column) -> Column:
    """The strongest thing to say of a provenance."""
    return (
        F.when(p["declared"], "declared").when(p["attributed"], "attributed").when(F.size(p["tools"]) > 0, "tools").when(p["machine_assembled"], "machine-assembled").otherwise("none")
    )


__all__ = [
    "declares_generative", "describe_source_type", "find_source_types", "fingerprint", "let", "mask", "provenance", "scan_content", "verdict",
]
