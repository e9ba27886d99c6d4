"""Inspection and cleaning of files of any kind.

A file's bytes are read once, in Arrow batches, into units: one with the findings of the file's own places and one
for each text in it that a reader sees, so that a large archive becomes many rows and not one long row. The texts
then go through the same columns as texts of tables. Nothing shuffles; a broken file has an error and no findings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chars import cleaned
from ..functions.content import provenance, verdict
from ..functions.fields import TEXTUAL
from ..functions.findings import FINDING, FINDING_TYPE, exploded, let
from ..functions.images import image_format, image_rows, stripped
from ..functions.packages import Package, Refused, members, package_format, path_rows, unzipped
from ..functions.pdf import Pdf
from ..functions.records import content_rows
from ..shipping import ship
from ..sources.files import hint_for, refusal
from .textpipe import inspect_text, redact_text

NOTE = "array<struct<code: string, detail: string>>"
SCOPES = {
    "pdf": "pdf-metadata-only", **dict.fromkeys(["docx", "pptx", "xlsx", "odt", "ods", "odp"], "ooxml-metadata-only"),
    **dict.fromkeys(["svg", "html", "markdown"], "markup-metadata-only"), **dict.fromkeys(["jpeg", "png"], "image-metadata-only"),
    "zip": "archive", "text": "invisible-characters-only",
}
IMAGE_PLACES = {"jpeg": "JPEG segments", "png": "PNG chunks"}
#: Rows that go to Spark at once, and about how many characters and bytes.
BATCH_ROWS, BATCH_SIZE = 256, 16 << 20

FINDING_ARROW = pa.list_(pa.struct([(f.name, pa.string()) for f in FINDING_TYPE.elementType.fields]))
NOTE_TYPE = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("code", "detail")]))
NOTE_ARROW = pa.list_(pa.struct([("code", pa.string()), ("detail", pa.string())]))
TEXT = T.StringType(), pa.string()
UNIT = {
    "unit": (T.IntegerType(), pa.int32()), "member": TEXT, "known": TEXT, "place": TEXT, "hinted": TEXT, "body": TEXT,
    "own": (FINDING_TYPE, FINDING_ARROW), "noted": (NOTE_TYPE, NOTE_ARROW), "error": TEXT,
}
COPY = {"known": TEXT, "hinted": TEXT, "body": TEXT, "copy": (T.BinaryType(), pa.binary()), "noted": (NOTE_TYPE, NOTE_ARROW), "error": TEXT}


def unit(known: str | None, own=(), place: str | None = None, body: str | None = None, hinted: str | None = None, error: str | None = None, noted=(), member: str = "") -> dict:
    return {"member": member, "known": known, "place": place, "hinted": hinted, "body": body, "own": [*own], "noted": [*noted], "error": error}


def opened(data: bytes, hint: str | None) -> Iterator[dict]:
    """The units of a file."""
    picture = image_format(data)
    if data.startswith(b"%PDF"):
        pdf = Pdf(data)
        yield unit("pdf", pdf.rows())
        yield from (unit("pdf", place=place, body=text) for place, text in pdf.bodies())
    elif data.startswith(b"PK\x03\x04"):
        parts = unzipped(data)
        if package_format(parts) == "zip":
            yield from archived(parts)
            return
        package = Package(parts)
        yield unit(package.format, package.rows())
        yield from (unit(package.format, place=place, body=text) for place, text in package.bodies())
    elif picture:
        yield unit(picture, image_rows(data, IMAGE_PLACES[picture]))
    else:
        reason = None if hint == "text" else refusal(data)
        if reason:
            raise Refused(reason)
        try:
            yield unit(None, body=data.decode(), hinted=hint)
        except UnicodeDecodeError as e:
            raise Refused("not-utf8") from e


def archived(parts: dict[str, bytes]) -> Iterator[dict]:
    found, cut = members(parts)
    noted = [{"code": "limit:archive-truncated", "detail": f"{len(found)} members"}] if cut else []
    yield unit("zip", path_rows([p for p, _ in found]), noted=noted)
    for path, data in found:
        for each in safely(data, hint_for(path)):
            if each["error"] is not None and re.search(TEXTUAL, path):
                # no reader takes it, but its name says text
                rows = content_rows(data.decode("utf-8", "replace"), path)
                each = unit("zip", rows, error=each["error"])
            yield each | {"member": path}


def safely(data: bytes | None, hint: str | None) -> list[dict]:
    """opened(), where whatever goes wrong with hostile bytes is the file's error."""
    if data is None:
        return [unit(None, error="no content")]
    try:
        return list(opened(data, hint))
    except Refused as e:
        return [unit(None, error=str(e))]
    except Exception as e:  # a file can break any reader, and never the job
        return [unit(None, error=f"unreadable: {type(e).__name__}")]


def batches(rows: Iterator[tuple[dict, dict]], names: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size of (key values, other values)."""
    held, size = [], 0
    for keys, values in rows:
        held.append(keys | values)
        size += len(values.get("body") or "") + len(values.get("copy") or b"")
        if len(held) >= BATCH_ROWS or size >= BATCH_SIZE:
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in held], schema)


def each_file(df: DataFrame, keys: tuple[str, ...], columns: dict, read, content: str, hint: Column | None) -> DataFrame:
    """keys and columns of the rows that read(content, hint, error) gives for each file."""
    ship(df.sparkSession)
    hinted = F.lit(None) if hint is None else hint
    failed = F.col("error") if "error" in df.columns else F.lit(None)
    given = df.select(*keys, F.col(content).alias("_content"), hinted.cast("string").alias("_hint"), failed.cast("string").alias("_error"))
    clash = set(keys) & set(columns)
    if clash:
        raise ValueError(f"keys must not be named {sorted(clash)}")
    schema = T.StructType([given.schema[k] for k in keys])
    for name, (kind, _) in columns.items():
        schema = schema.add(name, kind)
    names = [*keys, *columns]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None

        def rows():
            nonlocal out
            for batch in source:
                out = out or pa.schema([*(batch.schema.field(k) for k in keys), *(pa.field(n, t) for n, (_, t) in columns.items())])
                for k in range(batch.num_rows):
                    # one file's bytes at a time become Python objects
                    r = {n: batch.column(n)[k].as_py() for n in given_names}
                    data = r.pop("_content")
                    yield from (({n: r[n] for n in keys}, v) for v in read(data, r["_hint"], r["_error"]))

        feed = rows()
        first = next(feed, None)
        if first is not None:
            yield from batches(chain_one(first, feed), names, out)

    given_names = [*keys, "_content", "_hint", "_error"]
    return given.mapInArrow(run, schema)


def chain_one(first, rest):
    yield first
    yield from rest


def numbered(data: bytes | None, hint: str | None, error: str | None) -> list[dict]:
    found = [unit(None, error=error)] if error is not None else safely(data, hint)
    return [u | {"unit": k} for k, u in enumerate(found)]


def inspect_files(df: DataFrame, *keys: str, content: str = "content", hint: Column | None = None) -> DataFrame:
    """keys, unit, member, format, findings, notes and error: one row for each unit of each file.

    A null content, an unreadable or refused file: unit 0 with an error, a null format and no findings.
    Findings of an archive's members are located behind the member's path.
    """
    units = each_file(df, keys, UNIT, numbered, content, hint)
    held = F.when(F.col("known").isNotNull(), F.struct(F.col("known").alias("format"), "own", "place"))
    rows = inspect_text(units, "body", F.col("hinted"), container=held)
    told = F.transform("findings", lambda f: f.withField("location", F.concat("member", F.lit(" → "), f["location"])))
    scope = F.create_map(*(F.lit(x) for f, s in SCOPES.items() for x in (f, f"scope:{s}")))[F.col("format")]
    notes = F.when((F.col("unit") == 0) & scope.isNotNull(), F.array(F.struct(scope.alias("code"), F.lit(None).cast("string").alias("detail"))))
    notes = F.concat(F.coalesce("noted", F.array().cast(NOTE)), F.coalesce(notes, F.array()).cast(NOTE))
    located = F.when(F.col("member") != "", told).otherwise(F.col("findings"))
    return rows.select(*keys, "unit", "member", "format", located.alias("findings"), notes.alias("notes"), "error")


def file_findings(df: DataFrame, *keys: str, content: str = "content", hint: Column | None = None) -> DataFrame:
    """One row for each finding. A file's report has them by conf_rank, then unit, then ord."""
    rows = exploded(inspect_files(df, *keys, content=content, hint=hint), F.col("findings"), *keys, "unit", "format")
    return rows.withColumn("affects_verifiability", F.col("label") == "C2PA content credentials")


def summarize_files(df: DataFrame, *keys: str, content: str = "content", hint: Column | None = None) -> DataFrame:
    """keys, format, error, number of findings, whether one is confirmed, provenance and verdict: one row for each file.

    The one shuffle is by the keys, and carries the findings of a file, not its texts.
    """
    units = inspect_files(df, *keys, content=content, hint=hint)
    all_ = F.transform(F.array_sort(F.collect_list(F.struct("unit", "findings"))), lambda u: u["findings"])
    files = units.groupBy(*keys).agg(
        F.flatten(all_).alias("findings"), F.max(F.when(F.col("unit") == 0, F.col("format"))).alias("format"), F.max(F.when(F.col("unit") == 0, F.col("error"))).alias("error")
    )
    p = let(F.col("findings"), provenance)
    confirmed = F.exists("findings", lambda f: f["confidence"] == "confirmed")
    rows = files.select(*keys, "format", "error", F.size("findings").alias("n_findings"), confirmed.alias("confirmed"), p.alias("p"))
    return rows.select(*keys, "format", "error", "n_findings", "confirmed", "p.*", verdict(F.col("p")).alias("verdict"))


def copied(data: bytes | None, hint: str | None, error: str | None) -> list[dict]:
    """The cleaned copy of a file, or its text for the text columns."""
    nothing = {"known": None, "hinted": hint, "body": None, "copy": None, "noted": [], "error": error}
    if error is not None or data is None:
        return [nothing | {"error": error or "no content"}]
    try:
        return [nothing | cleaned_copy(data, hint)]
    except Refused as e:
        return [nothing | {"error": str(e)}]
    except Exception as e:  # a file can break any reader, and never the job
        return [nothing | {"error": f"unreadable: {type(e).__name__}"}]


def cleaned_copy(data: bytes, hint: str | None) -> dict:
    picture = image_format(data)
    if data.startswith(b"%PDF"):
        return {"known": "pdf", "copy": Pdf(data).redacted()}
    if data.startswith(b"PK\x03\x04"):
        package = Package(unzipped(data))
        if package.format == "zip":
            raise Refused("plain archives are inspected but not rewritten")
        notes = package.redact(cleaned)
        return {"known": package.format, "copy": package.packed(), "noted": [{"code": c, "detail": d} for c, d in notes]}
    if picture:
        signed = any(r["label"] == "C2PA content credentials" for r in image_rows(data, ""))
        return {"known": picture, "copy": stripped(data), "noted": [{"code": "removed:c2pa", "detail": None}] if signed else []}
    (text,) = opened(data, hint)
    return {"body": text["body"]}


def redact_files(df: DataFrame, *keys: str, content: str = "content", hint: Column | None = None) -> DataFrame:
    """keys, format, cleaned (bytes), notes and error: one row for each file; originals aren't touched.

    A refused or unreadable file and a plain archive: an error and no copy. What a copy still shows is told by
    file_findings() of it.
    """
    rows = redact_text(each_file(df, keys, COPY, copied, content, hint), "body", F.col("hinted"))
    format_ = F.coalesce("known", F.when(F.col("body").isNotNull(), F.col("format")))
    copy = F.coalesce("copy", F.when(F.col("body").isNotNull(), F.encode("cleaned", "UTF-8")))
    return rows.select(*keys, format_.alias("format"), copy.alias("cleaned"), F.col("noted").alias("notes"), "error")


def clean_name(path: Column) -> Column:
    """name.clean.ext for name.ext."""
    return F.regexp_replace(path, r"^((?:.*/)?[^/]+?)(\.[^./]*)?$", "$1.clean$2")
