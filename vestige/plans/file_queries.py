"""Registered queries over files that are built from the texts of the test tables."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import DOUBTFUL_SIGNATURES, SIGNATURES
from ..functions.patterns import SOURCE_TYPE, SOURCE_TYPES
from ..sources import files
from . import filepipe
from .queries import DOCS_SQL, docs, quoted, register, table

PNG_HEAD = "89504E470D0A1A0A" + "0000000D" + b"IHDR".hex() + "00" * 17
PNG_TAIL = "00000000" + b"IEND".hex() + "00" * 4

# what stands before a text, by its key's remainder: every signature, then what the other steps of the guard refuse
FRONTS = [*SIGNATURES, *((m + b"\x01", n) for m, n in DOUBTFUL_SIGNATURES), *((m, None) for m, _ in DOUBTFUL_SIGNATURES)]
BEFORE = [(m, n and f"signature: {n}") for m, n in FRONTS] + [(b"\0", "nul-bytes"), (b"\x02" * 500, None), (b"\xff", "not-utf8"), (b"", None)]


@register(
    "guarded_decode",
    f"""SELECT doc_id, CASE doc_id % {len(BEFORE)} {' '.join(f'WHEN {k} THEN {quoted(r)}' for k, (_, r) in enumerate(BEFORE) if r)}
          WHEN {len(BEFORE) - 3} THEN CASE WHEN 500.0 / least(8192, 500 + octet_length(encode(text))) > 0.05 THEN 'control-dense' END END AS reason FROM documents""",
)
def guarded_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    filepipe.ship(spark)
    front = F.lit(b"")
    for k, (magic, _) in enumerate(BEFORE):
        front = F.when(F.col("doc_id") % len(BEFORE) == k, F.lit(magic)).otherwise(front)
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(front, F.encode("text", "UTF-8")).alias("content"))
    return d.select("doc_id", files.refused(F.col("content")).alias("reason"))


def commented_png(text: Column) -> Column:
    """A PNG whose comment is the text."""
    body = F.concat(F.lit(b"Comment\0"), F.encode(text, "UTF-8"))
    size = F.unhex(F.lpad(F.hex(F.octet_length(body)), 8, "0"))
    return F.concat(F.unhex(F.lit(PNG_HEAD)), size, F.lit(b"tEXt"), body, F.unhex(F.lit("00" * 4 + PNG_TAIL)))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", commented_png(F.col("t")).alias("content"))


DECLARED = {t: (s, c) for t, s, _, c in SOURCE_TYPES if t in ("trainedAlgorithmicMedia", "digitalArt")}


@register(
    "picture_findings",
    f"""SELECT doc_id, 'png' AS format, 'identity' AS kind, 'probable' AS confidence, 'PNG tEXt chunk' AS label,
          (octet_length(encode(t)) + 20)::VARCHAR || ' bytes' AS value FROM {DOCS_SQL}
        {' '.join(f"UNION ALL SELECT doc_id, 'png', 'provenance', '{c}', {quoted(SOURCE_TYPE)}, {quoted(f'{t} — {s}')} FROM documents WHERE doc_id % 17 = 11" for t, (s, c) in DECLARED.items())}""",
)
def picture_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filepipe.file_findings(pictures(spark, sf_dir), "doc_id")
    return found.select("doc_id", "format", "kind", "confidence", "label", "value")


@register(
    "cleaned_pictures",
    f"SELECT doc_id, 'png' AS format, sha256(unhex('{PNG_HEAD + PNG_TAIL}')) AS cleaned_sha256 FROM documents",
)
def cleaned_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filepipe.redact_files(pictures(spark, sf_dir), "doc_id").select("doc_id", "format", F.sha2("cleaned", 256).alias("cleaned_sha256"))


def packed(author: pd.Series, text: pd.Series) -> pd.Series:
    def one(who: str, body: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("docProps/core.xml", f"<cp:coreProperties><dc:creator>{escape(who or '')}</dc:creator><cp:revision>3</cp:revision></cp:coreProperties>")
            archive.writestr("word/document.xml", f"<w:p><w:t>{escape(body or '')}</w:t></w:p>")
        return out.getvalue()

    return pd.Series([one(a, t) for a, t in zip(author, text)])


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text package of each document, with its source for an author."""
    make = F.pandas_udf(packed, T.BinaryType())
    d = table(spark, sf_dir, "documents")
    filepipe.ship(spark)
    return d.select("doc_id", make("source", "text").alias("content"))


@register(
    "package_authors",
    """SELECT doc_id, 'docx' AS format, 'docProps/core.xml:dc:creator' AS location, 'Author' AS label, trim(source) AS value FROM documents WHERE trim(source) <> ''
       UNION ALL SELECT doc_id, 'docx', 'docProps/core.xml:cp:revision', 'Revision number', '3' FROM documents""",
)
def package_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filepipe.file_findings(packages(spark, sf_dir), "doc_id")
    return found.where(F.col("location").startswith("docProps/core.xml:")).select("doc_id", "format", "location", "label", "value")


@register(
    "package_summaries",
    """SELECT doc_id, 'docx' AS format, NULL::VARCHAR AS error, (1 + (trim(source) <> '')::INT)::INT AS n_findings, coalesce(trim(source) <> '', false) AS confirmed,
        '' AS tools, false AS attributed, false AS declared, false AS machine_assembled, 'none' AS verdict FROM documents""",
)
def package_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every package's findings and verdict; its text is scanned, too, and holds nothing."""
    return filepipe.summarize_files(packages(spark, sf_dir), "doc_id").withColumn("tools", F.array_join("tools", "; "))
