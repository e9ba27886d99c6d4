"""Whole inspections of texts as one projection, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import ARRANGEMENT, KEPT_PLACES, KIND, clean_text, decoded, normal_forms, scan_text
from ..functions.content import find_source_types, fingerprint, provenance, scan_content, verdict
from ..functions.findings import FINDING, by_confidence, exploded, finding, let
from ..functions.mail import email_headers, strip_tool_headers
from ..functions.markup import detect_format, own_findings, redact_markup, visible_text
from ..functions.patterns import BODY_TEXT
from ..shipping import ship

PLACE, BODY = "file contents", "document body"
#: Columns that an inspection makes for itself.
OWN = ["_text", "_body", "_forms", "_hidden", "_scan", "_found", "_given", "_derived", "_container"]
#: What a file's reader found: its format, its findings, and the place whose text the row holds.
CONTAINER = f"struct<format: string, own: {FINDING}, place: string>"


def found() -> Column:
    """Findings before fingerprinting, in the order of a report, from the columns in OWN."""
    text, body, plain, markdown = F.col("_text"), F.col("_body"), F.col("format") == "text", F.col("format") == "markdown"
    place = F.when(plain, PLACE).otherwise(BODY)
    # the lines of SVG and HTML belong to the markup
    kept = F.filter("_scan", lambda f: plain | markdown | ~f["location"].isin(ARRANGEMENT))

    def placed(f: Column) -> Column:
        where = F.when(plain, f["location"]).otherwise(F.concat(F.lit("document body ("), f["location"], F.lit(")")))
        return finding(f["kind"], f["confidence"], where, f["label"], f["value"])

    scanned = F.transform(kept, placed).cast(FINDING)
    label = F.when(plain, "Hidden payload in text").otherwise("Hidden payload in document text")
    hidden = F.transform("_hidden", lambda x: finding(KIND, "confirmed", place, label, x)).cast(FINDING)
    types = find_source_types(text, F.when(plain, PLACE).otherwise("metadata"))
    contents = scan_content(text, place)
    held = F.col("_container")
    # glyphs are laid out by the producer of a PDF, so what only informs says nothing there
    said = F.filter("_scan", lambda f: ~f["location"].isin(ARRANGEMENT) & ((held["format"] != "pdf") | (f["confidence"] != "informational")))
    where = F.transform(said, lambda f: finding(f["kind"], f["confidence"], F.concat(held["place"], F.lit(" ("), f["location"], F.lit(")")), f["label"], f["value"]))
    payload = F.concat(F.lit("Hidden payload in "), F.when(held["format"] == "pdf", "page text").otherwise("document text"))
    carried = F.transform("_hidden", lambda x: finding(KIND, "confirmed", held["place"], payload, x)).cast(FINDING)
    read = F.concat(F.coalesce(held["own"], F.array().cast(FINDING)), where.cast(FINDING), carried)
    return F.when(held.isNotNull(), read).when(plain, F.concat(scanned, contents, hidden, email_headers(text), types)).otherwise(
        F.concat(own_findings(text, F.col("format")), types, contents, scanned, hidden)
    )


def inspect_text(df: DataFrame, text_col: str = "text", hint: Column | None = None, out: str = "findings", container: Column | None = None) -> DataFrame:
    """df with format and findings columns; a null text has a null format and no findings.

    Rows with a container (a column of type CONTAINER) hold a text taken out of a file, or none: their
    format and first findings are the container's.

    The format decides the reading: svg, html, markdown or text. What several steps need is made a
    column once, so the plan grows with the number of patterns only.
    """
    ship(df.sparkSession)
    held = (F.lit(None) if container is None else container).cast(CONTAINER)
    format_ = F.when(F.col(text_col).isNotNull(), F.coalesce(detect_format(F.col("_text"), hint), F.lit("text")))
    format_ = F.coalesce(F.col("_container.format"), format_)
    rows = df.withColumn("_container", held).withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("format", format_)
    rows = rows.withColumn("_body", F.when(F.col("format").isin("svg", "html"), visible_text(F.col("_text"))).otherwise(F.col("_text")))
    rows = rows.withColumns({"_forms": normal_forms(F.col("_body")), "_hidden": decoded(F.col("_body"))})
    rows = rows.withColumn("_scan", scan_text(F.col("_body"), F.col("_forms"))).withColumn("_found", found())
    place = F.when(F.col("format") == "text", PLACE).otherwise(BODY)
    body = F.array(finding("provenance", "informational", place, BODY_TEXT, F.col("_body"))).cast(FINDING)
    given = F.when(F.col("_container").isNotNull(), F.col("_found")).otherwise(F.concat(F.col("_found"), body))
    # so that no filter is pushed below it, which would derive twice
    rows = rows.withColumn("_given", given).withColumn("_derived", fingerprint.asNondeterministic()(F.col("_given")))
    whole = by_confidence(F.concat(F.col("_found"), F.col("_derived")))
    return rows.withColumn(out, F.when(F.col("format").isNotNull(), whole).otherwise(F.array().cast(FINDING))).drop(*OWN)


def findings(df: DataFrame, *keys: str, text_col: str = "text", hint: Column | None = None) -> DataFrame:
    """One row for each finding of each row of df."""
    return exploded(inspect_text(df, text_col, hint), F.col("findings"), *keys)


def summarize(df: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """Keys with the provenance of each row and a verdict."""
    inspected = inspect_text(df, text_col)
    p = inspected.select(*keys, "format", let(F.col("findings"), provenance).alias("p"))
    return p.select(*keys, "format", "p.*", verdict(F.col("p")).alias("verdict"))


def redact_text(df: DataFrame, text_col: str = "text", hint: Column | None = None, normalize_spaces: bool = False, strip_headers: bool = True) -> DataFrame:
    """df with format, cleaned, removed and kept.

    removed has the labels of the characters that were taken out and the names of the stripped header lines, kept the
    labels of what is arranged or looks alike and stays, as it may be the text's own. Exotic spaces count as removed
    where they are made plain.
    """
    ship(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.withColumn("format", F.coalesce(detect_format(text, hint), F.lit("text")))
    plain, markup = F.col("format") == "text", F.col("format").isin("svg", "html")
    body = F.when(markup, visible_text(text)).otherwise(text)
    found = F.filter(scan_text(body), lambda f: F.lit(normalize_spaces) | (f["confidence"] != "informational") | f["location"].isin(KEPT_PLACES))
    found = F.filter(found, lambda f: ~markup | ~f["location"].isin(ARRANGEMENT))
    rows = rows.withColumn("_found", F.transform(found, lambda f: F.struct(f["label"].alias("label"), f["location"].isin(KEPT_PLACES).alias("stays"))))
    headers = F.array().cast("array<string>")
    cleaned = clean_text(text, normalize_spaces)
    if strip_headers:
        rows = rows.withColumn("_stripped", strip_tool_headers(cleaned))
        cleaned, headers = F.col("_stripped.text"), F.when(plain, F.col("_stripped.removed")).otherwise(headers)
    labels = lambda stays: F.array_distinct(F.transform(F.filter("_found", lambda f: f["stays"] == stays), lambda f: f["label"]))
    rows = rows.withColumns(
        {
            "cleaned": F.when(plain, cleaned).otherwise(redact_markup(text, F.col("format"))),
            "removed": F.concat(labels(False), headers),
            "kept": labels(True),
        }
    )
    return rows.drop("_found", "_stripped")


def survivors(df: DataFrame, *keys: str, cleaned_col: str = "cleaned") -> DataFrame:
    """Keys and the distinct labels of findings that a cleaned text still has, but for informational ones."""
    left = F.filter(F.col("findings"), lambda f: f["confidence"] != "informational")
    labels = F.array_sort(F.array_distinct(F.transform(left, lambda f: f["label"])))
    return inspect_text(df, cleaned_col).select(*keys, labels.alias("labels")).where(F.size("labels") > 0)


def tally(inspected: DataFrame, error_col: str | None = None) -> DataFrame:
    """One row: files, files with a confirmed finding, files that couldn't be read."""
    confirmed = F.exists("findings", lambda f: f["confidence"] == "confirmed")
    failed = F.lit(False) if error_col is None else F.col(error_col).isNotNull()
    return inspected.agg(
        F.count("*").alias("files"), F.count_if(confirmed).alias("with_confirmed"), F.count_if(failed).alias("unreadable")
    )
