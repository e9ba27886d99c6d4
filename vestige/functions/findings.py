"""Findings as Columns: an array of structs for each row, in the order a report has."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import SPACE

FINDING = "array<struct<kind: string, confidence: string, location: string, label: string, value: string>>"
FINDING_TYPE = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "confidence", "location", "label", "value")]))
RANKS = {"confirmed": 0, "probable": 1, "informational": 2}


def text(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def finding(kind, confidence, location, label, value) -> Column:
    fields = {"kind": kind, "confidence": confidence, "location": location, "label": label, "value": value}
    return F.struct(*(text(v).cast("string").alias(k) for k, v in fields.items()))


def none() -> Column:
    return F.array().cast(FINDING)


def when(condition: Column, *rows: Column) -> Column:
    """These findings if the condition holds."""
    return F.when(condition, F.array(*rows).cast(FINDING)).otherwise(none())


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def either(conditions: list[Column]) -> Column:
    return functools.reduce(Column.__or__, conditions)


def trim(value: Column) -> Column:
    return F.regexp_replace(value, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def utf16_length(value: Column) -> Column:
    """Length in UTF-16 units, which is what JavaScript counts."""
    return (F.length(F.encode(value, "UTF-16BE")) / 2).cast("int")


def preview(value: Column, most: int = 72) -> Column:
    """White space folded and trimmed, cut after so many characters."""
    flat = trim(F.regexp_replace(value, f"[{SPACE}]+", " "))
    return F.when(utf16_length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most), F.lit("…")))


def code_point(char: Column) -> Column:
    """U+XXXX of a character."""
    digits = F.hex(F.ascii(char))
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def tally(chars: Column) -> Column:
    """Distinct values with counts, most frequent first, then in the order met: struct(c, n, at)."""

    def count(all_: Column) -> Column:
        rows = F.transform(F.array_distinct(all_), lambda c, i: F.struct((-F.size(F.filter(all_, lambda x: x == c))).alias("n"), i.alias("at"), c.alias("c")))
        return F.transform(F.array_sort(rows), lambda r: F.struct(r["c"].alias("c"), (-r["n"]).alias("n"), r["at"].alias("at")))

    return let(chars, count)


def first_each(rows: Column) -> Column:
    """Of findings alike in label and value, the first."""

    def of(all_: Column) -> Column:
        return F.filter(
            all_, lambda r, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda o: (o["label"] == r["label"]) & (o["value"] == r["value"]))
        )

    return let(rows, of)


def by_confidence(rows: Column) -> Column:
    """The findings in a stable order of confidence."""

    def level(all_: Column, name: str) -> Column:
        return F.filter(all_, lambda r: r["confidence"] == name)

    return let(rows, lambda all_: F.concat(*(level(all_, c) for c in RANKS)))


def exploded(df: DataFrame, rows: Column, *keys: str) -> DataFrame:
    """One row for each finding, with ord, conf_rank and whether it is about structure."""
    each = df.select(*keys, F.posexplode(rows).alias("ord", "f")).select(*keys, "ord", "f.*")
    rank = F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair))[F.col("confidence")]
    return each.withColumns({"conf_rank": rank, "structural": F.col("location").rlike(r"\bstructure$")})
