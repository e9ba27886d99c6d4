"""Token counts of fields and sections from one encoding of the whole document.

A document is its fields, one after the other with a newline between two; each line of a field is a
section and owns its newline. The whole is encoded once. The tokens' byte spans, made of the
lengths of their bytes, are joined with the sections' spans, both sorted, by binary search. A token
over a boundary goes by an explicit rule to one section: ``start`` to the one of its first byte,
``end`` to that of its last, ``most`` to the one with most of its bytes (the first of equals). So
the counts of a document's sections add up to its tokens.

Defined results: null fields count as empty and still have one section, empty but for its newline;
the last field's last section has none. Repeated rows each give their rows; an empty table gives
none; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import prepare

RULES = ("start", "end", "most")
COUNTS = "field string, section int, start long, n_chars long, n_tokens long, n_crossing long"


def owners(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token span, and whether it crosses a boundary; sections are their starts."""
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, np.maximum(ends - 1, starts), "right") - 1
    crossing = first != last
    if rule == "start" or not crossing.any():
        return first, crossing
    if rule == "end":
        return last, crossing
    owner, bounds = first.copy(), np.append(sections, np.iinfo(np.int64).max)
    for k in np.flatnonzero(crossing):
        inside = [min(ends[k], bounds[s + 1]) - max(starts[k], bounds[s]) for s in range(first[k], last[k] + 1)]
        owner[k] = first[k] + int(np.argmax(inside))
    return owner, crossing


def _count(fields: list[str], path: str, pattern: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        sizes = np.zeros(enc.max_token_value + 1, dtype=np.int64)
        for token, rank in enc._mergeable_ranks.items():
            sizes[rank] = len(token)
        for batch in batches:
            owner, parts = [], []
            for row, values in enumerate(zip(*(batch.column(f).to_pylist() for f in fields), strict=True)):
                raw = [(v or "").encode() for v in values]
                whole = b"\n".join(raw)
                data = np.frombuffer(whole, dtype=np.uint8)
                breaks = np.flatnonzero(data == 10) + 1
                sections = np.concatenate([[0], breaks])
                field_starts = np.cumsum([0, *(len(r) + 1 for r in raw[:-1])])
                field = np.searchsorted(field_starts, sections, "right") - 1
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                ends = np.cumsum(sizes[enc.encode_ordinary(whole.decode())])
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                of, crossing = owners(starts, ends, sections, rule)
                stops = np.append(sections[1:], len(data))
                number = np.arange(len(sections)) - np.searchsorted(field, field)
                owner.append(np.full(len(sections), row))
                parts.append(
                    np.stack(
                        [
                            field,
                            number,
                            chars[sections],
                            chars[stops] - chars[sections],
                            np.bincount(of, minlength=len(sections)),
                            np.bincount(of, crossing, minlength=len(sections)).astype(np.int64),
                        ]
                    )
                )
            cells = np.concatenate(parts, axis=1) if parts else np.zeros((6, 0), dtype=np.int64)
            at = pa.array(np.concatenate(owner) if owner else np.zeros(0, dtype=np.int64))
            names = pa.array(fields, pa.string()).take(pa.array(cells[0]))
            columns = [batch.column("doc_id").take(at), names, pa.array(cells[1].astype(np.int32)), *(pa.array(c) for c in cells[2:])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "field", "section", "start", "n_chars", "n_tokens", "n_crossing"])

    return run


def count_tokens(
    docs: DataFrame, path: str, pattern: str, fields: list[str], id_col: str = "doc_id", rule: str = "start"
) -> DataFrame:
    """(doc_id, field, section, start, n_chars, n_tokens, n_crossing), a row for each section.

    start is in characters of the whole document; n_crossing counts those of its tokens that reach
    into another section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), *(F.col(f).cast("string").alias(f"field_{f}") for f in fields))
    named = rows.toDF("doc_id", *fields) if "doc_id" not in fields else rows.toDF("doc_id", *(f if f != "doc_id" else "doc_id_text" for f in fields))
    names = named.columns[1:]
    return named.mapInArrow(_count(names, path, pattern, rule), f"doc_id {dict(rows.dtypes)['doc_id']}, {COUNTS}")
