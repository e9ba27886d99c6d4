"""Byte-level BPE over whole texts, with long texts encoded as overlapping chunks.

A text of at most ``chunk_chars`` characters is encoded in one go. A longer one is cut into chunks
that overlap by ``overlap`` characters; every chunk is pre-tokenised on its own, in parallel. Two
neighbouring chunks resynchronise at a position of their overlap where both have a pre-token
boundary: the first chunk's boundaries are those of the whole text there, and from a true boundary
on the second one's are, too. A stitch has to stand without what follows it, so it comes after a
character that is no white space (a run of white space looks ahead to what ends it) and lies
``MARGIN`` characters before the end of the overlap at least, as the cut may split a contraction.
The piece of a chunk runs from its own stitch to the next one's; chunks and pieces are dealt by
document and number, so one document uses many tasks, and the ids are joined in order. Where an
overlap has no stitch (one pre-token, or white space, longer than the overlap), that document is
encoded whole instead, with the same result.

Defined results: a null text counts as empty; an empty text has no tokens and the digests of the
empty string; repeated rows each give a row; other columns of the input are ignored. Patterns may
look ahead from white space only, as those of public tokenizers do.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

CHUNK_CHARS = 65_536
OVERLAP = 1_024
#: Characters before a chunk's end where its boundaries aren't trusted.
MARGIN = 16
#: Added to a stitch beside a character that isn't ASCII, whose class libraries may see differently: the others come first.
WIDE = 1 << 24


@cache
def encoder(path: str, pattern: str):
    """The encoder of a rank file; one for each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def packed(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def stitches(text: str, pattern: str, low: int, high: int) -> list[int]:
    """Boundaries from low to high of a chunk that stand without what follows them; those beside wide characters plus WIDE."""
    out = []
    for m in splitter(pattern).finditer(text):
        end = m.end()
        if end > high:
            break
        if end >= low and not text[end - 1].isspace():
            out.append(end if text[end - 1 : end + 1].isascii() else end + WIDE)
    return out


def _encode_whole(path: str, pattern: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            n, ids_out, raw_out = [], [], []
            for text in batch.column("text").to_pylist():
                ids = enc.encode_ordinary(text or "")
                n.append(len(ids))
                blob, raw = packed(ids), enc.decode_bytes(ids)
                ids_out.append(hashlib.sha256(blob).hexdigest() if digests else blob)
                raw_out.append(hashlib.sha256(raw).hexdigest() if digests else raw)
            kind = pa.string() if digests else pa.binary()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_out, kind), pa.array(raw_out, kind)],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return run


def _pretokenise(pattern: str, chunk_chars: int, overlap: int):
    """Stitches that a chunk offers in the overlaps before (head) and after it (tail), as places in the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = overlap - MARGIN
        for batch in batches:
            heads, tails = [], []
            for text, i, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "i", "n")), strict=True):
                heads.append(stitches(text, pattern, 1, most) if i else [])
                tails.append([e - chunk_chars for e in stitches(text, pattern, chunk_chars + 1, chunk_chars + most)] if i < n - 1 else [])
            kind = pa.list_(pa.int32())
            columns = [*(batch.column(c) for c in ("key", "i", "n")), pa.array(heads, kind), pa.array(tails, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "i", "n", "head", "tail"])

    return run


def _encode_pieces(path: str, pattern: str, chunk_chars: int):
    """Encodes the piece of a chunk between its stitches; nothing where one is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            ids_out, raw_out, oks = [], [], []
            for text, i, n, start, end in zip(*(batch.column(c).to_pylist() for c in ("chunk", "i", "n", "start", "cut")), strict=True):
                first = 0 if i == 0 else None if start is None else start % WIDE
                last = len(text) if i == n - 1 else None if end is None else chunk_chars + end % WIDE
                oks.append(ok := first is not None and last is not None)
                ids = enc.encode_ordinary(text[first:last]) if ok else []
                ids_out.append(packed(ids))
                raw_out.append(enc.decode_bytes(ids))
            own = [*(batch.column(c) for c in ("key", "i")), pa.array(ids_out, pa.binary()), pa.array(raw_out, pa.binary()), pa.array(oks, pa.bool_())]
            yield pa.RecordBatch.from_arrays(own, names=["key", "i", "ids", "decoded", "ok"])

    return run


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digests: bool = False,
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP,
) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row.

    ids are little-endian unsigned 32-bit integers and decoded the bytes they stand for, both as
    binary; with ``digests`` they are lowercase SHA-256 digests of these instead.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = "string" if digests else "binary"
    whole = f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids {kind}, decoded {kind}"
    short = rows.where(F.length("text") <= chunk_chars)
    result = short.mapInArrow(_encode_whole(path, pattern, digests), whole)

    if overlap <= MARGIN or overlap > chunk_chars:
        raise ValueError(f"overlap must be over {MARGIN} and at most chunk_chars")
    # rows alike in id and text share a key of 128 bits and are encoded once
    said = F.concat(F.col("doc_id").isNull().cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text"))
    long = rows.where(F.length("text") > chunk_chars).withColumn("key", F.md5(said))
    n = F.ceil((F.length("text") - overlap) / chunk_chars).cast("int")
    chunks = (
        long.withColumn("n", n)
        .select("key", "doc_id", "n", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
        .select("key", "doc_id", "n", "i", F.substr("text", F.col("i") * chunk_chars + 1, F.lit(chunk_chars + overlap)).alias("chunk"))
        .groupBy("key", "i")
        .agg(F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("doc_id", "n", "chunk")))
    )
    cut = chunks.select("key", "i", "n", "chunk").mapInArrow(
        _pretokenise(pattern, chunk_chars, overlap), "key string, i int, n int, head array<int>, tail array<int>"
    )
    # small rows: the stitches offered on both sides of an overlap meet under the number of the chunk before it
    offers = cut.select("key", "i", F.col("tail").alias("before"), F.lit(None).cast("array<int>").alias("after")).unionByName(
        cut.where("i > 0").select("key", (F.col("i") - 1).alias("i"), F.lit(None).cast("array<int>").alias("before"), F.col("head").alias("after"))
    )
    met = offers.groupBy("key", "i").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    cuts = met.select("key", "i", F.array_min(F.array_intersect("before", "after")).alias("cut"))
    starts = cuts.select("key", (F.col("i") + 1).alias("i"), F.col("cut").alias("start"))
    pieces = chunks.join(cuts, ["key", "i"], "left").join(starts, ["key", "i"], "left")
    done = pieces.select("key", "i", "n", "chunk", "start", "cut").mapInArrow(
        _encode_pieces(path, pattern, chunk_chars), "key string, i int, ids binary, decoded binary, ok boolean"
    )
    ordered = F.array_sort(F.collect_list(F.struct("i", F.hex("ids").alias("ids"), F.hex("decoded").alias("decoded"))))
    joined = done.groupBy("key").agg(F.min("ok").alias("ok"), ordered.alias("parts"))
    blob = {c: F.unhex(F.array_join(F.col(f"parts.{c}"), "")) for c in ("ids", "decoded")}
    named = chunks.where("i = 0").select("key", "doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    stitched = named.join(joined.where("ok"), "key").select("doc_id", *(v.alias(c) for c, v in blob.items()))
    result = result.unionByName(
        stitched.select(
            "doc_id",
            (F.length("ids") / 4).cast("long").alias("n_tokens"),
            *((F.sha2(c, 256) if digests else F.col(c)).alias(c) for c in ("ids", "decoded")),
        )
    )
    unstitched = long.join(joined.where(~F.col("ok")).select("key"), "key", "left_semi").select("doc_id", "text")
    return result.unionByName(unstitched.mapInArrow(_encode_whole(path, pattern, digests), whole))
