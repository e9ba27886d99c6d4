"""Packing: documents are laid end to end and cut every ``length`` tokens.

Pass one encodes every document once, keeps a running total inside each input partition and
writes ids with their partition-local offsets to a table in the shared folder. The partition
totals (one row for each input split) get prefix sums, which turn local offsets into global ones.
Pass two cuts every document where its global range crosses a multiple of ``length``. Each piece
is a boundary record of a fixed window; only the very last window can be short, so padding is
below one window for the whole corpus.

Defined results: a null text counts as empty and packs only its end token; repeated rows are
packed each; an empty table gives no pieces; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, written

LENGTH = 2048
END_ID = 1
#: Words, and pre-tokens of words, whose ids a Python worker remembers; it starts afresh beyond that.
REMEMBERED, REMEMBERED_PARTS = 400_000, 700_000
#: Words for which lower case and pre-tokens can be found without the tokenizer, and their pre-tokens.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PLAIN_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: The pattern of a tokenizer that PLAIN_PARTS follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level tokenizers write for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordIds:
    """Ids of a text by a tokenizer whose pre-tokens never span ASCII white space.

    Words between ASCII white space are encoded once each and remembered, as the tokenizer drops
    white space and its other steps look at one word at a time. Of a new word in Latin letters only
    the pre-tokens not met before are encoded, by the tokenizer's model alone; that holds for a
    tokenizer of NFC, lower case and PATTERN. Any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        patterns = [x.get("pattern", {}).get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and patterns == [PATTERN, None]
        self.letters = str.maketrans(byte_letters())
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))
        ids = self.parts[part] = np.asarray([t.id for t in tokens], dtype="<u2").tobytes()
        return ids

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        if len(self.parts) > REMEMBERED_PARTS:
            self.parts.clear()
        known, parts, other = self.known, self.parts, []
        for word in words:
            if word not in known:
                text = word.decode()
                if self.plain and PLAIN.fullmatch(text):
                    found = PLAIN_PARTS.findall(text.lower())
                    known[word] = b"".join([parts.get(p) or self.part(p) for p in found])
                else:
                    other.append(word)
        for k in range(0, len(other), 4096):
            part = other[k : k + 4096]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            known.update((w, np.asarray(e.ids, dtype="<u2").tobytes()) for w, e in zip(part, found, strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 16-bit integers."""
        out = []
        for text in texts:
            words = (text or "").encode().split()
            try:
                out.append(b"".join(map(self.known.__getitem__, words)))
            except KeyError:
                self.learn(set(words))
                out.append(b"".join(map(self.known.__getitem__, words)))
        return out


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, at, part = word_ids(path), 0, TaskContext.get().partitionId()
        end = np.asarray([end_id], dtype="<u2").tobytes()
        for batch in batches:
            blobs = [ids + end for ids in words.encode(batch.column("text").to_pylist())]
            counts = np.fromiter((len(b) // 2 for b in blobs), dtype=np.int64, count=len(blobs))
            starts = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(len(blobs), part, dtype=np.int32)),
                    pa.array(starts),
                    pa.array(counts),
                    pa.array(blobs, pa.binary()),
                ],
                names=["doc_id", "part", "local", "doc_tokens", "ids"],
            )

    return run


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, piece_ids = [], []
            for k, (first, count, blob) in enumerate(
                zip(*(batch.column(c).to_pylist() for c in ("first", "doc_tokens", "ids")), strict=True)
            ):
                ids = np.frombuffer(blob, dtype="<u2").astype("<u4")
                at = 0
                while at < count:
                    window, offset = divmod(first + at, length)
                    take = min(length - offset, count - at)
                    piece = ids[at : at + take].tobytes()
                    rows.append((k, at, take, zlib.crc32(piece), count, window, offset))
                    piece_ids.append(piece)
                    at += take
            cells = np.asarray(rows, dtype=np.int64).reshape(-1, 7)
            columns = [batch.column("doc_id").take(pa.array(cells[:, 0])), *(pa.array(cells[:, c]) for c in range(1, 7))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array(piece_ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    ids, if asked for, are little-endian unsigned 32-bit integers.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    encoded = written(
        rows.mapInArrow(_encode(path, end_id), f"doc_id {kind}, part int, local long, doc_tokens long, ids binary"), "packing"
    )
    totals = encoded.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    # one row for each input split, some bytes each: 100 TB in splits of 128 MB are 13 MB
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    placed = encoded.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local")).alias("first"), "doc_tokens", "ids")
    return placed.mapInArrow(_cut(length, with_ids), f"doc_id {kind}, {PIECE}" + ", ids binary" * with_ids)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids array<long>) from pieces with ids, padded to ``length`` except at a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), dtype="<u4").astype(np.int64)
                short = length - len(ids) if len(ids) & (len(ids) - 1) else 0
                out.append(np.pad(ids, (0, short), constant_values=pad_id))
            yield pa.RecordBatch.from_arrays(
                [batch.column("sequence_id"), pa.array(out, pa.list_(pa.int64()))], names=["sequence_id", "ids"]
            )

    parts = F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    return pieces.groupBy("sequence_id").agg(parts).mapInArrow(run, "sequence_id long, ids array<long>")
