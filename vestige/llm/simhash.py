"""SimHash fingerprints and near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints link at ``radius`` 3 or fewer differing bits. The 64 bits are cut into three
blocks. If the block with the most differing bits is left out, at most two differing bits remain in
the other two, so two fingerprints that both emit their kept bits and all variants of these at one
bit (half the remaining radius) meet in at least one variant. That is 131 rows for each distinct
fingerprint, instead of the 2,081 of a ball of radius two over all bits, and keys of 42 or 43 bits.

Equal fingerprints are merged before the shuffle, so copies cost nothing there. Inside a bucket,
pairs are verified on all 64 bits, by a search that compares each member only with members it
hasn't reached yet, and only the links of a spanning forest leave the bucket: no link between
different fingerprints is lost from the components, and no group is expanded into all its pairs.
A bucket's size is bounded by its key: its members differ in 21 or 22 bits only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, row_key, written
from .components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: First bit and width of the blocks.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Shingles whose bits are counted at once.
STEP = 16_384
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: a bit is set if it is set in over half the shingles' hashes."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    total = np.zeros(64, dtype=np.int64)
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_digest  # big-endian bytes
    for k in range(0, n, STEP):
        part = words[k : k + STEP + shingle - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        raw = b"".join([digest(x, SEED) for x in joined])
        total += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.asarray(found, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def _masks() -> list[np.ndarray]:
    """For each block left out, what is xored into the kept bits: nothing, or one of them."""
    bits = [np.uint64(1) << np.arange(first, first + width, dtype=np.uint64) for first, width in BLOCKS]
    return [np.concatenate([[np.uint64(0)], *(b for j, b in enumerate(bits) if j != k)]).astype(np.uint64) for k in range(len(BLOCKS))]


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masks = _masks()
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for k, ((first, width), flips) in enumerate(zip(BLOCKS, masks, strict=True)):
            hole = np.uint64(((1 << width) - 1) << first)
            # the hole's bits hold the block's number, as keys of different blocks must not meet
            kept = (fps & ~hole) | np.uint64((k + 1) << first)
            for part in range(0, len(fps), 4096):
                keys = (kept[part : part + 4096, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(np.repeat(fps[part : part + 4096], len(flips)).view(np.int64))],
                    names=["key", "fp"],
                )


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a spanning forest of distinct fingerprints, linked at radius or fewer bits."""
    links: list[tuple[int, int]] = []
    left = np.sort(fps)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ (now := queue.pop())) <= radius
            if near.any():
                found = left[near]
                links += [(int(now), int(x)) for x in found]
                queue += list(found)
                left = left[~near]
    return links


def _links(radius: int):
    """Rows come sorted by key; a run of equal keys is a bucket."""

    def found(buckets: list[np.ndarray]) -> pa.RecordBatch:
        links = [x for b in buckets for x in forest(np.unique(b), radius)]
        pairs = np.asarray(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if not len(keys):
                continue
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            ready = []
            if last is not None and keys[0] == last:
                held.append(fps[: starts[1]])
                starts = starts[1:]
            if len(starts) > 1:  # another key begins here
                if sum(map(len, held)) > 1:
                    ready.append(np.concatenate(held))
                sizes = np.diff(starts[:-1])
                ready += [fps[starts[j] : starts[j] + sizes[j]] for j in np.flatnonzero(sizes > 1)]
                last, held = keys[-1], [fps[starts[-2] :].copy()]
            if ready:
                yield found(ready)
        if sum(map(len, held)) > 1:
            yield found([np.concatenate(held)])

    return run


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct links (a, b) of spanning forests over the distinct fingerprints in column fp."""
    if radius != RADIUS:
        raise ValueError("the blocks are cut for a radius of 3")
    keyed = distinct.select("fp").mapInArrow(_variants, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links(radius), "a long, b long").distinct()


def classes(marked: DataFrame) -> DataFrame:
    """(fp, component, component_id, n_links) of every distinct fingerprint of (doc_id, fp).

    component is the least fingerprint of the component.
    """
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = written(links(distinct), "simhash-links")
    labels = components(edges)
    ends = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    linked = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    # written, so that both sides of a join with it are dealt anew and a fingerprint of many copies can be split
    found = linked.join(smallest, "component").join(ends, "fp", "left").select("fp", "component", "component_id", "n_links")
    return written(found, "simhash-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links) of every row.

    fingerprint is 16 lowercase hexadecimal digits; component_id is the smallest doc_id reachable
    over links, the row's own included; n_links counts the other distinct fingerprints that the
    component's forest links to this one.

    Defined results: null and word-less texts have fingerprint zero, which links like any other;
    null ids are kept and never a component's smallest id unless it has no other; repeated rows
    each give a row; an empty table gives none; other columns of the input are ignored.
    """
    marked = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    return marked.join(classes(marked), "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of docs, with all its columns, of each component: that of the smallest id.

    Of rows of equal id one stays, and a null id only where a component has no other.
    """
    key = row_key(F.col(id_col), F.col(text_col))
    keyed = docs.select(F.struct(key.alias("row"), F.col(id_col).alias("id")).alias("doc_id"), F.col(text_col).alias("text"))
    marked = written(fingerprints(keyed, "doc_id", "text", shingle).select("doc_id.*", "fp"), "simhash-rows")
    groups = classes(marked.select(F.col("row").alias("doc_id"), "fp")).select("fp", "component")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    first = marked.join(groups, "fp").groupBy("component").agg(least.alias("first")).select(F.col("first.row").alias("kept_row"))
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), key.alias("kept_row"))
    one = W.partitionBy("kept_row").orderBy("kept_row")
    stay = rows.join(first, "kept_row", "left_semi").withColumn("kept_number", F.row_number().over(one)).where("kept_number = 1")
    return stay.select("row.*")
