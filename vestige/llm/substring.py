"""Substring dedup: words covered by a window of 35 words that starts elsewhere too.

The index is log-structured. Each batch of documents adds one immutable run: the hashes that no run
had before, each with the place where it was met, dealt to buckets by hash and sorted. A new batch is
dealt and sorted alike and merge-joined with the runs, bucket by bucket, so that history is read but
never shuffled again. A match tells both sides that they may repeat, so earlier batches are judged by
later ones, too. When there are more than ``RUNS`` runs, they are merged into one, again without a
shuffle. A batch that is there already isn't added again, so a retry changes nothing.

What is indexed are not all windows but anchors: of the 28 groups of 8 words in a window, the one of
least hash (the last of equals). Equal windows choose equal anchors at equal places, so a window can
only repeat where its anchor does, and there is an anchor for every 14 words or so. Repeated anchors
give candidate windows; those are verified by 95 bits of hash of all their words.

Occurrences that repeat within an Arrow batch are known to repeat at once: only one of them takes
part in the merge by hash, the others are dealt by position. So a passage that a third of all
documents share sends one row for each batch to the task of its hash, not one for each document.

Defined results: a null or empty text has no words and keeps the digest of the empty string; texts
of fewer words than a window lose none; repeated rows repeat each other's windows; rows alike in id
and text get equal results; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, row_key, shared_dir

WINDOW = 35
GRAM = 8
BASE = 0x9E3779B97F4A7C15
FIRST, KNOWN, LEADER = 0, 1, 2
#: Runs of an index at most before they are merged; batches that a whole table is fed in.
RUNS, BATCHES = 4, 3
#: Kinds of rows that a batch leaves: places of repeated anchors, and its run.
HIT, RUN = 0, 1
#: h2 holds further bits of the hash and, in its two lowest bits, the state
OCCURRENCE = "h long, h2 long, rid long, pos int"


def batch_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after the other, and where each text begins."""
    split = [(t or "").encode().split() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w) for words in split for w in words), dtype=np.uint64, count=int(starts[-1]))
    return hashes, starts


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each group of ``width`` consecutive words, built from groups of powers of two."""
    out, done, power, span = None, 0, hashes, 1
    with np.errstate(over="ignore"):
        while True:
            if width & span:
                # groups so far, then the next ``span`` words
                shifted = power[done:]
                n = len(shifted) if out is None else min(len(out), len(shifted))
                out = shifted[:n] if out is None else out[:n] * np.uint64(pow(BASE, span, 1 << 64)) + shifted[:n]
                done += span
            if done == width:
                break
            power = power[:-span] * np.uint64(pow(BASE, span, 1 << 64)) + power[span:] if len(power) > span else power[:0]
            span *= 2
        out = out ^ (out >> np.uint64(29))
        out = out * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def window_starts(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window within one text, and the number of its text."""
    counts = np.maximum(np.diff(starts) - window + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(starts[:-1] - (np.cumsum(counts) - counts), counts)
    return first + np.arange(int(counts.sum())), text


def anchors(hashes: np.ndarray, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the anchor of each window that starts at ``at``, and the hashes of all groups."""
    grams = rolling(hashes, gram)
    if not len(at):
        return at, grams
    width = window - gram + 1
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    place = np.empty(len(at), dtype=np.int64)
    for k in range(0, len(at), 65_536):
        part = at[k : k + 65_536]
        place[k : k + 65_536] = part + width - 1 - views[part, ::-1].argmin(axis=1)
    return place, grams


def occurrences(h: np.ndarray, h2: np.ndarray, rid: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Rows for ``repeated``, with repetitions within this batch marked."""
    both = np.stack([h, h2.astype(np.uint64)])
    order = np.lexsort(both[::-1])
    same = (both[:, order[1:]] == both[:, order[:-1]]).all(axis=0)
    state = np.full(len(h), FIRST, dtype=np.int64)
    state[order[1:][same]] = KNOWN
    leads = np.flatnonzero(same & ~np.concatenate([[False], same[:-1]])) if len(same) else np.empty(0, dtype=np.int64)
    state[order[leads]] = LEADER
    # the hash of a known one is needed no more
    main, more = np.where(state == KNOWN, 0, h.view(np.int64)), np.where(state == KNOWN, 0, h2.astype(np.int64))
    columns = [main, more << 2 | state, rid, pos.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "h2", "rid", "pos"])


def key() -> Column:
    """What a row is dealt by: its hash; known ones are spread by their place."""
    return F.when(F.col("h2").bitwiseAND(F.lit(3)) == KNOWN, F.xxhash64("rid", "pos")).otherwise(F.col("h"))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of equal hash together and sorted by it."""
    return rows.repartition(key()).sortWithinPartitions("h", "h2")


def _anchor_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, starts = batch_words(batch.column("text").to_pylist())
            at, text = window_starts(starts, window)
            place, grams = anchors(hashes, at, window, gram)
            place, first = np.unique(place, return_index=True)
            rid = batch.column("rid").to_numpy()[text[first]]
            pos = place - starts[text[first]]
            yield occurrences(grams[place], np.zeros(len(place), dtype=np.int32), rid, pos)

    return run


def _window_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, starts = batch_words(unsqueezed(batch.column("text")))
            lists = batch.column("places")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            marked = np.zeros(len(hashes) + 1, dtype=bool)
            marked[starts[owner] + lists.flatten().to_numpy()] = True
            at, text = window_starts(starts, window)
            place, _ = anchors(hashes, at, window, gram)
            at, text = at[marked[place]], text[marked[place]]
            whole = rolling(hashes, window)
            check = rolling(hashes ^ np.uint64(0xD6E8FEB86659FD93), window) >> np.uint64(33)
            rid = batch.column("rid").to_numpy()[text]
            yield occurrences(whole[at], check[at].astype(np.int32), rid, at - starts[text])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, the places of those that occur twice or are known to."""
    names = ("h", "h2", "rid", "pos")
    kept = {c: np.empty(0, dtype=np.int64) for c in names}  # the last row, whose next one isn't seen yet
    twice = False  # whether it equals the one before it
    for batch in batches_or_end(batches):
        rows = {c: np.concatenate([kept[c], batch[c]]) if batch else kept[c] for c in names}
        n = len(rows["h"])
        if not n:
            continue
        same = (rows["h"][1:] == rows["h"][:-1]) & (rows["h2"][1:] >> 2 == rows["h2"][:-1] >> 2)
        before = np.concatenate([[twice], same])
        after = np.concatenate([same, [False]])
        hit = before | after | (rows["h2"] & 3 != FIRST)
        done = n if batch is None else n - 1
        yield pa.RecordBatch.from_arrays([pa.array(rows["rid"][:done][hit[:done]]), pa.array(rows["pos"][:done][hit[:done]].astype(np.int32))], names=["rid", "pos"])
        kept, twice = {c: v[done:] for c, v in rows.items()}, bool(before[-1])


def batches_or_end(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray] | None]:
    for batch in batches:
        yield {c: batch.column(c).to_numpy().astype(np.int64) for c in ("h", "h2", "rid", "pos")}
    yield None


def repeated(rows: DataFrame) -> DataFrame:
    """(rid, pos) of the occurrences whose hash occurs twice or more."""
    return dealt(rows).mapInArrow(_merge, "rid long, pos int")


def _merge_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a batch's rows sorted by hash, joined with the runs: hits of both sides, and the hashes that are new."""
    names = ("h", "h2", "rid", "pos", "met", "met_rid", "met_pos")
    kept = {c: np.empty(0, dtype=np.int64) for c in names}  # the last row, whose next one isn't seen yet
    before_kept = False  # whether it equals the one before it
    filled = (batch_columns(b, names) for b in batches)
    for batch in chained(filled):
        rows = {c: np.concatenate([kept[c], batch[c]]) if batch else kept[c] for c in names}
        n = len(rows["h"])
        if not n:
            continue
        state = rows["h2"] & 3
        same = (rows["h"][1:] == rows["h"][:-1]) & (state[1:] != KNOWN) & (state[:-1] != KNOWN)
        before, after = np.concatenate([[before_kept], same]), np.concatenate([same, [False]])
        done = n if batch is None else n - 1
        met = rows["met"] > 0
        hit, fresh, old = before | after | (state != FIRST) | met, ~before & ~met & (state != KNOWN), met & ~before & (state != KNOWN)
        parts = [(HIT, hit, "rid", "pos"), (HIT, old, "met_rid", "met_pos"), (RUN, fresh, "rid", "pos")]
        out = [(k, *(rows[c][:done][m[:done]] for c in ("h", rid, pos))) for k, m, rid, pos in parts]
        columns = [np.concatenate([x[c] for x in out]) for c in (1, 2, 3)]
        kinds = np.concatenate([np.full(len(x[1]), x[0], dtype=np.int32) for x in out])
        yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.int32), strict=True)), pa.array(kinds)], names=["h", "rid", "pos", "kind"])
        kept, before_kept = {c: v[done:] for c, v in rows.items()}, bool(before[-1])


def batch_columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {c: batch.column(c).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) for c in names}


def chained(batches: Iterator[dict]) -> Iterator[dict | None]:
    yield from batches
    yield None


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    press = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=True).compress
    for batch in batches:
        at = batch.schema.names.index("text")
        raw = pa.array([None if t is None else press(t.encode()) for t in batch.column(at).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([raw if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)


def unsqueezed(column: pa.Array) -> list[str | None]:
    expand = zstandard.ZstdDecompressor().decompress
    return [None if x is None else expand(x).decode() for x in column.to_pylist()]


def _cut(window: int, digests: bool, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, places in zip(unsqueezed(batch.column("text")), batch.column("places"), strict=True):
                words = (text or "").encode().split()
                removed = 0
                if places.is_valid:
                    marks = np.zeros(len(words) + 1, dtype=np.int64)
                    at = np.unique(places.values.to_numpy())
                    marks[at] += 1
                    np.add.at(marks, at + window, -1)
                    keep = np.cumsum(marks[:-1]) == 0
                    removed = len(words) - int(keep.sum())
                    words_left = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                else:
                    words_left = words
                out = b" ".join(words_left)
                n_words.append(len(words))
                n_removed.append(removed)
                # a text that loses nothing stays as it is where texts are asked for
                kept.append(hashlib.sha256(out).hexdigest() if digests else text if not removed else out.decode())
            own = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*own, *(batch.column(c) for c in carried)], names=["doc_id", "n_words", "n_removed", "kept", *carried]
            )

    return run


class FingerprintIndex:
    """Runs of anchors under ``path``: ``add`` puts a batch in, ``judge`` tells what of texts repeats in all that was added."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, gram: int = GRAM, runs: int = RUNS):
        self.spark, self.window, self.gram, self.runs = spark, window, gram, runs
        self.path = path or f"{shared_dir(spark)}/substring-{uuid.uuid4().hex}"
        self.tables: list[str] = []

    def _fs(self, name: str = ""):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, name: str) -> bool:
        fs, at = self._fs(name)
        return fs.exists(at)

    def batches(self, kind: int) -> list[str]:
        """Whole batches that have rows of a kind."""
        fs, at = self._fs()
        found = [str(x.getPath().getName()) for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(x for x in found if x.startswith("batch-") and self._exists(f"{x}/_SUCCESS") and self._exists(f"{x}/kind={kind}"))

    def _run(self, batch: str) -> DataFrame:
        """A run as a table of sorted buckets; the number of buckets is in its name."""
        name = f"vestige_{hashlib.md5(self.path.encode()).hexdigest()[:12]}_{batch.replace('-', '_')}"
        if name not in self.tables:
            where = f"{self.path}/{batch}".replace("'", "\\'")
            columns = "h BIGINT, rid BIGINT, pos INT, kind INT"
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (kind) "
                f"CLUSTERED BY (h) SORTED BY (h) INTO {batch.rsplit('-', 1)[1]} BUCKETS LOCATION '{where}'"
            )
            self.spark.catalog.recoverPartitions(name)
            self.tables.append(name)
        return self.spark.table(name).where(F.col("kind") == RUN).select("h", "rid", "pos")

    def _write(self, rows: DataFrame, batch: str) -> None:
        """Rows that are dealt by h already, as sorted buckets; a batch is there when its _SUCCESS is."""
        name = f"vestige_write_{uuid.uuid4().hex}"
        writer = rows.write.partitionBy("kind").bucketBy(int(batch.rsplit("-", 1)[1]), "h").sortBy("h")
        writer.option("path", f"{self.path}/{batch}").option("compression", "zstd").mode("overwrite").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay

    def close(self) -> None:
        """Forget the tables' names; the files stay."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []

    def compact(self) -> None:
        """Merge all runs into one, bucket by bucket; the old ones go when it is whole."""
        old = self.batches(RUN)
        if len(old) < 2:
            return
        whole = self._run(old[0])
        for batch in old[1:]:
            more = self._run(batch).withColumnsRenamed({"rid": "more_rid", "pos": "more_pos"})
            whole = whole.join(more.hint("merge"), "h", "full_outer").select("h", F.coalesce("rid", "more_rid").alias("rid"), F.coalesce("pos", "more_pos").alias("pos"))
        self._write(whole.withColumn("kind", F.lit(RUN)), f"batch-merged-{uuid.uuid4().hex}-{old[0].rsplit('-', 1)[1]}")
        self.close()
        for batch in old:
            fs, at = self._fs(f"{batch}/kind={RUN}")
            fs.delete(at, True)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None, keep_texts: bool = True) -> None:
        """Put a batch of documents in. Its name is made of its rows where none is given; a name that is there is not added again.

        With ``keep_texts`` the texts stay under the path, too, for judge() to verify with.
        """
        prepare(self.spark)
        texts = keyed(docs, id_col, text_col).select("rid", "text")
        if batch is None:
            s = texts.agg(F.count("*").alias("n"), F.sum(F.pmod("rid", F.lit(1 << 40))).alias("s"), F.bit_xor("rid").alias("x")).first()
            batch = hashlib.md5(str(tuple(s)).encode()).hexdigest()
        if any(x.startswith(f"batch-{batch}-") and self._exists(f"{x}/_SUCCESS") for x in self._all()):
            return
        if len(self.batches(RUN)) > self.runs:
            self.compact()
        runs = self.batches(RUN)
        parts = int(runs[0].rsplit("-", 1)[1]) if runs else int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = texts.mapInArrow(_anchor_rows(self.window, self.gram), OCCURRENCE).withColumn("h", key()).repartition(parts, "h")
        for k, run in enumerate(runs):
            met = self._run(run).select("h", F.struct("rid", "pos").alias(f"met_{k}"))
            rows = rows.join(met.hint("merge"), "h", "left")
        met = F.coalesce(*(F.col(f"met_{k}") for k in range(len(runs)))) if runs else F.lit(None).cast("struct<rid: long, pos: int>")
        own = F.col("h2").bitwiseAND(F.lit(3)) != KNOWN
        rows = rows.select("h", "h2", "rid", "pos", (met.isNotNull() & own).cast("int").alias("met"), met["rid"].alias("met_rid"), met["pos"].alias("met_pos"))
        merged = rows.sortWithinPartitions("h").mapInArrow(_merge_run, "h long, rid long, pos int, kind int")
        if keep_texts:
            texts.mapInArrow(_squeeze, "rid long, text binary").write.mode("overwrite").parquet(f"{self.path}/text-{batch}")
        self._write(merged, f"batch-{batch}-{parts}")

    def _all(self) -> list[str]:
        fs, at = self._fs()
        return [str(x.getPath().getName()) for x in fs.listStatus(at)] if fs.exists(at) else []

    def judge(
        self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, carry: tuple[str, ...] = (), alone: bool = False
    ) -> DataFrame:
        """(doc_id, n_words, n_removed, kept) of documents that were added; kept is text, or its SHA-256 digest.

        Candidates are verified against the texts that were kept, or with ``alone`` against docs only, which is the same
        where docs are all that was added. Columns in ``carry`` come along as carried_0, carried_1, ...
        """
        prepare(self.spark)
        batch = keyed(docs, id_col, text_col, carry)
        names = self.batches(HIT)
        schema = "h long, rid long, pos int"
        hits = self.spark.read.schema(schema).parquet(*(f"{self.path}/{x}/kind={HIT}" for x in names)) if names else self.spark.createDataFrame([], schema)
        places = hits.groupBy("rid").agg(F.collect_set("pos").alias("places"))
        kinds, carried = dict(batch.dtypes), [f"carried_{k}" for k in range(len(carry))]
        squeezed = ", ".join(f"{c} {'binary' if c == 'text' else t}" for c, t in batch.dtypes)
        # all columns go along, so that both joins read one exchange of the texts
        by_rid = batch.mapInArrow(_squeeze, squeezed).repartition("rid")
        known = by_rid
        stored = [] if alone else [x for x in self._all() if x.startswith("text-") and self._exists(f"{x}/_SUCCESS")]
        if stored:  # rows that are judged now are among those that were kept
            known = self.spark.read.schema("rid long, text binary").parquet(*(f"{self.path}/{x}" for x in stored))
        windows = repeated(known.join(places, "rid").select("rid", "text", "places").mapInArrow(_window_rows(self.window, self.gram), OCCURRENCE))
        found = windows.groupBy("rid").agg(F.collect_set("pos").alias("places"))
        judged = by_rid.join(found, "rid", "left")
        schema = f"doc_id {kinds['doc_id']}, n_words long, n_removed long, kept string"
        schema = ", ".join([schema, *(f"{c} {kinds[c]}" for c in carried)])
        return judged.select("doc_id", "text", "places", *carried).mapInArrow(_cut(self.window, digests, carried), schema)


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    batch = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)))
    return batch.withColumn("rid", row_key(F.col("doc_id"), F.col("text")))


def indexed(docs: DataFrame, id_col: str, text_col: str, window: int, batches: int) -> FingerprintIndex:
    """An index that all of docs went into, in batches dealt by hash."""
    index = FingerprintIndex(docs.sparkSession, window=window, runs=1)
    share = F.pmod(F.xxhash64(row_key(F.col(id_col), F.col(text_col))), F.lit(batches))
    for k in range(batches):
        index.add(docs.where(share == k), id_col, text_col, batch=f"{k}", keep_texts=False)
    index.close()
    return index


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digests: bool = False, batches: int = BATCHES
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row, judged against all rows of the input."""
    return indexed(docs, id_col, text_col, window, batches).judge(docs, id_col, text_col, digests, alone=True)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", window: int = WINDOW) -> DataFrame:
    """All rows of docs with all their columns, the text less its repeated words.

    A text that loses nothing stays as it is; another one's words are joined by single spaces, and
    its number of characters in ``chars_col``, if docs has that column, is counted anew.
    """
    others = tuple(c for c in docs.columns if c not in (id_col, text_col))
    out = indexed(docs, id_col, text_col, window, BATCHES).judge(docs, id_col, text_col, carry=others, alone=True)
    columns = {id_col: F.col("doc_id"), text_col: F.col("kept")} | {c: F.col(f"carried_{k}") for k, c in enumerate(others)}
    if chars_col in others:
        anew = F.length("kept").cast(docs.schema[chars_col].dataType)
        columns[chars_col] = F.when(F.col("n_removed") > 0, anew).otherwise(columns[chars_col])
    return out.select(*(columns[c].alias(c) for c in docs.columns))
