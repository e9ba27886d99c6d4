"""Language-model scoring with a probabilistic suffix tree over words.

A text is its words and one end. Symbols are the words of the training texts, the end, and one
symbol that all words unknown to training share, as in the base score. With N training tokens and T
of them met once, the root gives a known token w the probability n(w) / (N + T) and the unknown
symbol T / (N + T).

States of one or two words before a token refine that. A context that is met ``MET`` times at
least stays if its next symbols diverge from the root's, and one of two words if they diverge from
its suffix state's as well: if twice the log-likelihood ratio beats ``PENALTY`` per kind of next symbol
times the log of its count. All that pass the first test stay in a written table
dealt to parts that grow in number with the training tokens; tokens meet them by a join in these
parts, where suffixes lie beside their extensions and the second test is made, and no worker holds
more of the tree than a part. Next symbols are here the common words, the end, and one symbol for all other words, which the root then tells apart; other
words serve as contexts by a class of their hash. In a state s a symbol c has (n(s,c) + t(s) p(c |
suffix)) / (n(s) + t(s)), where t(s) counts the distinct symbols seen and p(. | suffix) is the state
without the first word, or the root. The longest suffix state of a position scores it.

Defined results: a null text counts as empty and has the end only; a null id is not held out;
repeated rows each give a row and each teach; without training rows every token is unknown and has
probability one; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, row_key, written
from .toxicity import fold

PENALTY = 1.0
#: Words that every worker knows with their counts; the others are looked up by a join.
COMMON_WORDS = 262_144
#: Occurrences of a context.
MET = 2
#: Tokens of a part, parts at least, and codes that a task holds before it hands them on.
PART_TOKENS, LEAST_PARTS, HELD_CODES = 500_000, 16, 2_000_000
#: Bits of a word's number in a context, and the numbers that aren't common words.
WORD_BITS = 21
OTHER, STOP_TEXT, BEGIN, FIRST_WORD = 0, 1, 2, 3
#: Words that a task holds before it counts them and hands the counts on.
HELD = 3_000_000


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, and of each the number of its text. These kernels know ASCII only, as the definition of words does."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    some = pc.binary_length(words).to_numpy() > 0  # a text that begins or ends in white space has an empty one there
    return words.filter(pa.array(some)), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())[some]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def rows() -> pa.RecordBatch:
        counts = pc.value_counts(pa.chunked_array(held))
        return pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["word", "n"])

    for batch in batches:
        held.append(words_of(batch.column("text"))[0])
        size += len(held[-1])
        if size > HELD:
            yield rows()
            held, size = [], 0
    if held:
        yield rows()


OTHER_CLASSES = FIRST_WORD + COMMON_WORDS


def numbers_of(words: pa.Array, common: pa.Table) -> np.ndarray:
    """Numbers of words: of the common ones their places, of any other that of a class of its hash."""
    at = pc.index_in(words, value_set=common.column("word").combine_chunks().cast(words.type))
    out = pc.fill_null(at, 0).to_numpy().astype(np.int64) + FIRST_WORD
    others = at.is_null()
    rare = words.filter(others).dictionary_encode()
    classes = [OTHER_CLASSES + xxhash.xxh3_64_intdigest(w) % ((1 << WORD_BITS) - OTHER_CLASSES) for w in rare.dictionary.to_pylist()]
    out[others.to_numpy(zero_copy_only=False)] = np.asarray(classes, dtype=np.int64)[rare.indices.to_numpy()]
    return out


def word_codes(texts: pa.Array, common: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of each token: its two words before and its symbol as one code, and the number of its text. The first token comes after
    two begin marks."""
    words, owner = words_of(texts)
    lengths = np.bincount(owner, minlength=len(texts)) + 3
    line = np.full(int(lengths.sum()), BEGIN, dtype=np.int64)
    line[np.arange(len(words)) + 3 * owner + 2] = numbers_of(words, common)
    line[np.cumsum(lengths) - 1] = STOP_TEXT
    owner = np.repeat(np.arange(len(texts)), lengths)
    last, before = line[1:-1], line[:-2]
    symbol = np.where(line[2:] >= OTHER_CLASSES, OTHER, line[2:])
    use = line[2:] != BEGIN
    code = (before << 2 * WORD_BITS) | (last << WORD_BITS) | symbol
    return code[use], owner[2:][use]


def packed(codes: np.ndarray, *others: np.ndarray) -> bytes:
    """Ascending codes, and integers or floats that belong to them, in few bytes."""
    columns = [np.diff(codes, prepend=0), *others]
    raw = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)
    return len(codes).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:8], "little"), 0, []
    sizes = [np.dtype(k).itemsize for k in (np.int64, *kinds)]
    raw = np.frombuffer(pa.decompress(data[8:], n * sum(sizes), "zstd", asbytes=True), dtype=np.uint8)
    for kind, size in zip((np.int64, *kinds), sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).reshape(-1).view(kind))
        at += n * size
    return [np.cumsum(out[0]), *out[1:]]


def mixed(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


@dataclass
class Deal:
    """How contexts go to parts: by their last word, and those of a frequent one in pieces by the word before, too.

    A part gets PART_TOKENS tokens or so; pieces has the number of pieces of each word as a last one.
    """

    parts: int
    pieces: np.ndarray

    @classmethod
    def of(cls, common: pa.Table, documents: int, tokens: int) -> Deal:
        parts = max(LEAST_PARTS, tokens // PART_TOKENS)
        n = np.zeros(1 << WORD_BITS)
        n[FIRST_WORD : FIRST_WORD + common.num_rows] = common.column("n").to_numpy()
        n[BEGIN] = documents
        return cls(parts, np.maximum(1, np.ceil(2 * parts * n / max(tokens, 1))).astype(np.uint32))

    def piece(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return (mixed((last.astype(np.uint64) << np.uint64(32)) | piece.astype(np.uint64)) % np.uint64(self.parts)).astype(np.int64)

    def of_codes(self, code: np.ndarray) -> np.ndarray:
        """The part of codes of two words before a symbol."""
        last = (code >> WORD_BITS) & ((1 << WORD_BITS) - 1)
        return self.piece(last, mixed(code >> 2 * WORD_BITS) % self.pieces[last])

    def of_short_codes(self, code: np.ndarray) -> np.ndarray:
        """The part that counts codes of one word before a symbol: a frequent word's are dealt by themselves."""
        return np.where(self.split(code), (mixed(code) % np.uint64(self.parts)).astype(np.int64), self.piece(code >> WORD_BITS, np.zeros(len(code))))

    def split(self, code: np.ndarray) -> np.ndarray:
        """Whether a code's context is one frequent word."""
        context = code >> WORD_BITS
        return (context < 1 << WORD_BITS) & (self.pieces[np.minimum(context, len(self.pieces) - 1)] > 1)


DEALT = "part long, kind int, batch long, data binary"
COUNTS, SPLIT, QUESTION, ANSWER, ROWS = range(5)


def dealt_rows(part: np.ndarray, kind: int, batch: int, code: np.ndarray, *others: np.ndarray) -> pa.RecordBatch:
    """A row for each part: its codes, which become ascending, and what belongs to them."""
    order = np.argsort(code, kind="stable")
    order = order[np.argsort(part[order], kind="stable")]
    part, code, others = part[order], code[order], [x[order] for x in others]
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    ends = [*starts[1:].tolist(), len(part)]
    data = [packed(code[i:j], *(x[i:j] for x in others)) for i, j in zip(starts.tolist(), ends, strict=True)]
    n = len(starts)
    columns = [pa.array(part[starts]), pa.array(np.full(n, kind, dtype=np.int32)), pa.array(np.full(n, batch)), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "kind", "batch", "data"])


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "batch", "data")), strict=True)


def summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, where = np.unique(code, return_inverse=True)
    return code, np.bincount(where, n, minlength=len(code)).astype(np.int64)


def _count_word_codes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, deal = shared.value
        held, size = [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            whole = np.concatenate(held)
            for codes, part in ((whole, deal.of_codes), (whole & ((1 << 2 * WORD_BITS) - 1), deal.of_short_codes)):
                code, n = np.unique(codes, return_counts=True)
                yield dealt_rows(part(code), COUNTS, 0, code, n.astype(np.int64))

        for batch in batches:
            held.append(word_codes(batch.column("text"), common)[0])
            size += len(held[-1])
            if size > HELD_CODES:
                yield from rows()
                held, size = [], 0
        if held:
            yield from rows()

    return run


def _test_contexts(shared, documents: int, penalty: float, met: int, level: int):
    """Rows come sorted by part; the counts of contexts that pass, dealt for scoring.

    At level 0 the counts after one frequent word are only summed, and dealt by that word for level 1, where the
    contexts that pass go to each part that has a piece of the word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, deal = shared.value
        counts = common.column("n").to_numpy().astype(float)
        share = np.full(OTHER_CLASSES, 1.0)
        share[FIRST_WORD : FIRST_WORD + len(counts)] = counts
        share[STOP_TEXT] = documents
        tokens = share[STOP_TEXT] + counts.sum()
        share /= max(tokens, 1.0)
        share[OTHER] = 0.05  # what the other words have together; only the test uses it

        def passing(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            _, owner, kinds = np.unique(code >> WORD_BITS, return_inverse=True, return_counts=True)
            total = np.bincount(owner, n)
            gain = 2 * np.bincount(owner, n * np.log(n / total[owner] / share[code & ((1 << WORD_BITS) - 1)]))
            keep = ((total >= met) & (gain > penalty * kinds * np.log(total + 1)))[owner]
            return code[keep], n[keep]

        def done(part: int, held: list) -> Iterator[pa.RecordBatch]:
            code, n = summed(*map(np.concatenate, zip(*held, strict=True)))
            if level:
                code, n = passing(code, n)
                for word in np.unique(code >> WORD_BITS):
                    one = slice(*np.searchsorted(code >> WORD_BITS, [word, word + 1]))
                    pieces = np.arange(int(deal.pieces[word]), dtype=np.uint64)
                    for at in np.unique(deal.piece(np.full(len(pieces), word), pieces)):
                        yield dealt_rows(np.full(one.stop - one.start, at), COUNTS, 0, code[one], n[one])
                return
            split = deal.split(code)
            if split.any():
                yield dealt_rows(deal.piece(code[split] >> WORD_BITS, np.zeros(int(split.sum()))), SPLIT, 0, code[split], n[split])
            code, n = passing(code[~split], n[~split])
            if len(code):
                yield dealt_rows(np.full(len(code), part), COUNTS, 0, code, n)

        now, held = None, []
        for part, _, _, data in parts_of(batches):
            if part != now and held:
                yield from done(now, held)
                held = []
            now = part
            held.append(unpacked(data, np.int64))
        if held:
            yield from done(now, held)

    return run


@dataclass
class WordStates:
    """Sorted contexts of one or two words with totals and kinds; pairs with counts."""

    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray
    pairs: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, pairs: np.ndarray, counts: np.ndarray) -> WordStates:
        """From the counts of whole contexts, each as often as its part has it."""
        pairs, first = np.unique(pairs, return_index=True)
        counts = counts[first].astype(float)
        contexts, owner, kinds = np.unique(pairs >> WORD_BITS, return_inverse=True, return_counts=True)
        return cls(contexts, np.bincount(owner, counts, minlength=len(contexts)), kinds.astype(float), pairs, counts)

    def diverging(self, root: np.ndarray, penalty: float) -> WordStates:
        """Without the contexts of two words that tell little more than their suffix state."""
        context = self.pairs >> WORD_BITS
        p, long = root[self.pairs & ((1 << WORD_BITS) - 1)], np.flatnonzero(context >= 1 << WORD_BITS)
        suffix = self.pairs[long] & ((1 << 2 * WORD_BITS) - 1)
        at = np.minimum(np.searchsorted(self.contexts, suffix >> WORD_BITS), len(self.contexts) - 1)
        known = self.contexts[at] == suffix >> WORD_BITS
        at, some = at[known], long[known]
        where = np.minimum(np.searchsorted(self.pairs, suffix[known]), len(self.pairs) - 1)
        n = np.where(self.pairs[where] == suffix[known], self.counts[where], 0.0)
        p[some] = (n + self.kinds[at] * p[some]) / (self.totals[at] + self.kinds[at])
        owner = np.searchsorted(self.contexts, context)
        gain = 2 * np.bincount(owner, self.counts * np.log(self.counts / self.totals[owner] / p), minlength=len(self.contexts))
        keep = (self.contexts < 1 << WORD_BITS) | (gain > penalty * self.kinds * np.log(self.totals + 1))
        return WordStates(self.contexts[keep], self.totals[keep], self.kinds[keep], self.pairs[keep[owner]], self.counts[keep[owner]])

    def gains(self, codes: np.ndarray, root: np.ndarray) -> np.ndarray:
        """log10 of each code's probability over that of its symbol at the root."""
        p = root.copy()
        if not len(self.contexts):
            return np.zeros(len(p))
        live = np.arange(len(codes))
        for part in (codes & ((1 << 2 * WORD_BITS) - 1), codes):
            context = part[live] >> WORD_BITS
            at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            found = self.contexts[at] == context
            live, at = live[found], at[found]
            where = np.minimum(np.searchsorted(self.pairs, part[live]), len(self.pairs) - 1)
            n = np.where(self.pairs[where] == part[live], self.counts[where], 0.0)
            p[live] = (n + self.kinds[at] * p[live]) / (self.totals[at] + self.kinds[at])
        return np.log10(p / root)


def word_states(texts: DataFrame, shared, documents: int, penalty: float, met: int) -> DataFrame:
    """The counts of all contexts of texts that pass the test, dealt by Deal; shared holds the common words and it."""

    def by_part(rows: DataFrame) -> DataFrame:
        return rows.repartition("part").sortWithinPartitions("part")

    counted = by_part(texts.mapInArrow(_count_word_codes(shared), DEALT))
    first = written(counted.mapInArrow(_test_contexts(shared, documents, penalty, met, 0), DEALT), "pst-contexts")
    split = by_part(first.where(F.col("kind") == SPLIT))
    second = written(split.mapInArrow(_test_contexts(shared, documents, penalty, met, 1), DEALT), "pst-contexts")
    return first.where(F.col("kind") == COUNTS).unionByName(second)


@dataclass
class Corpus:
    """What training gathers: counts of words as a table, numbers and the tree's states.

    tokens counts all training tokens, distinct the different ones, single those met once.
    """

    words: DataFrame
    documents: int
    tokens: int
    distinct: int
    single: int
    common: pa.Table
    deal: Deal
    states: DataFrame
    penalty: float

    def base(self, n):
        """log10 of the smoothed share of a token that occurs n times, as a number or a column."""
        over = self.tokens + 0.5 * (self.distinct + 1)
        return math.log10((n + 0.5) / over) if isinstance(n, int) else F.log10((n + F.lit(0.5)) / F.lit(over))

    def root(self, n):
        """log10 of a token's probability at the root from its count, as a number or a column."""
        unknown, total = max(self.single, 1), self.tokens + max(self.single, 1)
        if isinstance(n, int):
            return math.log10((n or unknown) / total)
        return F.log10(F.when(n > 0, n).otherwise(F.lit(unknown)) / F.lit(float(total)))


def learn(docs: DataFrame, text_col: str = "text", penalty: float = PENALTY, met: int = MET) -> Corpus:
    """Gather words, counts and states from every row of docs."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text"))
    words = texts.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = written(words, "pst-words")
    documents = texts.count()
    sums = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") == 1).alias("single")).first()
    common = common_words(words)
    deal = Deal.of(common, documents, sums["n"] + documents)
    shared = docs.sparkSession.sparkContext.broadcast((common, deal))  # at most COMMON_WORDS words, 2 ** WORD_BITS numbers
    states = word_states(texts, shared, documents, penalty, met)
    shared.destroy()  # what used it is written
    return Corpus(words, documents, sums["n"] + documents, sums["v"] + (documents > 0), sums["single"], common, deal, states, penalty)


def common_words(words: DataFrame, most: int = COMMON_WORDS) -> pa.Table:
    """The words that occur at least so often that no more than ``most`` do."""
    sizes = words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most).collect()
    least, total = None, 0
    for r in sizes:
        if (total := total + r["words"]) > most:
            break
        least = r["n"]
    return words.where(F.lit(False) if least is None else F.col("n") >= least).orderBy(F.desc("n"), "word").toArrow()


def root_shares(common: pa.Table, single: int, tokens: int, documents: int) -> np.ndarray:
    """The root probability of each symbol."""
    n = common.column("n").to_numpy().astype(float)
    root = np.full(OTHER_CLASSES, 1e-12)
    root[FIRST_WORD : FIRST_WORD + len(n)] = n / (tokens + single)
    root[STOP_TEXT] = max(documents / (tokens + single), 1e-12)
    root[OTHER] = max(1.0 - root[FIRST_WORD : FIRST_WORD + len(n)].sum() - root[STOP_TEXT], 1e-9)
    return root


def signed_hashes(words: pa.Array) -> pa.Array:
    rare = words.dictionary_encode()
    hashes = np.asarray([xxhash.xxh64_intdigest(w, 42) for w in rare.dictionary.to_pylist()], dtype=np.uint64)
    return pa.array(hashes.view(np.int64)[rare.indices.to_numpy()])


def _score(shared, over: float, single: int, tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value[0]
        n = common.column("n").to_numpy().astype(float)
        scores = np.zeros((2, 1 << WORD_BITS))  # base and root scores by number, 0 for others
        scores[:, FIRST_WORD : FIRST_WORD + len(n)] = np.log10((n + 0.5) / over), np.log10(n / (tokens + single))
        for batch in batches:
            words, owner = words_of(batch.column("text"))
            found = numbers_of(words, common)
            ends = np.cumsum([0, *np.bincount(owner, minlength=batch.num_rows)]).tolist()
            others = found >= OTHER_CLASSES
            rare = np.bincount(owner[others], minlength=batch.num_rows)
            columns = {
                "n_tokens": pa.array(np.diff(ends) + 1, pa.int64()),
                "n_known": pa.array(np.diff(ends) - rare, pa.int64()),
                **{c: pa.array([float(of[found[i:j]].sum()) for i, j in pairwise(ends)], pa.float64()) for c, of in zip(("base", "score"), scores, strict=True)},
                "rare": pa.ListArray.from_arrays(np.cumsum([0, *rare]).astype(np.int32), signed_hashes(words.filter(pa.array(others)))),
            }
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), *columns.values()], names=["doc_id", "rid", *columns])

    return run


def _ask(shared):
    """Codes of every token, dealt like the states, and for each batch of texts a row of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, deal = shared.value
        task = TaskContext.get().partitionId() << 32
        codes, slots, keys, number, size = [], [], [], 0, 0

        def rows() -> Iterator[pa.RecordBatch]:
            code, slot, rid = np.concatenate(codes), np.concatenate(slots).astype(np.uint32), np.concatenate(keys)
            if len(code):
                yield dealt_rows(deal.of_codes(code), QUESTION, task + number, code, slot)
            yield dealt_rows(np.full(len(rid), number % deal.parts), ROWS, task + number, np.arange(len(rid)), rid)

        for batch in batches:
            code, owner = word_codes(batch.column("text"), common)
            codes.append(code)
            slots.append(owner + sum(map(len, keys)))
            keys.append(batch.column("rid").to_numpy())
            size += len(code)
            if size > HELD_CODES:
                yield from rows()
                codes, slots, keys, number, size = [], [], [], number + 1, 0
        if keys:
            yield from rows()

    return run


def _answer(shared, single: int, tokens: int, documents: int, penalty: float):
    """Rows come sorted by part, its states before what is asked of them; the gains of each batch's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = root_shares(shared.value[0], single, tokens, documents)
        now, held, states = None, [], None
        for part, kind, batch, data in parts_of(batches):
            if part != now:
                now, held, states = part, [], None
            if kind == COUNTS:
                held.append(unpacked(data, np.int64))
                continue
            if kind == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int64()), (kind, pa.int32()), (batch, pa.int64()), (data, pa.binary()))], names=["part", "kind", "batch", "data"])
                continue
            if not held:
                continue  # no context of this part passed, so the root has the last word
            if states is None:
                states = WordStates.of(*map(np.concatenate, zip(*held, strict=True))).diverging(root, penalty)
                held = [(states.pairs, states.counts)]
            code, slot = unpacked(data, np.uint32)
            gain = np.bincount(slot, states.gains(code, root[code & ((1 << WORD_BITS) - 1)]))
            at = np.flatnonzero(gain)
            if len(at):
                yield dealt_rows(np.full(len(at), part), ANSWER, batch, at, gain[at])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by batch, that of the keys first."""

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(gain)], names=["rid", "gain"])

    now, rid, gain = None, None, None
    for _, kind, batch, data in parts_of(batches):
        if batch != now:
            if now is not None:
                yield rows()
            now, (_, rid) = batch, unpacked(data, np.int64)
            gain = np.zeros(len(rid))
        if kind == ANSWER:
            slot, more = unpacked(data, np.float64)
            gain[slot] += more
    if now is not None:
        yield rows()


def text_gains(rows: DataFrame, corpus: Corpus, shared) -> DataFrame:
    """(rid, gain) of every row (rid, text): what the states add to its score at the root.

    The codes of all tokens meet the states by a join in their parts.
    """
    asked = rows.select("rid", "text").mapInArrow(_ask(shared), DEALT)
    met = corpus.states.unionByName(asked).repartition("part").sortWithinPartitions("part", "kind")
    run = _answer(shared, max(corpus.single, 1), corpus.tokens, corpus.documents, corpus.penalty)
    dealt = met.mapInArrow(run, DEALT).repartition("batch").sortWithinPartitions("batch", F.desc("kind"))
    # rows alike in id and text share their rid
    return written(dealt.mapInArrow(_add, "rid long, gain double").groupBy("rid").agg(F.max("gain").alias("gain")), "pst-gains")


def score(docs: DataFrame, corpus: Corpus, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Counts of words beyond the common ones come by a join on 64 bits of the word's hash, the states by one in parts.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("rid", row_key(F.col("doc_id"), F.col("text")))
    over = corpus.tokens + 0.5 * (corpus.distinct + 1)
    shared = spark.sparkContext.broadcast((corpus.common, corpus.deal))  # at most COMMON_WORDS words, 2 ** WORD_BITS numbers
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, rid long, n_tokens long, n_known long, base double, score double, rare array<long>"
    run = _score(shared, over, max(corpus.single, 1), corpus.tokens)
    found = written(rows.select("doc_id", "rid", "text").mapInArrow(run, schema), "pst-rows")
    gains = text_gains(rows, corpus, shared)
    shared.destroy()  # or workers would keep it
    counts = corpus.words.select(F.xxhash64("word").alias("h"), "n")
    # rows alike in id and text share their rid and would count twice
    pieces = found.groupBy("rid").agg(F.first("rare").alias("rare")).select("rid", F.explode("rare").alias("h"))
    looked = pieces.join(counts, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = looked.groupBy("rid").agg(
        F.sum(corpus.base(F.col("n"))).alias("rare_base"),
        F.sum(corpus.root(F.col("n"))).alias("rare_score"),
        F.sum((F.col("n") > 0).cast("long")).alias("rare_known"),
    )
    end = corpus.documents
    return found.join(sums, "rid", "left").join(gains, "rid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + int(end > 0)).alias("n_known"),
        F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + corpus.base(end)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0)) + corpus.root(end)).alias("score"),
    )


def training_rows(docs: DataFrame, id_col: str = "doc_id", folds: int = 5, held: int = 1) -> DataFrame:
    return docs.where(fold(F.col(id_col), folds) != held)
