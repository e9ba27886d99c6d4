"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or.

A document is a bag of sentences; only documents have labels. A sentence's probability p is a
logistic function of its features, a document's is 1 - prod(1 - p). Features are the 4- and 5-grams
of characters of its words, with marks at both ends of a word. The model is fitted on a bounded
sample of the labelled rows (``SAMPLE`` of each label, those of least hashed id); feature counts of
the sample are summed on the executors, and the ``FEATURES`` n-grams that speak most for toxicity
make up the model. So the driver holds at most ``2 * SAMPLE`` bags of those features. Scoring reads
every whole text; ``locate`` gives the sentences that offend.

Defined results: null and empty texts are one empty sentence and get its probability; without
labels of both kinds the score is the share of toxic labels, or 0; rows whose label is null teach
nothing; a null id is not held out; repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, written

#: Labelled rows of each label that the model is fitted on.
SAMPLE = 4_000
#: n-grams in the model, and how many standard errors its shares of toxic and clean documents lie apart at least.
FEATURES, APART = 4_096, 5.0
STEPS, RATE, PENALTY = 400, 0.1, 1e-4
THRESHOLD = 0.7
PART = re.compile(r"[^\W\d_]+|[.!?\n]")
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]?")
#: Words whose weight a worker remembers.
REMEMBERED = 300_000


def grams(word: str) -> set[str]:
    marked = f"^{word}$"
    return {marked[k : k + n] for n in (4, 5) for k in range(max(1, len(marked) - n + 1))}


@dataclass
class Model:
    """Weights of features, the weight of a sentence without any, and a memory of word weights."""

    weights: dict[str, float]
    bias: float
    known: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state):
        self.weights, self.bias = state
        self.known = {}

    def word(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            weights = self.weights
            found = self.known[word] = sum(weights[g] for g in grams(word) if g in weights)
        return found

    def sentences(self, text: str | None) -> list[float]:
        """Log of 1 - p of each sentence that has a word, or of an empty one."""
        out, now, open_ = [], self.bias, False
        known, word = self.known, self.word
        for part in PART.findall((text or "").lower()):
            if part in ".!?\n":
                if open_:
                    out.append(now)
                    now, open_ = self.bias, False
            else:
                weight = known.get(part)
                now += word(part) if weight is None else weight
                open_ = True
        if open_ or not out:
            out.append(now)
        return out

    def score(self, text: str | None) -> float:
        z = np.asarray(self.sentences(text))
        return float(-np.expm1(-np.logaddexp(0, z).sum()))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            words = {p for p in PART.findall((text or "").lower()) if p not in ".!?\n"}
            (toxic if label else clean).update(set().union(*map(grams, words)))
        if len(toxic) + len(clean) > 1_000_000:
            yield _counted(toxic, clean)
            toxic, clean = Counter(), Counter()
    yield _counted(toxic, clean)


def _counted(toxic: Counter, clean: Counter) -> pa.RecordBatch:
    names = [*toxic.keys() | clean.keys()]
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([clean[x] for x in names], pa.int64())],
        names=["feature", "toxic", "clean"],
    )


def _bags(index: dict[str, int]):
    """Each document's sentences with features: flat feature numbers and where each sentence ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends, bare = [], [], []
            for text in batch.column("text").to_pylist():
                numbers, stops, empty, now, words = [], [], 0, [], 0
                for part in [*PART.findall((text or "").lower()), "\n"]:
                    if part in ".!?\n":
                        if now:
                            numbers += now
                            stops.append(len(numbers))
                        elif words:
                            empty += 1
                        now, words = [], 0
                    else:
                        now += [index[g] for g in grams(part) if g in index]
                        words += 1
                flat.append(numbers)
                ends.append(stops)
                bare.append(empty if empty or stops else 1)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat, kind), pa.array(ends, kind), pa.array(bare, pa.int64()), batch.column("label")],
                names=["flat", "ends", "bare", "label"],
            )

    return run


def fit(bags: pa.Table, n_features: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the noisy-or model, by gradient descent on the documents' likelihood."""
    label = bags.column("label").to_numpy().astype(float)
    bare = bags.column("bare").to_numpy().astype(float)
    share = label.mean() if len(label) else 0.0
    if not n_features or share in (0.0, 1.0):
        return np.zeros(n_features), float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    feature, sentence, owner, n = [], [], [], 0
    for doc, (flat, ends) in enumerate(zip(bags.column("flat").to_pylist(), bags.column("ends").to_pylist(), strict=True)):
        sizes = np.diff([0, *ends])
        feature.append(np.asarray(flat, dtype=np.int64))
        sentence.append(n + np.repeat(np.arange(len(sizes)), sizes))
        owner += [doc] * len(sizes)
        n += len(sizes)
    feature, sentence, owner = np.concatenate(feature), np.concatenate(sentence).astype(np.int64), np.asarray(owner, dtype=np.int64)
    weights = np.concatenate([np.full(n_features, 0.5), [-7.0]])  # the last is the bias
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    balance = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
    for step in range(1, STEPS + 1):
        z = np.bincount(sentence, weights[feature], minlength=n) + weights[-1]
        sums = np.bincount(owner, np.logaddexp(0, z), minlength=len(label)) + bare * np.logaddexp(0, weights[-1])
        # d loss / d sums, where the document's probability is 1 - exp(-sums)
        slope = balance * np.where(label == 1, -1 / np.expm1(np.clip(sums, 1e-9, 500)), 1.0)
        p = 1 / (1 + np.exp(-z))
        each = slope[owner] * p
        grad = np.bincount(feature, each[sentence], minlength=n_features + 1)
        grad[-1] = each.sum() + (slope * bare).sum() / (1 + np.exp(-weights[-1]))
        grad = grad / len(label) + PENALTY * weights * (np.arange(len(weights)) < n_features)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        weights -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights[:-1], float(weights[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
    features: int = FEATURES,
) -> Model:
    """Fit a model on documents joined with labels (id_col, label_col: 0 or 1)."""
    prepare(docs.sparkSession)
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null").distinct()
    order = [F.xxhash64("id"), F.col("id"), F.col("label")]
    chosen = marks.where("label = 1").orderBy(*order).limit(sample).unionByName(marks.where("label = 0").orderBy(*order).limit(sample))
    # at most 2 * sample rows of two numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "label")
    rows = written(rows, "toxicity")
    counts = rows.mapInArrow(_count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n1, n0 = n.get(1, 0) + 1, n.get(0, 0) + 1
    t, c, p = (F.col("t") + 0.5) / n1, (F.col("c") + 0.5) / n0, (F.col("t") + F.col("c") + 1) / (n1 + n0)
    apart = (t - c) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    telling = counts.where((apart >= APART) & (F.log(t / c) > 1.0)).withColumn("gain", t * F.log(t / c))
    names = [r["feature"] for r in telling.orderBy(F.desc("gain"), "feature").limit(features).collect()]
    bags = rows.mapInArrow(_bags({x: k for k, x in enumerate(names)}), "flat array<int>, ends array<int>, bare long, label int")
    weights, bias = fit(bags.toArrow(), len(names))
    return Model(dict(zip(names, weights.tolist(), strict=True)), bias)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"), pa.array(scores, pa.float64())], names=[*(n for n in batch.schema.names if n != "text"), "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_score(model), f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    prepare(docs.sparkSession)
    names = docs.columns
    kinds = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [model.score(t.as_py()) < threshold for t in batch.column(names.index(text_col))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, kinds)


def locate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, score) of every sentence whose own probability reaches the threshold."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, found = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for m in SENTENCE.finditer(text or ""):
                    if PART.search(m[0]) and (p := 1 / (1 + np.exp(-model.sentences(m[0])[0]))) >= threshold:
                        owner.append(k)
                        found.append((m.start(), m.end(), float(p)))
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner, pa.int64())), *columns], names=["doc_id", "start", "end", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, start long, end long, score double")
