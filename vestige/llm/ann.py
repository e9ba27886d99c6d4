"""Nearest neighbours by inner product, from a kd-tree over stable projections.

Inner products become distances by one more component: a candidate v gets sqrt(M^2 - |v|^2), M
being the largest norm, a query gets 0; then |q' - v'|^2 = |q|^2 + M^2 - 2 <q, v>. Gaussian, so
2-stable, projections of these to ``DIMENSIONS`` dimensions have squared distances that are true
ones times a chi-square variable. A kd-tree over a bounded sample (``SAMPLE`` rows) cuts the
projected space into leaves, every row goes to its leaf, and each leaf's box is that of all its
rows. The search is incremental: queries visit leaves in the order of their boxes' projected
distance, ``STEP`` times as many in each round as before, and within a block the rows of least
projected distance come first. Rows are verified by inner products of the original
vectors in double precision, and the distance d of the 20th best so far shrinks. A query's search
ends where the next projected distance p fails the test chi2(p^2 / d^2) < ``SURE``: beyond, a nearer
row is as unlikely. Rows that fail it in a visited block aren't looked for; they aren't scored either,
but where most of a block passes and one product of all is cheaper.

Leaves are stored in blocks of bounded size, so a vector that many rows share fills blocks, not one
task. The queries are a stated set and meet blocks of rows: that isn't a join of all pairs.

Defined results: vectors null, zero, or holding null or non-finite components take no part. Vectors
of different lengths have no inner product: each length is searched by itself. A candidate's id may
be null and then comes after all others in ties, which go to the smaller id. Rows of one id are rows
of their own: a query row has all other rows for candidates, those alike included, and repeated query
rows each get their ranks from 1. An empty table or no query gives no rows; other columns of the
input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, written

DIMENSIONS = 12
SAMPLE = 20_000
#: Rows of a leaf aimed at, leaves at most (their boxes are broadcast), rows and queries of a block.
LEAF, LEAVES, BLOCK, QUERIES = 2_048, 4_096, 2_048, 512
SURE = 0.99
#: How many times as many leaves a query may visit in a round as before it, and rows that are verified at once.
STEP, VERIFIED = 4, 256
SEED = 20_240
SLACK = 1e-9


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function for an even number k of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, k // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def chi2_limit(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


class Projector:
    """Projection of candidates and queries, and the kd-tree's cuts."""

    def __init__(self, width: int, largest: float, depth: int, sample: np.ndarray):
        self.matrix = np.random.default_rng(SEED).standard_normal((width + 1, DIMENSIONS))
        self.largest2, self.depth = largest * largest, depth
        self.axes = np.zeros((1 << depth) - 1, dtype=np.int64)
        self.cuts = np.zeros((1 << depth) - 1)
        parts = {0: self.candidates(sample)} if len(sample) else {}
        for node in range(len(self.axes)):
            rows = parts.pop(node, None)
            if rows is None or not len(rows):
                continue
            self.axes[node] = axis = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            self.cuts[node] = cut = float(np.median(rows[:, axis]))
            right = rows[:, axis] > cut
            parts[2 * node + 1], parts[2 * node + 2] = rows[~right], rows[right]

    def candidates(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest2 - np.einsum("ij,ij->i", vectors, vectors), 0.0))
        return np.concatenate([vectors, rest[:, None]], axis=1) @ self.matrix

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.matrix[:-1]

    def leaf(self, projected: np.ndarray) -> np.ndarray:
        node = np.zeros(len(projected), dtype=np.int64)
        for _ in range(self.depth):
            right = projected[np.arange(len(node)), self.axes[node]] > self.cuts[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every leaf's box."""
    out = np.empty((len(points), len(low)))
    for k, p in enumerate(points):
        gap = np.maximum(np.maximum(low - p, p - high), 0)
        out[k] = np.einsum("ij,ij->i", gap, gap)
    return out


def valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def verify(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, own: np.ndarray, gap: np.ndarray, reach0: np.ndarray, bounds: np.ndarray, limit: float, k: int):
    """Of each query the places of its k best rows and their scores, and how many rows were scored.

    gap holds projected squared distances; own the row that is the query itself, or -1; limit * (reach0 - 2 * bound) is
    how far the test lets a query look. Of a query that many rows pass, the VERIFIED nearest in projection are scored
    first, which raises the bound for the others. Where over a quarter of all pairs pass at the outset, one product of
    the blocks is cheaper than picking rows, and scores them all.
    """
    first = ~(gap >= (limit * np.maximum(reach0 - 2 * bounds, 0) + SLACK)[:, None])  # all, where no bound is known
    whole = queries @ vectors.T if first.mean() > 0.25 else None
    for q in range(len(queries)):
        at, bound = np.flatnonzero(first[q]), bounds[q]
        at = at[at != own[q]]
        if whole is not None:
            score, scored = whole[q][at], len(vectors)
        else:
            if len(at) > 2 * VERIFIED:
                near = np.argpartition(gap[q][at], VERIFIED)
                near, rest = at[near[:VERIFIED]], at[near[VERIFIED:]]
                score = vectors[near] @ queries[q]
                kth = np.partition(score, -k)[-k] if len(score) >= k else -math.inf
                bound = kth if math.isnan(bound) else max(bound, kth)
                rest = rest[gap[q][rest] < limit * max(reach0[q] - 2 * bound, 0.0) + SLACK]
                at, score = np.concatenate([near, rest]), np.concatenate([score, vectors[rest] @ queries[q]])
            else:
                score = vectors[at] @ queries[q]
            scored = len(at)
        if not math.isnan(bound):
            at, score = at[score >= bound - SLACK], score[score >= bound - SLACK]
        if len(at) > k:
            at = at[score >= np.partition(score, -k)[-k] - SLACK]
        # summed alike wherever a vector stands, so that equal vectors tie
        exact = (vectors[at] * queries[q]).sum(axis=1)
        best = np.lexsort((ids[at], -exact))[:k]
        yield at[best], exact[best], scored


def _search(k: int, projector: Projector, limit: float):
    """Each row is a block of candidates and a block of queries; gives each query's nearest there.

    A row of rank 0 for each query has the number of rows scored, negative, for a score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[], [], [], []]
            for row in range(batch.num_rows):
                rows, asked = batch.column("rows")[row].values, batch.column("queries")[row].values
                ids, vectors = rows.field("vec_id").to_numpy(), matrix(rows.field("vector"))
                points, queries = projector.candidates(vectors), matrix(asked.field("vector"))
                bounds, asked_points = asked.field("bound").to_numpy(), projector.queries(queries)
                qids, keys = asked.field("query_id").to_numpy(), asked.field("key").to_numpy()
                mine = np.full(len(qids), -1)  # one row alike in id and vector is the query itself
                for q in range(len(qids)):
                    same = np.flatnonzero(ids == qids[q])
                    same = same[(vectors[same] == queries[q]).all(axis=1)]
                    mine[q] = same[0] if len(same) else -1
                gap = np.einsum("ij,ij->i", points, points)[None, :] - 2 * asked_points @ points.T
                gap += np.einsum("ij,ij->i", asked_points, asked_points)[:, None]
                reach0 = np.einsum("ij,ij->i", queries, queries) + projector.largest2
                for q, (best, score, n) in enumerate(verify(queries, vectors, ids, mine, gap, reach0, bounds, limit, k)):
                    found[0].append(np.full(len(best) + 1, keys[q]))
                    found[1].append(np.full(len(best) + 1, qids[q]))
                    found[2].append(np.append(ids[best], -1))
                    found[3].append(np.append(score, -float(n)))
            columns = [np.concatenate(x) if x else np.zeros(0) for x in found]
            kinds = (np.int64, np.int64, np.int64, np.float64)
            counts = np.concatenate([np.append(np.zeros(len(x) - 1, dtype=bool), True) for x in found[0]]) if found[0] else np.zeros(0, dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c.astype(t)) for c, t in zip(columns, kinds, strict=True)), pa.array(counts)],
                names=["key", "query_id", "vec_id", "score", "is_count"],
            )

    return run


RESULT = "query_id long, rank int, vec_id long, score double"
NO_ID = (1 << 63) - 1


def nearest(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    sure: float = SURE,
    leaf: int = LEAF,
    report: dict | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that is_query holds for, its k nearest rows.

    report, if given, gets the numbers of queries, leaves, visits of a leaf, and rows scored, for each length.
    """
    spark = vectors.sparkSession
    prepare(spark)
    none = F.col(id_col).isNull()
    rows = vectors.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), none.alias("none"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(is_query & ~none, F.lit(False)).alias("asks"),
    )
    rows = rows.where(valid(F.col("vector")))
    out = spark.createDataFrame([], RESULT)
    # a row for each length there is; a table of embeddings has one, or few
    for width, n, asked in sorted(tuple(r) for r in rows.groupBy(F.size("vector").alias("w")).agg(F.count("*"), F.count_if("asks")).collect()):
        if asked:
            found: dict = {}
            out = out.unionByName(_nearest(rows.where(F.size("vector") == width), width, n, k, sure, leaf, found))
            if report is not None:
                report[width] = found
    return out


def _nearest(rows: DataFrame, width: int, n: int, k: int, sure: float, leaf_rows: int, report: dict) -> DataFrame:
    spark = rows.sparkSession
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    largest = rows.agg(F.max(norm)).first()[0]
    sample = matrix(rows.orderBy(F.xxhash64("vec_id", "vector")).limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks())
    depth = min(int(math.log2(LEAVES)), max(0, math.ceil(math.log2(max(1, n / leaf_rows)))))
    projector, limit = Projector(width, largest, depth, sample), chi2_limit(sure, DIMENSIONS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = projector.candidates(matrix(batch.column("vector")))
            leaf = pa.array(projector.leaf(points).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, leaf, pa.array([*points], pa.list_(pa.float64()))], names=[*batch.schema.names, "leaf", "point"])

    placed = written(rows.mapInArrow(place, "vec_id long, none boolean, vector array<double>, asks boolean, leaf int, point array<double>"), "ann")
    point = [F.col("point")[j] for j in range(DIMENSIONS)]
    boxes = placed.groupBy("leaf").agg(
        F.count("*").alias("n"), *(F.min(p).alias(f"low{j}") for j, p in enumerate(point)), *(F.max(p).alias(f"high{j}") for j, p in enumerate(point))
    )
    boxes = boxes.orderBy("leaf").toArrow()  # at most LEAVES rows
    low, high = (np.stack([boxes.column(f"{x}{j}").to_numpy() for j in range(DIMENSIONS)], axis=1) for x in ("low", "high"))
    numbers, counts = boxes.column("leaf").to_numpy(), boxes.column("n").to_numpy()
    blocks = np.maximum(1, -(-counts // BLOCK))
    leaf_blocks = spark.createDataFrame([*zip(numbers.tolist(), blocks.tolist(), strict=True)], "leaf int, blocks long")
    # the rows of leaf_blocks are those of boxes; blocks are dealt with the id, so a vector of many ids fills blocks evenly
    sized = placed.join(F.broadcast(leaf_blocks), "leaf")
    index = sized.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks")).cast("int"))
    index = index.groupBy("leaf", "block").agg(F.collect_list(F.struct("vec_id", "vector")).alias("rows"))
    index = written(index, "ann-index")
    # query rows alike in id and vector are searched once
    queries = placed.where("asks").groupBy(F.col("vec_id").alias("query_id"), "vector").agg(F.count("*").alias("times"))
    queries = written(queries.withColumn("key", F.xxhash64("query_id", "vector")), "ann-queries")
    asking = queries.count()
    groups = max(1, -(-asking // QUERIES))

    def route(first: int, last: int):
        """Sends a query to the leaves numbered from first to last in the order of their distance, as far as the test goes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                asked = matrix(batch.column("vector"))
                for part in range(0, len(asked), 256):
                    q = asked[part : part + 256]
                    near = box_distances(projector.queries(q), low, high)
                    order = np.argsort(near, axis=1, kind="stable")[:, first:last]
                    bounds = batch.column("bound").to_numpy(zero_copy_only=False)[part : part + 256].astype(float)
                    reach = limit * np.maximum(np.einsum("ij,ij->i", q, q) + projector.largest2 - 2 * bounds, 0)
                    visit = ~(np.take_along_axis(near, order, axis=1) >= (reach + SLACK)[:, None])  # all, where no bound is known
                    row, nth = np.nonzero(visit)
                    leaf = order[row, nth]
                    times = blocks[leaf]
                    row, leaf = np.repeat(row, times), np.repeat(leaf, times)
                    block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    for some in range(0, len(row), 4096):
                        r = pa.array(row[some : some + 4096] + part)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(numbers[leaf[some : some + 4096]].astype(np.int32)),
                                pa.array(block[some : some + 4096].astype(np.int32)),
                                *(batch.column(c).take(r) for c in ("key", "query_id", "vector", "bound")),
                            ],
                            names=["leaf", "block", "key", "query_id", "vector", "bound"],
                        )

        return run

    def visit(asked: DataFrame, first: int, last: int) -> DataFrame:
        schema = "leaf int, block int, key long, query_id long, vector array<double>, bound double"
        sent = asked.mapInArrow(route(first, last), schema)
        sent = sent.groupBy("leaf", "block", F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group"))
        sent = sent.agg(F.collect_list(F.struct("key", "query_id", "vector", "bound")).alias("queries"))
        pairs = index.join(sent, ["leaf", "block"]).select("rows", "queries")
        return pairs.mapInArrow(_search(k, projector, limit), "key long, query_id long, vec_id long, score double, is_count boolean")

    ranked = W.partitionBy("key", "query_id").orderBy(F.desc("score"), "vec_id")
    best, first, visits, scored = None, 0, 0, 0
    while first < len(numbers):
        last = min(len(numbers), max(1, first * STEP))
        asked = queries.select("key", "query_id", "vector")
        if best is None:
            asked = asked.withColumn("bound", F.lit(float("nan")))
        else:
            bounds = best.where(F.col("rank") == k).select("key", "query_id", F.col("score").alias("bound"))
            asked = asked.join(bounds, ["key", "query_id"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("nan"))))
        found = written(visit(asked, first, last), "ann-round")
        sums = found.where("is_count").agg(F.count("*").alias("v"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("s")).first()
        visits, scored = visits + sums["v"], scored - int(sums["s"])
        new = found.where(~F.col("is_count")).drop("is_count")
        if best is not None:
            new = best.drop("rank").unionByName(new)
        best = written(new.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k), "ann-best")
        first = last
        if sums["v"] == 0:
            break  # every query's search has ended
    report.update(queries=asking, rows=n, leaves=len(numbers), visits=visits, scored=scored)
    copies = queries.select("key", "query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    out = best.join(copies, ["key", "query_id"])
    return out.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
