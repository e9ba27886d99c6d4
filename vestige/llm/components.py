"""Connected components of an edge table, without collecting edges or labels anywhere.

Every round replaces the edges by a contraction: tasks merge by union-find what they hold, in pieces
of a bounded number of edges and in as many tasks as that takes, then two star steps link every node
to the least node near it (large and small star). The rounds end when the edges are stars around
least nodes; each is written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _written, delete, written

#: Edges that a task merges at once.
PIECE = 500_000
ROUNDS = 40
#: Parts of a hub's edges, each of which one task may get.
PARTS = 64


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node reachable from each over the edges a-b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _merge(piece: int):
    """Stars for the edges of a task, each made of at least piece edges and less than a batch more, or of what is left."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        node, root = roots(rows.column("a").to_numpy(), rows.column("b").to_numpy())
        keep = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= piece:
                yield flush(held)
                held, rows = [], 0
        if held:
            yield flush(held)

    return run


def with_least(edges: DataFrame) -> DataFrame:
    """edges with m, the least b of each a.

    A hub's edges are dealt to parts by their other end, and m goes to those of its parts that have edges, so no task
    gets a hub's edges whole.
    """
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)))
    parts = dealt.groupBy("a", "part").agg(F.min("b").alias("m"))
    least = parts.groupBy("a").agg(F.min("m").alias("m"), F.collect_set("part").alias("parts")).select("a", "m", F.explode("parts").alias("part"))
    return dealt.join(least, ["a", "part"]).select("a", "b", "m")


def two(first: tuple[str, str], second: tuple[str, str]) -> Column:
    """Two edges (a, b) from each row, from these columns; the row's plan runs once for both."""
    return F.inline(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (first, second))))


def settled(edges: DataFrame) -> bool:
    """Whether distinct edges (a, b), a > b, are stars: no a has two edges, and no b is an a."""
    upper = F.struct(F.col("a").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below"))
    lower = F.struct(F.col("b").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below"))
    ends = edges.select(F.inline(F.array(upper, lower)))
    nodes = ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return nodes.where("above > 1 or above = 1 and below = 1").isEmpty()


def contracted(edges: DataFrame, piece: int) -> DataFrame:
    """Stars for edges read from a table: one task for each piece of them, so that the last pieces meet in one."""
    tasks = math.ceil(edges.count() / piece) or 1
    return edges.coalesce(tasks).mapInArrow(_merge(piece), "a long, b long").distinct()


def components(edges: DataFrame, piece: int = PIECE) -> DataFrame:
    """(node, component) for every node of the edges (a long, b long); component is its least node.

    A task merges piece edges at once; the result doesn't depend on it. An empty edge table gives no
    rows; self links and repeated edges change nothing.
    """
    spark = edges.sparkSession
    ends = edges.select("a", "b").where(F.col("a") != F.col("b"))
    now = written(ends.mapInArrow(_merge(piece), "a long, b long").distinct(), "components")  # from here on a > b
    for _ in range(ROUNDS):
        path = _written[-1]
        now = written(contracted(now, piece), "components")
        delete(spark, path)
        if settled(now):
            break
        # large star: every neighbour above a node is linked to the node's least neighbour
        both = now.select(two(("a", "b"), ("b", "a")))
        large = with_least(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        # small star: a node and its neighbours below it are linked to the least of them
        below = with_least(large.where(F.col("a") > F.col("b")))
        small = below.select(two(("b", "m"), ("a", "m"))).where(F.col("a") != F.col("b"))
        path = _written[-1]
        now = written(small.distinct(), "components")
        delete(spark, path)
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    # settled edges are stars around the least nodes
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
