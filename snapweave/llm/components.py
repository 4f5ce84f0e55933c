"""Connected components of an edge table, and small table helpers of the subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import written

FEW = 1 << 16      # edges, 1 MB: what is left is closed in one task
HELD = 1 << 20     # edges that a task holds


def shuffle_partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node id reachable over ``edges`` (a, b).

    Every task first replaces the edges it reads by stars, every node tied to the
    smallest it reaches in them. Then rounds of contraction: every node points to its
    smallest neighbour, the pointers are followed to their ends, and the edges are
    taken over to those ends, where repeated ones and those inside one end fall away.
    So the edges are joined once as they are and a far smaller rest afterwards. A
    rest of at most ``FEW`` edges, a fixed bound that no input raises, is closed by
    one more pass of stars instead of rounds of joins over all partitions. What a
    round leaves is written to the shared folder (a table's size is read anew each
    round, where checkpoints multiply the estimates of their joins until the planner
    fails). Nodes without an edge don't appear. Null ends take no part.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    left = written(e.mapInArrow(_stars, "a long, b long"))
    label = None
    while True:
        few = left.count() <= FEW
        if few:
            end = written(left.coalesce(1).mapInArrow(_stars, "a long, b long"))
            end = end.union(end.select("b", "b").distinct()).toDF("node", "l")
        else:
            end = _ends(left.union(left.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                        .select("node", F.least("node", "m").alias("l")))
        label = end if label is None else (label.join(end.toDF("l", "ll"), "l", "left")
                                           .select("node", F.coalesce("ll", "l").alias("l")))
        if few:
            return label.select("node", F.col("l").alias("component"))
        moved = left.join(end.toDF("a", "x"), "a").join(end.toDF("b", "y"), "b").where("x <> y")
        left = written(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        label = written(label)


def _stars(batches):
    """Edges (a, b) -> for every node but the smallest of those it reaches in them (a, smallest); at most HELD and a batch at once."""
    held, n = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)])
        n += len(held[-1][0])
        if n >= HELD:
            yield _star_batch(held)
            held, n = [], 0
    if held:
        yield _star_batch(held)


def _star_batch(held):
    nodes, place = np.unique(np.concatenate([x for part in zip(*held, strict=True) for x in part]), return_inverse=True)
    to = smallest_reachable(len(nodes), *place.reshape(2, -1))
    moved = np.flatnonzero(to != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[to[moved]])], names=["a", "b"])


def smallest_reachable(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of ``size`` nodes, the smallest one reachable from each over the edges (i, j)."""
    label = np.arange(size)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        for x in (i, j, label[i], label[j]):     # the ends, and what they point to
            np.minimum.at(label, x, low)
        label = label[label]
        if (label == before).all():
            return label


def _ends(pointers: DataFrame) -> DataFrame:
    """(node, l) with every pointer followed to its end, a node that points to itself; two doublings a round."""
    def jumped(p):
        return p.join(p.toDF("l", "ll"), "l").select("node", F.col("l").alias("old"), F.col("ll").alias("l"))

    at = written(pointers)
    while True:
        new = written(jumped(jumped(at).select("node", "l")))
        at = new.select("node", "l")
        if new.where("l <> old").isEmpty():
            return at
