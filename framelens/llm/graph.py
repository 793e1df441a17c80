"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps are a partial aggregation and an equi-join, so a node with very many neighbours is neither
collected nor expanded; the number of rounds grows with the logarithm of the longest path. Before a round each
task replaces the edges it has by stars, of at most CHUNK edges at a time, which connect the same nodes: fewer
edges are shuffled, and the paths that are left are shorter. The rounds end when the table is of stars only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import written

MAX_ROUNDS = 60
#: Most edges that a task holds.
CHUNK = 500_000


def _stars_of(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """(u, v) for every node but the smallest of each component of the edges: v is that smallest one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    leaf = root != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[leaf], pa.int64()), pa.array(nodes[root[leaf]], pa.int64())], ["u", "v"])


def _contracted(batches):
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, CHUNK):
            part = b.slice(at, CHUNK)
            if held and n + part.num_rows > CHUNK:
                yield _stars_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n = [], 0
            held.append((part.column(0).to_numpy(), part.column(1).to_numpy()))
            n += part.num_rows
    if held:
        yield _stars_of(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges (u, v) with u > v. large: neighbours above a node point to its smallest; small: those below do. Rows may repeat."""
    if small:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(low, "u")
        return joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _left(edges: DataFrame) -> tuple[int, int]:
    """Nodes that are not yet in one star only, and nodes that have several rows."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), "v", F.lit(1).alias("n")), F.struct(F.col("v").alias("id"), "v", F.lit(0).alias("n")))).alias("e")).select("e.*")
    nodes = ends.groupBy("id").agg((F.min("v") < F.max("v")).alias("torn"), (F.sum("n") > 1).alias("twice"))
    return tuple(nodes.agg(F.count_if("torn"), F.count_if("twice")).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: (a, b) long, in any order, repeats and loops allowed. Returns (id, root), root the smallest id of
    the component, for every node of an edge between different nodes but the roots themselves."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    for _ in range(MAX_ROUNDS):
        e = written(e.mapInArrow(_contracted, "u long, v long"), name)
        e = written(_star(_star(e, small=False), small=True), name)
        torn, twice = _left(e)
        if not torn:
            e = written(e.distinct(), name) if twice else e
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
