"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.llm.common import HOT_PART, cut

EDGES = "hi bigint, lo bigint"
#: Edges that a task contracts at a time.
CHUNK = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """`edges` has bigint columns a and b. Gives one row per node that has an edge: `node`, and `root`, the smallest node of its component.

    Null ends, loops and repeated edges are dropped. Each round is two joins by broadcast and by shuffle and an aggregation
    over the edges, and is written to the checkpoint folder; nothing but two counts comes to the driver. What the driver
    holds grows with the number of tasks, so plans are short and the last round is one that changes something: the edges
    are done when each node has one smaller neighbour, which has none, or none itself. The number of rounds grows with
    the logarithm of the longest path.
    """
    state = _small_star(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")))
    while True:
        nodes = _nodes(state)
        is_open = F.col("least").isNotNull() & ((F.col("least") < F.col("most")) | (F.col("above") > 0))
        left, total = nodes.agg(F.count_if(is_open), F.sum("above")).first()
        if not left:
            return nodes.select("node", F.coalesce("least", "node").alias("root"))
        state = _small_star(_large_star(state, nodes, total))


def _nodes(state: DataFrame) -> DataFrame:
    """One row per node: the `least` and the `most` of its smaller neighbours, or null, and the number of edges to larger ones, `above`."""
    ends = F.array(
        F.struct(F.col("hi").alias("node"), F.col("lo").alias("next"), F.lit(0).alias("n")),
        F.struct(F.col("lo").alias("node"), F.lit(None).cast("bigint").alias("next"), F.lit(1).alias("n")),
    )
    return cut(state.select(F.inline(ends)).groupBy("node").agg(F.min("next").alias("least"), F.max("next").alias("most"), F.sum("n").alias("above")))


def _large_star(state: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour, or to itself if it is the smallest.

    `total`: the number of edges. The smallest neighbours of nodes that over HOT_PART of the edges lead to, fewer than
    1 / HOT_PART, are broadcast, and these edges are dealt by a hash of both ends; all others meet theirs by the node.
    """
    is_hot = F.col("above") > total * HOT_PART
    hot = nodes.where(is_hot).select(F.col("node").alias("_hot"), F.coalesce("least", "node").alias("_hot_to"))
    others = nodes.where(~is_hot & (F.col("above") > 0) & F.col("least").isNotNull()).select(F.col("node").alias("_node"), F.col("least").alias("_to"))
    marked = state.join(F.broadcast(hot), F.col("lo") == F.col("_hot"), "left").withColumn("_by", F.when(F.col("_hot").isNull(), F.col("lo")).otherwise(F.xxhash64("hi", "lo")))
    return marked.join(others, F.col("_by") == F.col("_node"), "left").select("hi", F.coalesce("_hot_to", "_to", "lo").alias("lo"))


def _small_star(state: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, are linked to the smallest of them, or of all that the edges of its chunk join them to.

    Tasks contract the edges they have before these are dealt by `hi`; so a node has one edge from each chunk at most.
    """
    return cut(state.mapInArrow(_contract, EDGES).repartition("hi").sortWithinPartitions("hi").mapInArrow(_contract_sorted, EDGES))


def spanning_stars(hi: np.ndarray, lo: np.ndarray) -> pa.RecordBatch:
    """Edges from every node that isn't the smallest of its component, within these edges, to the smallest."""
    nodes, at = np.unique(np.concatenate((hi, lo)), return_inverse=True)
    a, b = at[: len(hi)], at[len(hi) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    linked = root != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], ["hi", "lo"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning stars of each chunk of edges."""
    his: list[np.ndarray] = []
    los: list[np.ndarray] = []
    for batch in batches:
        his.append(batch.column("hi").to_numpy())
        los.append(batch.column("lo").to_numpy())
        if sum(map(len, his)) >= CHUNK:
            yield spanning_stars(np.concatenate(his), np.concatenate(los))
            his, los = [], []
    if his:
        yield spanning_stars(np.concatenate(his), np.concatenate(los))


def _contract_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same of edges sorted by `hi`; the edges of one `hi` are in one chunk."""
    hi, lo = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        hi, lo = np.concatenate((hi, batch.column("hi").to_numpy())), np.concatenate((lo, batch.column("lo").to_numpy()))
        if len(hi) >= CHUNK and (whole := int(np.searchsorted(hi, hi[-1]))):
            yield spanning_stars(hi[:whole], lo[:whole])
            hi, lo = hi[whole:], lo[whole:]
    if len(hi):
        yield spanning_stars(hi, lo)
