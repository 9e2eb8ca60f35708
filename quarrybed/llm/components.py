"""Connected components by alternating star contraction, all of it in joins and aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a graph but the smallest of each component, and that smallest one for each."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while (apart := label[a] != label[b]).any():
        a, b = a[apart], b[apart]
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (far := label[label] != label).any():
            label[far] = label[label[far]]
    own = label == np.arange(len(nodes))
    return nodes[~own], nodes[label[~own]]


def connected_components(edges: DataFrame, max_rounds: int = 60, small: int = 0) -> DataFrame:
    """Columns u, v of longs -> (node, component), component being the smallest node reachable.

    Nodes without an edge to another node are left out. Each round is written to the shared
    folder, so a lost executor costs at most one round; no links reach the driver. A graph of
    at most ``small`` edges is one task's, as its rounds would be jobs of hardly any rows.
    """
    if 0 < small >= edges.count():

        def run(batches):
            found = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in smallest_reachable(*(np.concatenate(x) for x in zip(*found)))], ["node", "component"])

        return written(edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, component long"), "components")
    edges = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        edges = written(_small_star(_large_star(edges)), "star")
        new = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
