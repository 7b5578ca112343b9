"""Connected components of links between long ids, by alternating stars (large star, small star); of few links, in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.shared import SMALL, lean, materialise, release


def components(links: DataFrame, left: str = "x", right: str = "y") -> DataFrame:
    """(node, root) of every node of a link: root is the smallest node that links reach.

    Each round joins edges with per-node minima (aggregated map-side, joined by shuffle), is written to the shared
    folder, and halves the depth of the trees about; the graph never leaves the executors. Links of a node with
    itself give it a row. An empty table gives no rows.
    """
    u, v = F.col("u"), F.col("v")
    every = links.select(F.col(left).alias("u"), F.col(right).alias("v"))
    edges = materialise(every.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: larger neighbours move to the smallest one.
        large = both.filter(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v")).filter(u != v).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(v.alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        before, edges = edges, materialise(small.filter(u != v).distinct(), "edges")
        release(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    nodes = every.select(u.alias("node")).union(every.select(v.alias("node"))).distinct()
    roots = edges.groupBy(u.alias("child")).agg(F.min("v").alias("root"))
    return nodes.join(roots, F.col("node") == F.col("child"), "left").select("node", F.coalesce("root", "node").alias("root"))


def _joined(batches):
    """(node, root) of all links that a task reads: larger roots hang on smaller ones, and paths are cut short."""
    links = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    each, place = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *links], 1), return_inverse=True)
    x, y = place.reshape(2, -1)
    root = np.arange(len(each))
    while (root[x] != root[y]).any():
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(each[root])], names=["node", "root"])


def connect(links: DataFrame) -> DataFrame:
    """components() of a written table (x, y) of longs that are not null. Up to SMALL links, a few MB, are joined by one task:
    a round of stars shuffles seven times, however few they are."""
    if links.count() > SMALL:
        return components(links)
    return links.select("x", "y").coalesce(1).mapInArrow(lean(_joined), "node long, root long")
