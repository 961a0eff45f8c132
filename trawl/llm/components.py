"""Connected components of a link table, as Spark joins (large-star / small-star).

Links are never collected: every round is two grouped minima and joins over the link table,
cut through a written table. A hub's rows are pre-aggregated by the grouped minimum, and the
join that hands the minimum back is one AQE can split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def local_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``u[i]-v[i]`` of one task as ``(node, smallest node of its local group)``: as many
    rows as nodes at most, so a dense group leaves a task as a star, not as all its pairs."""
    nodes, idx = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = idx[:len(u)], idx[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has a link; ``component`` is the smallest
    node reachable. An empty link table gives an empty result. Self links are ignored."""
    edges = cut(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
                .where("hi <> lo").distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select("lo", "hi").toDF("hi", "lo")).toDF("n", "m")
        low = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("r"))
        large = both.join(low, "n").where("m > n").select(F.col("m").alias("hi"), F.col("r").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("r"))
        small = (large.join(low, "hi").where("lo <> r").select(F.col("lo").alias("hi"), F.col("r").alias("lo"))
                 .union(low.select("hi", F.col("r").alias("lo"))).distinct())
        edges = cut(small, "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select("lo").distinct()
    return (edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
            .union(roots.select("lo", "lo")))
