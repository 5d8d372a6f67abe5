"""Connected components of an edge table, without the driver and without a task that holds a component."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, per_key


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect just what the given edges connect."""
    if not len(u):
        return u, v
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[label])
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _unsettled(edges: DataFrame) -> bool:
    """Whether distinct edges (u > v) are anything but stars: some node has two smaller neighbours, or a smaller and a greater one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))).alias("x")).select("x.*")
    ends = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return ends.where(F.col("below") + F.col("above") > 1).agg(F.count(F.lit(1)).alias("n")).first()["n"] > 0


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 40) -> DataFrame:
    """``edges(u, v)`` of longs -> ``(node, component)`` for every node of an edge; component: the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014). Each step sends every edge to a
    smaller neighbour, so a hub gets no rows beyond its own edges; the minimum of a hot node is summed
    before the shuffle and joined back by a join that AQE can split. Each round is a table in the shared folder.
    """
    now = scratch.put(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    for k in range(rounds + 1):
        if not _unsettled(now):
            break
        if k == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = per_key(both, "u", F.min("v").alias("m"))
        star = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
        star = star.distinct().select(F.col("a").alias("u"), F.col("b").alias("v"))  # u > v throughout
        low = per_key(star, "u", F.min("v").alias("m"))
        small = star.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.put(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{k + 1}")
        scratch.drop(f"{name}-{k}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
