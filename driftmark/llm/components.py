"""Connected components of links, in numpy for a task's share and in Spark for all."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import Scratch


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as a-b do: each node to the least of its component."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        while True:  # to the root
            up = new[new]
            if np.array_equal(up, new):
                break
            new = up
        if np.array_equal(new, label):
            break
        label = new
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]


def roots(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, root): each linked node and the least node that it reaches.

    Alternating large-star and small-star steps: each replaces links by links to lesser
    neighbours until only stars are left. A node's least neighbour is found by a partial
    aggregation and joined back: the hub's links, rows of two numbers, stream through the join,
    which adaptive execution splits where they are many, and are nowhere gathered. Each round
    is written to the shared folder; rounds grow with the logarithm of the nodes.
    """

    def starred(edges: DataFrame) -> DataFrame:
        # large star: every greater neighbour of a node gets linked to the node's least neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min(F.least("a", "b")).alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter(F.col("a") != F.col("b")).distinct()
        # small star: a node and its lesser neighbours get linked to the least of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        floor = down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        moved = down.join(floor, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
        return moved.unionByName(floor.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col("a") != F.col("b")).distinct()
    edges = scratch.write(edges)
    seen = mark(edges)
    for _ in range(most):
        new = scratch.write(starred(edges))
        now = mark(new)
        scratch.drop(edges)
        edges = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components are not found after {most} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
