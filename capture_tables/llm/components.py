"""Connected components of a table of links, by hooking and pointer jumping as joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, member) that join the same values as all the links (a, b), fewer than
    there are values: each value is linked with the smallest of its component."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[rest]], nodes[rest]


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every value in the links (a, b); root is the smallest in its component.

    Each round hooks every node, and the root it has, to the smallest root next to it, then
    jumps to the root's root, so that the rounds grow with the logarithm of the diameter.
    Each round's table is written to the shared folder.
    """
    edges = common.stored(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    both = edges.union(edges.select("b", "a"))
    state = common.stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")))
    while True:
        near = both.join(state, both.a == state.node).select(F.col("b").alias("node"), F.col("root").alias("low"))
        hooks = near.groupBy("node").agg(F.min("low").alias("low"))
        step = state.join(hooks, "node").select("node", "root", F.least("root", "low").alias("low"))
        tops = step.select(F.col("root").alias("node"), "low").union(step.select("node", "low"))
        tops = tops.groupBy("node").agg(F.min("low").alias("low"))
        jump = tops.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = common.stored(
            step.select("node", "root")
            .join(tops, "node")
            .join(jump, "low", "left")
            .select("node", F.coalesce("lower", "low").alias("root"), (F.coalesce("lower", "low") < F.col("root")).alias("moved"))
        )
        moved = new.where("moved").limit(1).count()
        state = new.select("node", "root")
        if not moved:
            return state
