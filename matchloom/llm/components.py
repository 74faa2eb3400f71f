"""Connected components of a graph too large for one machine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import Workspace, join_skewed

#: Edges that the driver may hold (16 bytes each): what is left of a graph then takes no more rounds.
GATHER = 1 << 18


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of edges, and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        p, q = label[x], label[y]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while ((up := label[label]) != label).any():
            label = up
    return nodes, nodes[label]


def gathered(edges: DataFrame, names: list[str]) -> DataFrame:
    """``smallest`` of edges (a, b) that the driver may hold."""
    got = edges.select("a", "b").toArrow()
    found = smallest(got.column("a").to_numpy(), got.column("b").to_numpy())
    return edges.sparkSession.createDataFrame(pa.table([pa.array(x, pa.int64()) for x in found], names))


def connected(edges: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """(node, label) for every end of ``edges`` (a, b): label is the smallest node it reaches.

    Each round hooks every component to its smallest neighbour, halves the paths so made, and
    contracts the edges, so at least half of the components that still have an edge go. Rounds
    are written tables. Once at most GATHER edges are left the driver takes them and ends it; the labels are the same.
    """
    n = edges.count()
    if n <= GATHER:
        return work.keep(gathered(edges.where("a <> b"), ["node", "label"]), f"{name}-labels", 2 * n)
    live = work.keep(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges", n)
    labels = work.keep(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), f"{name}-labels", 2 * n)
    nodes, round_ = labels.count(), 0
    while (left := live.count()) > 0:
        last = left <= GATHER
        if last:
            hook = work.keep(gathered(live, ["a", "to"]), f"{name}-hook{round_}", 2 * left)
        else:
            both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
            hook = work.keep(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to"), F.count(F.lit(1)).alias("__n")), f"{name}-hook{round_}", 2 * left)
            jump = hook.select(F.col("a").alias("to"), F.col("to").alias("next"))
            hook = work.keep(hook.join(jump, "to", "left").select("a", F.coalesce("next", "to").alias("to"), "__n"), f"{name}-jump{round_}", 2 * left)
        # A large component's label, and a node with many edges, are keys of many rows.
        sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
        step = work.keep(sizes.join(hook.select(F.col("a").alias("label"), "to"), "label"), f"{name}-step{round_}", 2 * left)
        moved = join_skewed(labels, step, ["label"], nodes, "left")
        labels = work.keep(moved.select("node", F.coalesce("to", "label").alias("label")), f"{name}-labels{round_}", nodes)
        if last:
            break
        ends = join_skewed(live, hook, ["a"], left).select(F.col("to").alias("x"), "b")
        ends = join_skewed(ends, hook.select(F.col("a").alias("b"), F.col("to").alias("y"), "__n"), ["b"], left)
        live = work.keep(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-edges{round_}", left)
        round_ += 1
    return labels
