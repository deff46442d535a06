"""Connected components of a graph too large for one machine, by contraction."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from braidflow.shared import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges (a long, b long) -> (node long, root long): every node with an edge, and its component's least node.

    Each round orders the nodes anew, by XOR with a mask of its own, hooks every node to the first of itself
    and its neighbours, follows that pointer once more, and contracts the graph. A node that is first among its
    neighbours takes them all in, and the order changes from round to round, so no chain of rising ids makes the
    rounds many: they grow with the logarithm of the nodes. A hub's rows are combined before the shuffle or split by
    the skewed join, and each round is written to the shared folder, which cuts the lineage.
    """
    kinds = edges.where("a <> b").select(F.lit(0).alias("kind"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    masks = random.Random(7)
    state, left = _counted(scratch, kinds, f"{name}-0")
    k = 0
    while left:
        mask = F.lit(masks.getrandbits(62))
        flipped = lambda c: F.col(c).bitwiseXOR(mask)  # noqa: B023, E731
        edges = state.where("kind = 0").select("a", "b")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min(flipped("b")).alias("p")).select(F.col("a").alias("node"), F.least(flipped("a"), "p").bitwiseXOR(mask).alias("p"))
        up = hook.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        jump = scratch.write(hook.join(up, "p").select("node", F.col("pp").alias("p")), f"{name}-jump")
        to = lambda c: jump.select(F.col("node").alias(c), F.col("p").alias(f"{c}p"))  # noqa: B023, E731
        fewer = edges.join(to("a"), "a").join(to("b"), "b").select(F.lit(0).alias("kind"), F.least("ap", "bp").alias("a"), F.greatest("ap", "bp").alias("b")).where("a <> b").distinct()
        if k:
            labels = state.where("kind = 1").join(to("b"), "b", "left").select("kind", "a", F.coalesce("bp", "b").alias("b"))
        else:
            labels = jump.select(F.lit(1).alias("kind"), F.col("node").alias("a"), F.col("p").alias("b"))
        state, left = _counted(scratch, fewer.unionByName(labels), f"{name}-{k + 1}")
        scratch.drop(f"{name}-jump", f"{name}-{k}")
        k += 1
    labels = state.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("of"))
    least = labels.groupBy("of").agg(F.min("node").alias("root"))
    return labels.join(least, "of").select("node", "root")


def _counted(scratch: Scratch, state: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The state, written, and how many edges it has."""
    seen = Observation()
    written = scratch.write(state.observe(seen, F.count_if(F.col("kind") == 0).alias("n")), name)
    return written, seen.get["n"]
