"""Connected components of an undirected graph, label by label, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.storage import Scratch


def connected_components(edges: DataFrame, src: str, dst: str, scratch: Scratch, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node that can be reached.

    Each round takes the smallest label among a node's neighbours, then jumps to that label's own
    label, so long chains close in a logarithmic number of rounds. Labels are written to the shared
    folder each round; only the count of changed labels comes to the driver. Both sides of every
    join are read from tables, so that adaptive execution can split the partitions of a hub node.

    Edges with a null end and loops are left out; an empty edge table gives an empty result.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    both = scratch.write(e.union(e.select("v", "u")).distinct(), f"{name}_edges")
    labels = scratch.write(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")), f"{name}_0")
    for k in range(1, max_rounds + 1):
        near = both.join(labels, both.v == labels.node).groupBy(F.col("u").alias("near_node")).agg(F.min("label").alias("near_label"))
        stepped = labels.join(near, labels.node == near.near_node, "left").select("node", F.col("label").alias("was"), F.least("label", "near_label").alias("step"))
        jump = labels.select(F.col("node").alias("jump_node"), F.col("label").alias("to_label"))
        moved = stepped.join(jump, stepped.step == jump.jump_node, "left").select("node", "was", F.least("step", "to_label").alias("label"))
        labels = scratch.write(moved.select("node", "label", (F.col("label") < F.col("was")).alias("changed")), f"{name}_{k}")
        changed = labels.where("changed").count()
        scratch.drop(f"{name}_{k - 1}")
        labels = labels.select("node", "label")
        if not changed:
            scratch.drop(f"{name}_edges")
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
