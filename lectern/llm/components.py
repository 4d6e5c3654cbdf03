"""Connected components of an edge table, by hooking, pointer jumping and contraction.

Every round hooks each node to its smallest smaller neighbour, flattens the hooks by pointer jumping and replaces the
edges by those between the roots that are left. All steps are joins on unique keys and minimum aggregates, so a hub
with a third of the edges is combined before a shuffle or split by the planner. Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def flattened(hooks: DataFrame) -> DataFrame:
    """``node, root`` such that no root is a node; ``hooks`` maps each node to a smaller one."""
    hooks = written(hooks, "hooks")
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = written(hooks.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "jumped")
        hooks = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return hooks


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that isn't the smallest of its component. Loops and repeated edges do no harm."""
    ordered = lambda df, x, y: df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a < b").distinct()
    left = written(ordered(edges, a, b), "edges")
    found = None
    while not left.isEmpty():
        hooks = flattened(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        if found is None:
            found = hooks
        else:
            onward = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            moved = found.join(onward, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            found = written(moved.unionByName(hooks), "roots")
        to_a = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = written(ordered(left.join(to_a, "a", "left").join(to_b, "b", "left"), F.coalesce("ra", "a"), F.coalesce("rb", "b")), "edges")
    if found is None:
        return left.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return found
