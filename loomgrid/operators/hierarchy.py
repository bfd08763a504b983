"""Distribution trees from parent links: paths, depths and sums over subtrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staged import staged


def tree_paths(edges: DataFrame, node: str = "node", parent: str = "parent", max_depth: int = 6) -> DataFrame:
    """(node, parent, depth, path array): nodes that a root reaches within max_depth; cycles have no root and so are left out.

    One join per level, each with the level above only; a node is reached once, as it has one parent. Levels are kept as
    they are made, so that none is worked out again for the next.
    """
    base = edges.select(F.col(node).alias("node"), F.col(parent).alias("parent"))
    level = base.where("parent IS NULL").select("node", "parent", F.lit(0).alias("depth"), F.array("node").alias("path"))
    out = level
    for depth in range(1, max_depth + 1):
        level = staged(level)
        if level.isEmpty():
            break
        out = level if depth == 1 else out.unionByName(level)
        above = level.select(F.col("node").alias("__p"), F.col("path").alias("__path"))
        level = base.join(above, F.col("parent") == F.col("__p")).where(~F.array_contains("__path", F.col("node"))).select("node", "parent", F.lit(depth).alias("depth"), F.concat("__path", F.array("node")).alias("path"))
    else:
        out = out.unionByName(level)
    return out


def subtree_sums(paths: DataFrame, values: DataFrame, node: str, value: str) -> DataFrame:
    """(node, total): the sum of value over a node and all below it; every row is sent to each of its path's nodes."""
    own = values.groupBy(node).agg(F.sum(value).alias("v"))
    return paths.join(own, paths["node"] == own[node], "left").select(F.explode("path").alias("node"), "v").groupBy("node").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("total"))
