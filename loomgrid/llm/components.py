"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), all in DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, materialize

#: Edges up to which the minima of all nodes (two a link at most, some 50 bytes each) are broadcast: 25 MB.
BROADCAST_EDGES = 1 << 18


def connected_components(edges: DataFrame, max_rounds: int = 60, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """edges: (src long, dst long), any direction, repeats and loops allowed; rows with a null end are ignored.

    Returns (node, component): one row per node that has a link to another one; component is the smallest node reachable.
    Each half step is a minimum per node (partial aggregation first) joined back to the edges. Up to broadcast_edges counted
    edges the minima are broadcast and both half steps are one job. Beyond, they are written before the join, so both of its
    sides are plain exchanges that the adaptive planner can split at a hot node. The rows are the same either way.
    """
    now = materialize(edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        small = mark[0] <= broadcast_edges
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = _star(both, F.col("v") > F.col("u"), small)
        nxt = _star(wide, F.lit(True), small)
        old, last = now, mark
        now = materialize(nxt) if small else nxt
        mark = _mark(now)
        drop_written(old)
        if not small:
            drop_written(wide)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _star(edges: DataFrame, move: Column, small: bool) -> DataFrame:
    """Every end v for which move holds is linked to the least end that its centre u sees; the centre is linked to it too."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    minima = F.broadcast(least) if small else materialize(least)
    ends = F.explode(F.array(F.col("u"), F.when(move, F.col("v")))).alias("e")
    out = edges.join(minima, "u").select(ends, "m").where("e <> m").select(F.greatest("e", "m").alias("u"), F.least("e", "m").alias("v")).distinct()
    if small:
        return out
    out = materialize(out)
    drop_written(minima)
    return out


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
